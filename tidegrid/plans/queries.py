"""The registered queries: operators over the driver's tables, and the SQL that says the same.

lineitem stands in for points (x part, y supplier, z price, intensity
quantity), events for a space-time stack (node user, tick six hours, value)
and for a time series, orders for a manifest of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import basic, times
from tidegrid.operators import contours, gaps, geometry, inpaint, planefit, profiles, raster, runup, spectral, stack, stencil, windows
from tidegrid.plans import pipelines
from tidegrid.sources import catalog
from tidegrid.sources.shared import held, scratch
from tidegrid.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MATRIX = [[0.8, -0.6, 0.0, 10.0], [0.6, 0.8, 0.0, -5.0], [0.0, 0.25, 1.0, 2.0], [0.0, 0.0, 0.0, 1.0]]
POLYGON = [(20.0, 1.0), (900.0, 0.0), (1800.0, 60.0), (700.0, 95.0), (100.0, 40.0)]
LINE = geometry.Transect(0.0, 0.0, 1600.0, 1200.0, 25.0)
SIX_HOURS = 21_600_000_000
LEVELS = [100.0, 200.0, 300.0]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_quantity").alias("i"))


def event_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense (xi, ti, z)."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("xi"), F.floor(times.micros("ts") / F.lit(SIX_HOURS)).cast("long").alias("ti"), "value")
    return stack.spine(stack.stack_mean(e, ["xi", "ti"], "value", 100))  # values are cents


POINTS = "SELECT l_orderkey, l_linenumber, l_partkey AS x, l_suppkey AS y, l_extendedprice AS z, l_quantity AS i FROM lineitem"
STACK = """cells AS (SELECT CAST(user_id AS INTEGER) AS xi, CAST(floor(epoch_us(ts) / 21600000000.0) AS BIGINT) AS ti, CAST(round(value * 100.0) AS BIGINT) AS c FROM events),
means AS (SELECT xi, ti, CAST(sum(c) AS DOUBLE) / count(*) / 100.0 AS z FROM cells GROUP BY xi, ti),
stack AS (SELECT a.xi, b.ti, m.z FROM (SELECT DISTINCT xi FROM means) a CROSS JOIN (SELECT DISTINCT ti FROM means) b LEFT JOIN means m ON m.xi = a.xi AND m.ti = b.ti)"""
MIDDLE = "CASE WHEN len({0}) > 0 THEN (list_sort({0})[CAST(floor((len({0}) - 1) / 2.0) AS BIGINT) + 1] + list_sort({0})[CAST(floor(len({0}) / 2.0) AS BIGINT) + 1]) / 2 END"


# Points


@query(f"SELECT l_orderkey, l_linenumber, 0.8::DOUBLE * x + (-0.6)::DOUBLE * y + 0.0::DOUBLE * z + 10.0::DOUBLE AS xt, 0.6::DOUBLE * x + 0.8::DOUBLE * y + 0.0::DOUBLE * z - 5.0::DOUBLE AS yt, 0.0::DOUBLE * x + 0.25::DOUBLE * y + 1.0::DOUBLE * z + 2.0::DOUBLE AS zt FROM ({POINTS})")
def rigid_transform(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(geometry.transform("x", "y", "z", MATRIX), ("xt", "yt", "zt"))])


def _edges() -> list[tuple]:
    return [(*a, *b) for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1])]


_CROSS = " + ".join(f"CASE WHEN (({d} > y) <> ({b} > y)) AND (x < ({c - a}::DOUBLE) * (y - {b}::DOUBLE) / ({d - b}::DOUBLE) + {a}::DOUBLE) THEN 1 ELSE 0 END" for a, b, c, d in _edges())
_EDGE = " OR ".join(f"(({c - a}::DOUBLE) * (y - {b}::DOUBLE) - ({d - b}::DOUBLE) * (x - {a}::DOUBLE) = 0 AND x BETWEEN {min(a, c)} AND {max(a, c)} AND y BETWEEN {min(b, d)} AND {max(b, d)})" for a, b, c, d in _edges())


@query(f"SELECT l_orderkey, l_linenumber, x, y FROM ({POINTS}) WHERE i < 30 AND (({_EDGE}) OR ({_CROSS}) % 2 = 1)")
def polygon_filter(spark, sf_dir):
    """Brightness and polygon; the box of the polygon reaches the scan."""
    p = points(spark, sf_dir)
    own = p.where((F.col("i") < 30) & geometry.in_box("x", "y", POLYGON) & geometry.in_polygon("x", "y", POLYGON))
    return own.select("l_orderkey", "l_linenumber", "x", "y")


@query(f"SELECT xi, yi, xi * 30.0 AS xs, count(*) AS n FROM (SELECT CAST(round(x / 30.0) AS BIGINT) AS xi, CAST(round(y / 3.0) AS BIGINT) AS yi FROM ({POINTS})) GROUP BY xi, yi")
def grid_snap(spark, sf_dir):
    g = raster.gridded(points(spark, sf_dir), "x", "y", 30, 3)
    return g.groupBy("xi", "yi").agg((F.first("xi") * 30.0).alias("xs"), F.count("*").alias("n"))


_LOWER = f"""WITH p AS (SELECT CAST(round(x / 100.0) AS BIGINT) AS xi, CAST(round(y / 10.0) AS BIGINT) AS yi, z, CAST(round(z * 100.0) AS BIGINT) AS c FROM ({POINTS})),
m AS (SELECT xi, yi, quantile_cont(z, 0.5) AS m FROM p GROUP BY xi, yi),
low AS (SELECT p.* FROM p JOIN m ON p.xi = m.xi AND p.yi = m.yi WHERE p.z <= m.m),
s AS (SELECT xi, yi, count(*) AS n, CAST(sum(c) AS DOUBLE) AS s, CAST(sum(CAST(c AS HUGEINT) * c) AS DOUBLE) AS q, min(z) AS zmin FROM low GROUP BY xi, yi),
k AS (SELECT xi, yi, z AS zmode FROM (SELECT xi, yi, z, row_number() OVER (PARTITION BY xi, yi ORDER BY count(*) DESC, z) AS r FROM low GROUP BY xi, yi, z) WHERE r = 1),
t AS (SELECT s.*, k.zmode, s.s / s.n / 100.0 AS zmean, CASE WHEN s.n > 1 THEN sqrt(greatest(0.0, (s.q - s.s * s.s / s.n) / (s.n - 1))) / 100.0 ELSE 0.0 END AS zstd FROM s JOIN k ON s.xi = k.xi AND s.yi = k.yi)
SELECT xi, yi, zmean, zmean AS zmax, zmin, zmode, zstd, n FROM t WHERE n > 10 AND CASE WHEN zstd > 0 THEN zmean / (zstd / sqrt(n)) >= 10 ELSE zmean >= 0 END"""


@query(_LOWER)
def grid_lower_half_stats(spark, sf_dir):
    g = raster.gridded(points(spark, sf_dir), "x", "y", 100, 10)
    return raster.lower_half_stats(g, ["xi", "yi"], "z", least_n=10, least_snr=10.0, scale=100)


@query(f"SELECT xi, yi, i AS mode FROM (SELECT xi, yi, i, row_number() OVER (PARTITION BY xi, yi ORDER BY count(*) DESC, i) AS r FROM (SELECT CAST(round(x / 100.0) AS BIGINT) AS xi, CAST(round(y / 10.0) AS BIGINT) AS yi, i FROM ({POINTS})) GROUP BY xi, yi, i) WHERE r = 1")
def cell_mode(spark, sf_dir):
    return raster.cell_mode(raster.gridded(points(spark, sf_dir), "x", "y", 100, 10), ["xi", "yi"], "i")


@query(f"SELECT count(*) AS n_cells FROM (SELECT DISTINCT CAST(round(x / 30.0) AS BIGINT) AS xi, CAST(round(y / 3.0) AS BIGINT) AS yi FROM ({POINTS}))")
def occupied_cells(spark, sf_dir):
    return raster.occupied_cells(raster.gridded(points(spark, sf_dir), "x", "y", 30, 3))


@query(f"SELECT xi, yi, count(*) AS n, min(z) AS low, max(z) AS high FROM (SELECT CAST(round(x / 200.0) AS BIGINT) AS xi, CAST(round(y / 20.0) AS BIGINT) AS yi, z FROM ({POINTS})) GROUP BY xi, yi")
def cell_lists(spark, sf_dir):
    """Cells' points as arrays, summed up by their ends."""
    lists = raster.cell_lists(raster.gridded(points(spark, sf_dir), "x", "y", 200, 20), ["xi", "yi"], ["z"])
    return lists.select("xi", "yi", "n", F.element_at("points", 1)["z"].alias("low"), F.element_at("points", -1)["z"].alias("high"))


@query(f"SELECT CAST(round(x / 200.0) AS BIGINT) AS xi, CAST(round(y / 20.0) AS BIGINT) AS yi, l_orderkey, l_linenumber FROM ({POINTS})")
def by_cell(spark, sf_dir):
    return raster.by_cell(raster.gridded(points(spark, sf_dir), "x", "y", 200, 20)).select("xi", "yi", "l_orderkey", "l_linenumber")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
a AS (SELECT *, greatest(1.0::DOUBLE, least(CAST(n AS DOUBLE), n * 0.25::DOUBLE + 0.5::DOUBLE)) AS k FROM r), near AS (SELECT * FROM a WHERE i = floor(k) OR i = ceil(k))
SELECT event_type, min(value) + (max(value) - min(value)) * (max(k) - floor(max(k))) AS p25 FROM near GROUP BY event_type"""
)
def prctile25(spark, sf_dir):
    return raster.prctile(read(spark, sf_dir, "events"), ["event_type"], "value", 25, "p25")


@query(
    """WITH s AS (SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) AS s, CAST(sum(CAST(CAST(round(value * 100.0) AS BIGINT) AS HUGEINT) * CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) AS q FROM events GROUP BY event_type),
t AS (SELECT *, CASE WHEN n > 1 THEN sqrt(greatest(0.0, (q - s * s / n) / (n - 1))) / 100.0 ELSE 0.0 END AS std FROM s)
SELECT event_type, n, s / 100.0 AS total, s / n / 100.0 AS mean, std * std AS variance, std, s / n / 100.0 / (std / sqrt(CAST(n AS DOUBLE))) AS snr FROM t"""
)
def row_statistics(spark, sf_dir):
    m = raster.moments(read(spark, sf_dir, "events"), ["event_type"], "value", scale=100)
    return m.withColumn("snr", raster.signal_to_noise(F.col("mean"), F.col("std"), F.col("n")))


# Transects and fits

_ALONG = "((x - 0.0) * 1600.0 + (y - 0.0) * 1200.0) / 2000.0"
_ACROSS = "((y - 0.0) * 1600.0 - (x - 0.0) * 1200.0) / 2000.0"


@query(f"SELECT l_orderkey, l_linenumber, {_ALONG} AS along, {_ACROSS} AS across, CAST(greatest(0, least(80, round({_ALONG} / 25.0))) AS INTEGER) AS xi FROM (SELECT l_orderkey, l_linenumber, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ({POINTS})) WHERE abs({_ACROSS}) <= 200")
def transect_project(spark, sf_dir):
    near = geometry.near_line(points(spark, sf_dir), LINE, "x", "y", 200)
    return near.select("l_orderkey", "l_linenumber", "along", "across", "xi")


@query(f"SELECT CAST(greatest(0, least(80, round({_ALONG} / 25.0))) AS INTEGER) AS xi, count(*) AS n, min(z) AS least FROM (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, z FROM ({POINTS})) GROUP BY 1")
def nearest_node(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy(LINE.node(LINE.along("x", "y")).alias("xi")).agg(F.count("*").alias("n"), F.min("z").alias("least"))


_SUMS = f"""s AS (SELECT i, count(*) AS n, count(DISTINCT x) AS nx, CAST(sum(CAST(x AS HUGEINT)) AS DOUBLE) AS a, CAST(sum(CAST(x AS HUGEINT) * x) AS DOUBLE) AS b, CAST(sum(CAST(x AS HUGEINT) * x * x) AS DOUBLE) AS c, CAST(sum(CAST(x AS HUGEINT) * x * x * x) AS DOUBLE) AS e,
CAST(sum(v) AS DOUBLE) AS p, CAST(sum(CAST(v AS HUGEINT) * x) AS DOUBLE) AS q, CAST(sum(CAST(v AS HUGEINT) * x * x) AS DOUBLE) AS r FROM (SELECT *, CAST(round(z * 100.0) AS BIGINT) AS v FROM ({POINTS})) GROUP BY i)"""
_DET = "(n * (b * e - c * c) - a * (a * e - b * c) + b * (a * c - b * b))"


@query(
    f"""WITH {_SUMS} SELECT i, CASE WHEN nx >= 3 AND {_DET} <> 0 THEN (p * (b * e - c * c) - a * (q * e - r * c) + b * (q * c - r * b)) / {_DET} / 100.0 END AS c0,
CASE WHEN nx >= 3 AND {_DET} <> 0 THEN (n * (q * e - r * c) - p * (a * e - b * c) + b * (a * r - b * q)) / {_DET} / 100.0 END AS c1,
CASE WHEN nx >= 3 AND {_DET} <> 0 THEN (n * (b * r - c * q) - a * (a * r - b * q) + p * (a * c - b * b)) / {_DET} / 100.0 END AS c2, n FROM s"""
)
def profile_quadfit(spark, sf_dir):
    return profiles.quadratic_fit(points(spark, sf_dir), ["i"], "x", "z", sx=1, sz=100)


@query(f"WITH {_SUMS} SELECT i, CASE WHEN n > 5 AND n * b - a * a <> 0 THEN (n * q - a * p) / (n * b - a * a) / 100.0 END AS slope, CASE WHEN n > 5 AND n * b - a * a <> 0 THEN (p - (n * q - a * p) / (n * b - a * a) * a) / n / 100.0 END AS intercept, n FROM s")
def slope_fit(spark, sf_dir):
    return profiles.linear_fit(points(spark, sf_dir), ["i"], "x", "z", sx=1, sz=100)


@query()
def multi_transect(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("scan", F.col("i").cast("int") % 5)
    return profiles.multi_transect(p, geometry.Transect(0.0, 0.0, 2000.0, 40.0, 10.0), ["scan"], "x", "y", "z", [float(o) for o in range(-8, 12, 2)], tolerance=2.0, off_curve=60_000.0)


@query(f"WITH {_SUMS}, f AS (SELECT i, CASE WHEN n > 1 AND n * b - a * a <> 0 THEN (n * q - a * p) / (n * b - a * a) / 100.0 END AS k, CASE WHEN n > 1 AND n * b - a * a <> 0 THEN (p - (n * q - a * p) / (n * b - a * a) * a) / n / 100.0 END AS c FROM s) SELECT l_orderkey, l_linenumber, z - k * x - c AS detrended FROM ({POINTS}) t JOIN f ON f.i = t.i")
def detrend(spark, sf_dir):
    return profiles.detrended(points(spark, sf_dir), ["i"], "x", "z", sx=1, sz=100).select("l_orderkey", "l_linenumber", "detrended")


@query()
def plane_fit_tls(spark, sf_dir):
    return planefit.plane_fit(points(spark, sf_dir).withColumn("z", F.col("z") / 1000), ["i"], "x", "y", "z")


@query()
def plane_residual_filter(spark, sf_dir):
    p = points(spark, sf_dir).select((F.col("i").cast("int") % 2).alias("scan"), (F.col("x") / 20).alias("x"), "y", (F.col("z") / 50000).alias("z"))
    return planefit.residual_filter(p, ["scan"], "x", "y", "z", size=10.0, most=0.5)


@query("SELECT degrees(acos(least(1.0, greatest(-1.0, (0.6 * 0.8 + 0.8 * 0.6) / (sqrt(0.6::DOUBLE * 0.6 + 0.8::DOUBLE * 0.8) * sqrt(0.8::DOUBLE * 0.8 + 0.6::DOUBLE * 0.6)))))) AS angle")
def calib_angle(spark, sf_dir):
    a, b = [F.lit(v) for v in (0.6, 0.8)], [F.lit(v) for v in (0.8, 0.6)]
    return spark.range(1).select(geometry.normal_angle_columns(*a, *b).alias("angle"))


@query("SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, (0.25::DOUBLE * y + 2.0) - 1.0 AS dz FROM (SELECT range AS x FROM range(0, 10)) CROSS JOIN (SELECT range AS y FROM range(0, 10))")
def calib_compare(spark, sf_dir):
    mesh = spark.range(10).select(F.col("id").cast("double").alias("x")).crossJoin(spark.range(10).select(F.col("id").cast("double").alias("y"))).withColumn("z", F.lit(0.0))
    other = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1], [0, 0, 0, 1]]
    return geometry.compare_calibrations(mesh, other, MATRIX).select("x", "y", "dz")


@query(
    """WITH q AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id, embedding AS e FROM embeddings),
d AS (SELECT q.id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda k: CAST(round(CAST(q.e[k] AS DOUBLE) * 10000.0) AS BIGINT) * CAST(round(CAST(c.e[k] AS DOUBLE) * 10000.0) AS BIGINT))) AS dot FROM q, c WHERE q.id <> c.vec_id)
SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS r FROM d) WHERE r = 1"""
)
def nearest_neighbor(spark, sf_dir):
    """The stated queries, a small list, meet all vectors; ties go to the smaller id."""
    whole = F.transform(F.col("embedding"), lambda v: F.round(v.cast("double") * 10000).cast("long"))
    v = read(spark, sf_dir, "embeddings").select("vec_id", whole.alias("e"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    dot = F.aggregate(F.zip_with("q", "e", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", dot.alias("dot"))
    return pairs.groupBy("query_id").agg(F.max_by("vec_id", F.struct("dot", -F.col("vec_id"))).alias("vec_id"))


# Times and manifests


def _round(us: str, step: int) -> str:
    return f"make_timestamp(CAST(floor((epoch_us({us}) + {step // 2}) / {step}.0) AS BIGINT) * {step})"


@query(f"SELECT event_id, {_round('ts', 1800000000)} AS half FROM events")
def halfhour_round_exact(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", times.half_hour("ts").alias("half"))


@query("SELECT event_id, date_trunc('hour', ts) + CAST(round(extract('minute' FROM ts) / 30.0) * 30 AS INTEGER) * INTERVAL 1 MINUTE AS half FROM events")
def halfhour_round_minute(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", times.half_hour_by_minute("ts").alias("half"))


@query(f"SELECT event_id, {_round('ts', 500000)} AS half_s, {_round('ts', 3600000000)} AS hour, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d') AS label, strftime(ts, '%m%d_%H%M') AS name FROM events")
def time_rounding(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", times.half_second("ts").alias("half_s"), times.nearest_hour("ts").alias("hour"), times.day("ts").cast("string").alias("day"), F.date_format("ts", "yyyyMMdd").alias("label"), F.date_format("ts", "MMdd_HHmm").alias("name"))


@query("SELECT event_id, CAST(round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id)) / 1000000.0 / 0.5) AS BIGINT) + 1 AS tick FROM events")
def tick_round(spark, sf_dir):
    """Ticks count from each scan's first point in file order."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", times.micros("ts").alias("us"))
    first = e.groupBy("event_type").agg(F.min_by("us", "event_id").alias("first"))
    return e.join(first, "event_type").select("event_id", times.tick((F.col("us") - F.col("first")) / 1_000_000.0, 0.5, base=1).alias("tick"))


@query("SELECT event_id, make_timestamp(CAST(round((1000000.0 + event_id * 0.5 + 1000000000.0 + 315964782.0) * 1000000.0) AS BIGINT)) AS utc FROM events")
def gps_time(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 0.5 + 1_000_000).alias("gps"))
    return e.select("event_id", times.at_micros(times.gps_micros("gps", F.lit(1_000_000.0), leap_s=18)).alias("utc"))


@query("SELECT o_orderkey, make_timestamp(o_orderkey * 60000000) AS file_ts, CAST(NULL AS TIMESTAMP) AS no_ts FROM orders")
def file_times(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("name", F.concat(F.lit("/d/do-lidar_"), F.col("o_orderkey") * 60, F.lit(".laz")))
    at = lambda n: times.at_micros(times.seconds_of_name(n) * 1_000_000)
    return o.select("o_orderkey", at("name").alias("file_ts"), at(F.lit("do-lidar_x.laz")).alias("no_ts"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 10 DAY")
def recent_cut(spark, sf_dir):
    return catalog.recent(read(spark, sf_dir, "orders"), "o_orderdate", 10).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def date_range(spark, sf_dir):
    return catalog.within(read(spark, sf_dir, "orders"), "o_orderdate", "1995-01-01", "1995-12-31").select("o_orderkey")


@query(f"SELECT event_id, event_type, half FROM (SELECT event_id, event_type, {_round('ts', 1800000000)} AS half, row_number() OVER (PARTITION BY event_type, {_round('ts', 1800000000)} ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", times.half_hour("ts").alias("half"))
    return catalog.keep_first(e, ["event_type", "half"], ["event_id"])


@query("WITH d AS (SELECT DISTINCT o_orderdate AS ts FROM orders), r AS (SELECT ts, row_number() OVER (ORDER BY ts DESC) - 1 AS r, count(*) OVER () AS n FROM d) SELECT ts, r = 0 AS last FROM r WHERE r = 0 OR (r < n - n % 24 AND (n - n % 24 - 1 - r) % 24 = 0)")
def subsample_24_last(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.lit(1).alias("k")).distinct()
    return profiles.every_nth_and_last(d, ["k"], "ts", 24).select("ts", "last")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate NOT IN (SELECT o_orderdate FROM orders WHERE o_orderstatus = 'F')")
def resume_antijoin(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return catalog.unprocessed(o, o.where("o_orderstatus = 'F'"), ["o_orderdate"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 1000 = 0)")
def resume_newer(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return catalog.newer(o, "o_orderdate", o.where("o_orderkey % 1000 = 0"), "o_orderdate").select("o_orderkey")


@query("SELECT k, least FROM (SELECT k, v AS least, row_number() OVER (PARTITION BY k ORDER BY part, id) AS r FROM (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS part FROM orders)) WHERE r = 1")
def merge_surfaces(spark, sf_dir):
    """UNION ALL of stored and new rows; the stored one of a key stays."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("least"), F.col("o_orderkey").alias("id"))
    return catalog.merge_surfaces(o.where("id % 2 = 0"), o.where("id % 2 = 1"), ["k"], "id").select("k", "least")


@query("SELECT count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days FROM events")
def manifest_summary(spark, sf_dir):
    return catalog.summary(read(spark, sf_dir, "events"), "ts")


# Stacks


@query(f"WITH {STACK} SELECT xi, ti, z FROM means")
def timestack_mean(spark, sf_dir):
    return event_stack(spark, sf_dir).where("z is not null")


@query(f"WITH {STACK} SELECT xi, ti, z FROM stack")
def stack_spine(spark, sf_dir):
    return event_stack(spark, sf_dir)


@query(f"WITH {STACK}, ends AS (SELECT xi, min(ti) AS a, max(ti) AS b FROM means GROUP BY xi), axis AS (SELECT xi, unnest(range(a, b + 1)) AS ti FROM ends) SELECT axis.xi, axis.ti, m.z FROM axis LEFT JOIN means m ON m.xi = axis.xi AND m.ti = axis.ti")
def time_reindex(spark, sf_dir):
    return stack.regular_axis(event_stack(spark, sf_dir).where("z is not null"), "ti", 1, ["xi"])


@query(f"WITH {STACK}, last AS (SELECT max(ti) AS l FROM stack) SELECT xi, ti, z FROM stack UNION ALL SELECT xi, 2 * l - ti + 1, z FROM stack, last WHERE l - ti < 12")
def reflect_pad(spark, sf_dir):
    return gaps.reflect_pad(event_stack(spark, sf_dir), ["xi"], "ti", 12).select("xi", "ti", "z")


@query(f"WITH {STACK} SELECT xi, arg_max(z, ti) - arg_min(z, ti) AS change FROM means GROUP BY xi")
def surface_change(spark, sf_dir):
    return stack.change(event_stack(spark, sf_dir), ["xi"], "ti", "z")


@query(f"WITH {STACK}, base AS (SELECT xi, CAST(sum(CAST(round(z * 100.0) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS m FROM means WHERE ti < (SELECT min(ti) + 20 FROM means) GROUP BY xi) SELECT stack.xi, ti, z - m AS anomaly FROM stack LEFT JOIN base ON base.xi = stack.xi")
def surface_anomaly(spark, sf_dir):
    s = event_stack(spark, sf_dir)
    first = s.agg(F.min("ti")).first()[0] or 0  # one row
    return stack.anomaly(s, ["xi"], "ti", "z", first + 20, 100).select("xi", "ti", "anomaly")


_IDX = "(ti * 7) % 120"


@query(f"WITH {STACK}, t AS (SELECT DISTINCT ti, CAST({_IDX} AS INTEGER) AS xi FROM stack) SELECT t.ti, t.xi, s.z FROM t LEFT JOIN stack s ON s.ti = t.ti AND s.xi = t.xi")
def matrix_lookup(spark, sf_dir):
    s = event_stack(spark, sf_dir)
    index = s.select("ti", (F.col("ti") * 7 % 120).cast("int").alias("xi")).distinct()
    return stack.at_index(s, index, ["ti"]).select("ti", "xi", "z")


@query("SELECT event_id, CAST(CASE WHEN value <= 10 THEN 980 ELSE greatest(0, least(980, round((round(value, 1) - 10.0) / 0.5))) END AS INTEGER) AS at FROM events")
def index_lookup(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", stack.nearest_index("value", 10.0, 500.0, 0.5).alias("at"))


_RUN = "count(z) OVER (PARTITION BY xi ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"WITH {STACK}, r AS (SELECT *, {_RUN} AS run FROM stack) SELECT xi, ti, CAST(CASE WHEN z IS NULL THEN count(*) FILTER (z IS NULL) OVER (PARTITION BY xi, run) ELSE 0 END AS BIGINT) AS gap FROM r")
def gapsize(spark, sf_dir):
    return gaps.gap_size(event_stack(spark, sf_dir), ["xi"], "ti", "z").select("xi", "ti", "gap")


_BRACKET = """b AS (SELECT *, max(CASE WHEN z IS NOT NULL THEN ti END) OVER (PARTITION BY xi ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ao, min(CASE WHEN z IS NOT NULL THEN ti END) OVER (PARTITION BY xi ORDER BY ti ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bo FROM stack),
n AS (SELECT b.xi, b.ti, b.z, ao, bo, p.z AS av, q.z AS bv FROM b LEFT JOIN means p ON p.xi = b.xi AND p.ti = ao LEFT JOIN means q ON q.xi = b.xi AND q.ti = bo)"""


@query(f"WITH {STACK}, {_BRACKET} SELECT xi, ti, coalesce(z, CASE WHEN bo - ao - 1 <= 4 THEN av + (bv - av) * (ti - ao) / (bo - ao) END) AS filled FROM n")
def fill_small_gaps(spark, sf_dir):
    return gaps.fill_small(event_stack(spark, sf_dir), ["xi"], "ti", "z", 4).select("xi", "ti", "filled")


@query(
    f"""WITH {STACK}, {_BRACKET}, k AS (SELECT xi, ti, z, row_number() OVER (PARTITION BY xi ORDER BY ti) AS up, row_number() OVER (PARTITION BY xi ORDER BY ti DESC) AS down FROM means),
e AS (SELECT xi, min(ti) AS lo, max(ti) AS hi FROM stack GROUP BY xi),
f AS (SELECT xi, max(ti) FILTER (up = 1) AS o1, max(z) FILTER (up = 1) AS v1, max(ti) FILTER (up = 2) AS o2, max(z) FILTER (up = 2) AS v2, max(ti) FILTER (down = 1) AS p1, max(z) FILTER (down = 1) AS w1, max(ti) FILTER (down = 2) AS p2, max(z) FILTER (down = 2) AS w2 FROM k GROUP BY xi)
SELECT n.xi, n.ti, coalesce(z, CASE WHEN bo - ao <= 8 THEN av + (bv - av) * (n.ti - ao) / (bo - ao) END, CASE WHEN ao IS NULL AND o1 - lo <= 8 THEN v1 + (v2 - v1) * (n.ti - o1) / (o2 - o1) END, CASE WHEN bo IS NULL AND hi - p1 <= 8 THEN w1 + (w2 - w1) * (n.ti - p1) / (p2 - p1) END) AS filled
FROM n JOIN e ON e.xi = n.xi JOIN f ON f.xi = n.xi"""
)
def fillmissing_maxgap(spark, sf_dir):
    return gaps.fill_max_gap(event_stack(spark, sf_dir), ["xi"], "ti", "z", 8).select("xi", "ti", "filled")


# Moving windows


def _frame(key: str, order: str, a: int, b: int) -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


@query(f"WITH {STACK} SELECT xi, ti, min(z) {_frame('xi', 'ti', 6, 5)} AS movmin FROM stack")
def movmin_time(spark, sf_dir):
    return windows.moving_min(event_stack(spark, sf_dir), ["xi"], "ti", "z", 12).select("xi", "ti", "movmin")


@query(f"WITH {STACK} SELECT xi, ti, CASE WHEN count(z) {_frame('xi', 'ti', 1, 1)} = count(*) {_frame('xi', 'ti', 1, 1)} THEN CAST(sum(CAST(round(z * 100.0) AS BIGINT)) {_frame('xi', 'ti', 1, 1)} AS DOUBLE) / count(z) {_frame('xi', 'ti', 1, 1)} / 100.0 END AS movmean FROM stack")
def movmean_time_strict(spark, sf_dir):
    return windows.moving_mean(event_stack(spark, sf_dir), ["xi"], "ti", "z", 3, strict=True, scale=100).select("xi", "ti", "movmean")


@query(f"WITH {STACK} SELECT xi, ti, CASE WHEN count(z) {_frame('ti', 'xi', 2, 2)} > 0 THEN CAST(sum(CAST(round(z * 100.0) AS BIGINT)) {_frame('ti', 'xi', 2, 2)} AS DOUBLE) / count(z) {_frame('ti', 'xi', 2, 2)} / 100.0 END AS movmean FROM stack")
def movmean_x(spark, sf_dir):
    return windows.moving_mean(event_stack(spark, sf_dir), ["ti"], "xi", "z", 5, scale=100).select("xi", "ti", "movmean")


@query(f"WITH {STACK}, m AS (SELECT xi, ti, z, list(z) FILTER (z IS NOT NULL) {_frame('xi', 'ti', 1, 1)} AS l, row_number() OVER (PARTITION BY xi ORDER BY ti) AS i, count(*) OVER (PARTITION BY xi) AS n FROM stack) SELECT xi, ti, CASE WHEN i > 2 AND i < n THEN {MIDDLE.format('l')} ELSE z END AS median3 FROM m")
def median3(spark, sf_dir):
    return windows.median3_interior(event_stack(spark, sf_dir), ["xi"], "ti", "z").select("xi", "ti", "median3")


@query(f"WITH {STACK}, m AS (SELECT xi, ti, list(z) FILTER (z IS NOT NULL) {_frame('ti', 'xi', 2, 2)} AS l, count(*) {_frame('ti', 'xi', 2, 2)} AS n FROM (SELECT xi, ti, coalesce(z, CASE WHEN xi % 3 > 0 THEN 50.0 END) AS z FROM stack)) SELECT xi, ti, CASE WHEN len(l) = n THEN list_sort(list_concat(l, list_transform(range(n, 5), lambda k: 0.0::DOUBLE)))[3] END AS medfilt FROM m")
def medfilt5_zeropad(spark, sf_dir):
    s = event_stack(spark, sf_dir).withColumn("z", F.coalesce("z", F.when(F.col("xi") % 3 > 0, F.lit(50.0))))
    return windows.zero_padded_median(s, ["ti"], "xi", "z", 5).select("xi", "ti", "medfilt")


@query(f"WITH {STACK}, m AS (SELECT xi, ti, list(z) FILTER (z IS NOT NULL) {_frame('xi', 'ti', 1, 0)} AS l FROM stack) SELECT xi, ti, {MIDDLE.format('l')} AS median FROM m")
def medfilt2_time(spark, sf_dir):
    return windows.moving_median(event_stack(spark, sf_dir), ["xi"], "ti", "z", 1, 0).select("xi", "ti", "median")


@query(f"WITH {STACK}, m AS (SELECT ti, min(z) {_frame('ti', 'xi', 10, 9)} AS m FROM stack WHERE xi >= 20) SELECT ti, max(m) AS level FROM m GROUP BY ti")
def offshore_level(spark, sf_dir):
    """The water level seaward of a node: a moving minimum along x."""
    own = event_stack(spark, sf_dir).where("xi >= 20")
    return windows.moving_min(own, ["ti"], "xi", "z", 20).groupBy("ti").agg(F.max("movmin").alias("level"))


# Stencils


def _conv(kernel: list[list[int]], name: str) -> str:
    """By joins on integer offsets: the plain definition."""
    terms, joins = [], []
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            w = kernel[1 + a][1 + b]
            if w:
                k = f"n{a + 1}{b + 1}"
                joins.append(f"LEFT JOIN stack {k} ON {k}.xi = s.xi - ({a}) AND {k}.ti = s.ti - ({b})")
                terms.append(f"CASE WHEN {k}.xi IS NULL THEN 0.0 ELSE {k}.z END * ({w}.0)")
    return f"SELECT s.xi, s.ti, {' + '.join(terms)} AS {name} FROM stack s {' '.join(joins)}"


#: A stack whose gaps are filled but for some nodes, so that missing values meet the stencils.
FULL = STACK.replace("m.z FROM", "coalesce(m.z, CASE WHEN (a.xi + b.ti) % 7 > 0 THEN 40.0 END) AS z FROM")


def full_stack(spark, sf_dir):
    return event_stack(spark, sf_dir).withColumn("z", F.coalesce("z", F.when((F.col("xi") + F.col("ti")) % 7 > 0, F.lit(40.0))))


@query(f"WITH {FULL}, a AS ({_conv(stencil.SOBEL_X, 'gx')}), b AS ({_conv(stencil.SOBEL_T, 'gt')}) SELECT a.xi, a.ti, gx, gt FROM a JOIN b ON a.xi = b.xi AND a.ti = b.ti")
def conv_sobel(spark, sf_dir):
    return stencil.convolve(full_stack(spark, sf_dir), [], "xi", "ti", "z", {"gx": stencil.SOBEL_X, "gt": stencil.SOBEL_T}).select("xi", "ti", "gx", "gt")


@query(f"WITH {FULL} {_conv(stencil.LAPLACIAN, 'lap')}")
def conv_laplacian(spark, sf_dir):
    return stencil.convolve(full_stack(spark, sf_dir), [], "xi", "ti", "z", {"lap": stencil.LAPLACIAN}).select("xi", "ti", "lap")


def _near(nx: int, nt: int) -> tuple[int, int, int, int]:
    return ((nx - 1) // 2 if nx % 2 else nx // 2 - 1), nx // 2, ((nt - 1) // 2 if nt % 2 else nt // 2 - 1), nt // 2


_BX, _AX, _BT, _AT = _near(3, 2)


@query(
    f"WITH {STACK}, m AS (SELECT s.xi, s.ti, any_value(s.z) AS z, list(n.z) FILTER (n.z IS NOT NULL) AS l, count(*) AS c FROM stack s JOIN stack n ON n.xi BETWEEN s.xi - {_BX} AND s.xi + {_AX} AND n.ti BETWEEN s.ti - {_BT} AND s.ti + {_AT} GROUP BY s.xi, s.ti), p AS (SELECT xi, ti, z, list_concat(l, list_transform(range(c, 6), lambda k: 0.0::DOUBLE)) AS l FROM m) SELECT xi, ti, CASE WHEN z IS NOT NULL THEN {MIDDLE.format('l')} END AS med2d FROM p"
)
def medfilt2d(spark, sf_dir):
    return stencil.median2d(event_stack(spark, sf_dir), [], "xi", "ti", "z", 3, 2).select("xi", "ti", "med2d")


@query(f"WITH {STACK}, m AS (SELECT xi, ti, coalesce(z > 400, false) AS mask FROM stack) SELECT s.xi, s.ti, bool_or(n.mask) AS dilated FROM m s JOIN m n ON n.xi BETWEEN s.xi - 3 AND s.xi + 2 AND n.ti BETWEEN s.ti - 1 AND s.ti GROUP BY s.xi, s.ti")
def dilate(spark, sf_dir):
    s = event_stack(spark, sf_dir).withColumn("mask", F.col("z") > 400)
    return stencil.dilate(s, [], "xi", "ti", "mask").select("xi", "ti", "dilated")


_D = f"""fl AS (SELECT *, min(z) {_frame('xi', 'ti', 6, 5)} AS fl FROM stack),
ba AS (SELECT *, CASE WHEN count(fl) {_frame('xi', 'ti', 6, 5)} = count(*) {_frame('xi', 'ti', 6, 5)} THEN CAST(sum(CAST(round(fl * 100.0) AS BIGINT)) {_frame('xi', 'ti', 6, 5)} AS DOUBLE) / count(fl) {_frame('xi', 'ti', 6, 5)} / 100.0 END AS ba FROM fl),
d AS (SELECT xi, ti, z - ba AS d FROM ba),
ml AS (SELECT *, list(d) FILTER (d IS NOT NULL) {_frame('xi', 'ti', 0, 1)} AS l, count(*) {_frame('xi', 'ti', 0, 1)} AS c FROM d),
mp AS (SELECT xi, ti, d, list_concat(l, list_transform(range(c, 2), lambda k: 0.0::DOUBLE)) AS l FROM ml),
f AS (SELECT xi, ti, CASE WHEN d IS NOT NULL THEN {MIDDLE.format('l')} END AS z FROM mp)"""


def _conv_of(table: str, kernel, name: str) -> str:
    return _conv(kernel, name).replace("stack ", f"{table} ")


_OUT = f"""WITH {FULL}, {_D}, gx AS ({_conv_of('f', stencil.SOBEL_X, 'v')}), gt AS ({_conv_of('f', stencil.SOBEL_T, 'v')}), lp AS ({_conv_of('f', stencil.LAPLACIAN, 'v')}),
g AS (SELECT gx.xi, gx.ti, sqrt(gx.v * gx.v + gt.v * gt.v) AS grad, lp.v AS lap FROM gx JOIN gt ON gx.xi = gt.xi AND gx.ti = gt.ti JOIN lp ON gx.xi = lp.xi AND gx.ti = lp.ti),
i AS (SELECT CAST(round(grad * 1000000.0) AS BIGINT) AS g, CAST(round(lap * 1000000.0) AS BIGINT) AS l FROM g),
s AS (SELECT count(g) AS ng, CAST(sum(g) AS DOUBLE) AS g1, CAST(sum(CAST(g AS HUGEINT) * g) AS DOUBLE) AS g2, count(l) AS nl, CAST(sum(abs(l)) AS DOUBLE) AS a1, CAST(sum(l) AS DOUBLE) AS l1, CAST(sum(CAST(l AS HUGEINT) * l) AS DOUBLE) AS l2 FROM i),
lim AS (SELECT g1 / ng / 1000000.0 + 2.5 * (sqrt(greatest(0.0, (g2 - g1 * g1 / ng) / (ng - 1))) / 1000000.0) AS gl, a1 / nl / 1000000.0 + 2.5 * (sqrt(greatest(0.0, (l2 - l1 * l1 / nl) / (nl - 1))) / 1000000.0) AS ll FROM s),
raw AS (SELECT xi, ti, coalesce(grad > gl AND abs(lap) > ll, false) AS raw FROM g, lim)
SELECT s.xi, s.ti, any_value(s.raw) AS raw, bool_or(n.raw) AS masked FROM raw s JOIN raw n ON n.xi BETWEEN s.xi - 3 AND s.xi + 2 AND n.ti BETWEEN s.ti - 1 AND s.ti GROUP BY s.xi, s.ti"""


@query(_OUT)
def outlier_mask(spark, sf_dir):
    return stencil.outlier_mask(full_stack(spark, sf_dir), [], "xi", "ti", "z", window=12, mean_scale=100).select("xi", "ti", "raw", "masked")


# Contours and masks

_CONTOUR = f"""WITH {STACK}, v AS (SELECT unnest([100.0::DOUBLE, 200.0::DOUBLE, 300.0::DOUBLE]) AS threshold), r AS (SELECT threshold, ti, xi, sign(z - threshold) AS s FROM stack, v WHERE z IS NOT NULL),
l AS (SELECT *, lead(s) OVER (PARTITION BY threshold, ti ORDER BY xi) AS nx FROM r), c AS (SELECT threshold, ti, CASE WHEN count(*) >= 3 THEN max(CASE WHEN nx <> s THEN xi END) END AS xi FROM l GROUP BY threshold, ti),
contour AS (SELECT v.threshold, t.ti, c.xi FROM v CROSS JOIN (SELECT DISTINCT ti FROM stack) t LEFT JOIN c ON c.threshold = v.threshold AND c.ti = t.ti)"""


@query(f"{_CONTOUR} SELECT threshold, ti, xi FROM contour")
def contour_seaward(spark, sf_dir):
    return contours.seaward_contour(event_stack(spark, sf_dir), [], "ti", "xi", "z", LEVELS).select("threshold", "ti", "xi")


@query(
    f"{_CONTOUR}, s AS (SELECT threshold, count(*) AS n, count(xi) AS nv, CAST(sum(CAST(xi AS BIGINT) * 1000) AS DOUBLE) AS s1, CAST(sum(CAST(xi AS HUGEINT) * 1000 * xi * 1000) AS DOUBLE) AS s2, min(xi) AS least, max(xi) AS most FROM contour GROUP BY threshold) SELECT threshold, CASE WHEN nv > 0 THEN s1 / nv / 1000.0 END AS mean, CASE WHEN nv > 1 THEN sqrt(greatest(0.0, (s2 - s1 * s1 / nv) / (nv - 1))) / 1000.0 WHEN nv = 1 THEN 0.0 END AS std, least, most, CAST(nv AS DOUBLE) / n AS valid FROM s"
)
def contour_stats(spark, sf_dir):
    c = contours.seaward_contour(event_stack(spark, sf_dir), [], "ti", "xi", "z", LEVELS)
    return contours.contour_stats(c, ["threshold"], "xi")


@query(f"WITH {STACK} SELECT xi, ti, CASE WHEN NOT (xi BETWEEN 3 AND 5 OR xi BETWEEN 20 AND 30 OR xi BETWEEN 77 AND 78) THEN z END AS z FROM stack")
def flag_mask(spark, sf_dir):
    return contours.flag_intervals(event_stack(spark, sf_dir), "xi", [(3, 5), (20, 30), (77, 78)], ["z"]).select("xi", "ti", "z")


@query(f"WITH {STACK} SELECT xi, ti, CASE WHEN xi > CASE WHEN ti % 2 = 0 THEN 60.5 ELSE 10.5 END AND CASE WHEN ti % 2 = 0 THEN 60.5 ELSE 10.5 END > 20 THEN NULL ELSE z END AS z FROM stack")
def offshore_mask(spark, sf_dir):
    s = event_stack(spark, sf_dir)
    mean = s.select("ti").distinct().withColumn("mean_x", F.when(F.col("ti") % 2 == 0, 60.5).otherwise(10.5))
    return contours.offshore_mask(s, ["ti"], mean, "xi", "z").select("xi", "ti", "z")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN i <= 30 THEN z END AS z FROM ({POINTS})")
def intensity_mask(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", contours.intensity_mask("z", "i").alias("z"))


@query(f"WITH {STACK}, l AS (SELECT xi, ti, z, lead(xi) OVER (PARTITION BY ti ORDER BY xi) AS x1, lead(z) OVER (PARTITION BY ti ORDER BY xi) AS z1 FROM means) SELECT DISTINCT ti, xi + (x1 - xi) * ((z - 150.0) / ((z - 150.0) - (z1 - 150.0))) AS xc FROM l WHERE z <> z1 AND (z - 150.0) * (z1 - 150.0) <= 0")
def curve_crossings(spark, sf_dir):
    s = event_stack(spark, sf_dir).where("z is not null")
    return contours.crossings(s, ["ti"], "xi", "z", F.lit(150.0))


_CROSSED = f"WITH {STACK}, l AS (SELECT xi, ti, z, lead(xi) OVER (PARTITION BY ti ORDER BY xi) AS x1, lead(z) OVER (PARTITION BY ti ORDER BY xi) AS z1 FROM means), c AS (SELECT ti, CAST(round(max(xi + (x1 - xi) * ((z - 150.0) / ((z - 150.0) - (z1 - 150.0)))) * 1000000.0) AS BIGINT) AS c FROM l WHERE z <> z1 AND (z - 150.0) * (z1 - 150.0) <= 0 GROUP BY ti)"


@query(f"{_CROSSED} SELECT ti, CAST(sum(c) OVER (ORDER BY ti ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) / count(c) OVER (ORDER BY ti ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 1000000.0 AS xi FROM c")
def contour_smooth(spark, sf_dir):
    s = event_stack(spark, sf_dir).withColumn("scan", F.lit(0))
    return contours.smooth_contour(s, ["scan"], "ti", "xi", "z", 150.0).select("ti", "xi")


@query(f"WITH {STACK}, s AS (SELECT xi, ti, sign(z - lag(z) OVER (PARTITION BY xi ORDER BY ti)) AS s FROM means), c AS (SELECT xi, s <> lag(s) OVER (PARTITION BY xi ORDER BY ti) AS c FROM s WHERE s IS NOT NULL) SELECT xi, CAST(count(*) FILTER (c) AS BIGINT) AS turns FROM c GROUP BY xi")
def sign_changes(spark, sf_dir):
    """How often a node's series turns."""
    from pyspark.sql import Window

    w = Window.partitionBy("xi").orderBy("ti")
    s = event_stack(spark, sf_dir).where("z is not null").withColumn("s", F.signum(F.col("z") - F.lag("z").over(w))).where("s is not null")
    return s.withColumn("c", F.lag("s").over(w) != F.col("s")).groupBy("xi").agg(F.count(F.when(F.col("c"), 1)).alias("turns"))


# Numpy operators, and whole plans


def hourly(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.floor(times.micros("ts") / F.lit(3_600_000_000)).cast("long").alias("ti"), "value")
    return stack.regular_axis(stack.stack_mean(e, ["event_type", "ti"], "value", 100), "ti", 1, ["event_type"])


@query()
def inpaint_1d(spark, sf_dir):
    return inpaint.inpaint_column(event_stack(spark, sf_dir), ["xi"], "ti", "z")


@query()
def inpaint_2d(spark, sf_dir):
    """Each of the methods for grids, on the whole stack in scans of 40 steps."""
    from functools import reduce

    s = full_stack(spark, sf_dir).withColumn("scan", F.floor(F.col("ti") / 40)).select("scan", "xi", "ti", "z")
    each = [inpaint.inpaint_grid(s, ["scan"], "xi", "ti", "z", m).select(F.lit(m).alias("method"), "scan", "xi", "ti", "inpainted") for m in inpaint.METHODS]
    return reduce(DataFrame.union, each)


@query()
def spectrum_welch(spark, sf_dir):
    return spectral.spectrum(hourly(spark, sf_dir), ["event_type"], "ti", "z", dt=0.5, window_minutes=0.5)


@query()
def wave_bulk(spark, sf_dir):
    return spectral.wave_bulk(spectral.spectrum(hourly(spark, sf_dir), ["event_type"], "ti", "z", dt=0.5, window_minutes=2), ["event_type"])


def beach(spark, sf_dir) -> DataFrame:
    """(scan, x, ti, z): a plane beach under a sheet of water whose edge moves with each hour's events."""
    moves = inpaint.inpaint_column(hourly(spark, sf_dir), ["event_type"], "ti", "z", "m").select(F.col("event_type").alias("scan"), "ti", "m").where("m is not null")
    nodes = moves.withColumn("xi", F.explode(F.sequence(F.lit(0), F.lit(160)))).withColumn("x", F.col("xi") * 0.25)
    sand = 4.0 - 0.1 * F.col("x")
    water = F.when(F.col("x") >= 20 + F.col("m") / 100, F.lit(0.3)).otherwise(0.0)
    return nodes.select("scan", "ti", "x", (sand + water).alias("z"), sand.alias("sand"))


@query()
def runup_track(spark, sf_dir):
    return runup.runup(beach(spark, sf_dir), ["scan"], dt=0.5, threshold=0.1, x_off=40.0)


@query()
def dry_beach(spark, sf_dir):
    return runup.dry_beach(beach(spark, sf_dir), ["scan"], "x", "ti", "z", 120, 100).groupBy("scan", "x").agg(F.min("sand").alias("low"), F.max("sand").alias("high"))


@query()
def foreshore_slope(spark, sf_dir):
    own = beach(spark, sf_dir).groupBy("scan", "x").agg(F.min("z").alias("z"), F.var_samp("sand").alias("v"))
    return profiles.foreshore_slope(own.withColumn("lo", F.lit(0.5)).withColumn("hi", F.lit(3.5)), ["scan"], "x", "z", "v", "lo", "hi", 40.0)


@query()
def l1_surfaces(spark, sf_dir):
    """Points to surfaces, on points of the tables squeezed to a beach's size."""
    p = points(spark, sf_dir).select((F.col("i").cast("int") % 2).cast("string").alias("scan_id"), F.col("l_orderkey").alias("pidx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (2 + F.col("x") / 1000 + F.col("z") % 1 / 100).alias("z"), F.lit(20.0).alias("intensity"), (1.3e9 + F.col("l_linenumber") * 10).alias("gps_s"))
    o = pipelines.L1([[0.01, 0, 0, 0], [0, 0.01, 0, 0], [0, 0, 1.0, 0]], [(0.0, 0.0), (20.0, 0.0), (20.0, 1.0), (0.0, 1.0)], cell=0.1, least_n=1, least_snr=10.0, passes=((10.0, 0.5),))
    return pipelines.l1_surfaces(p, o)


def squeezed(spark, sf_dir) -> DataFrame:
    """Points of the tables as scans of a beach 100 m long."""
    p = points(spark, sf_dir)
    return p.select((F.col("i").cast("int") % 2).cast("string").alias("scan_id"), F.col("l_orderkey").alias("pidx"), (F.col("x").cast("double") % 100).alias("x"), (F.col("y") % 3).cast("double").alias("y"), (2 - F.col("x") % 100 / 60 + F.col("z") % 1 / 20).alias("z"), (F.col("i") * 2).alias("intensity"), (1.3e9 + F.col("l_orderkey") % 40 * 0.5).alias("gps_s"))


@query()
def l2_products(spark, sf_dir):
    """Points to stacks, cleaned stacks and their products: one row a kind and scan with what it holds."""
    o = pipelines.L2([[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]], [(-1.0, -1.0), (101.0, -1.0), (101.0, 4.0), (-1.0, 4.0)], geometry.Transect(0.0, 1.0, 100.0, 1.0, 0.5), most_intensity=1000.0, minutes=0.1)
    clean = held(pipelines.l2_cleaned(held(pipelines.l2_stack(squeezed(spark, sf_dir), o), "stack"), o), "clean")
    found = {"stack": clean.groupBy("scan_id").agg(F.count("*").alias("n_rows"))} | {k: v.groupBy("scan_id").agg(F.count("*").alias("n_rows")) for k, v in pipelines.l2_products(clean, o).items()}
    out = None
    for kind, rows in found.items():
        own = rows.select(F.lit(kind).alias("kind"), "scan_id", "n_rows")
        out = own if out is None else out.union(own)
    return out


@query()
def l1_profiles(spark, sf_dir):
    """The plot's profiles: every second scan and the last, the fifth transect up to 50 m."""
    p = squeezed(spark, sf_dir).withColumn("scan_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pidx") % 7 * 1800).cast("timestamp_ntz"))
    scans = p.select("scan_ts").distinct().union(spark.range(1).select(F.lit("2023-11-15 12:00:00").cast("timestamp_ntz")))
    shown = profiles.shown_profiles(scans, p.select("scan_ts", "x", "y", "z"), "scan_ts", geometry.Transect(0.0, 1.0, 100.0, 1.0, 0.5), "x", "y", "z", n=2)
    return shown.select(times.date_text("scan_ts").alias("dates"), "last", F.size("x").alias("n"), F.array_max("x").alias("far"), F.expr("size(filter(z, v -> v is not null))").alias("measured"))


@query("SELECT event_id, CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%d-%b-%Y') ELSE strftime(ts, '%d-%b-%Y %H:%M:%S') END AS text FROM events")
def date_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", times.date_text("ts").alias("text"))


@query()
def runup_bulk(spark, sf_dir):
    """From stack to wave heights: tracker, spectrum, bulk, mean level."""
    r = runup_track(spark, sf_dir)
    bulk = spectral.wave_bulk(spectral.spectrum(r, ["scan"], "ti", "z_filled", 0.5, 2), ["scan"])
    return bulk.join(runup.eta(r, ["scan"], "z_runup"), "scan")


@query(
    """WITH m AS (SELECT event_type, hour(ts) AS h, CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS mean FROM events GROUP BY 1, 2)
SELECT event_type AS dates, CAST(h AS DOUBLE) AS x, mean AS z, CASE WHEN event_type = 'view' THEN '[0.0,0.5,1.0]' ELSE '[0.6,0.6,0.6]' END AS color FROM m"""
)
def plot_document(spark, sf_dir):
    m = raster.moments(read(spark, sf_dir, "events").withColumn("h", F.hour("ts")), ["event_type", "h"], "value", 100)
    p = m.groupBy("event_type").agg(F.array_sort(F.collect_list("h")).alias("x"), F.transform(F.array_sort(F.collect_list(F.struct("h", "mean"))), lambda s: s["mean"]).alias("z"))
    rows = p.withColumn("last", F.col("event_type") == F.lit("view"))
    d = profiles.plot_document(rows, "event_type", "x", "z", "event_type")
    # Read back from the text: one row a point.
    held = d.select(F.explode(F.from_json("document", "profiles array<struct<dates: string, x: array<double>, z: array<double>, color: array<double>>>")["profiles"]).alias("p"))
    return held.select("p.dates", F.to_json("p.color").alias("color"), F.explode(F.arrays_zip("p.x", "p.z")).alias("a")).select("dates", "a.x", "a.z", "color")


# Streams: a whole table goes through a stream once; late rows are kept by a wide watermark.


def event_stream(spark, sf_dir) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir)


@query("SELECT event_type, make_timestamp(CAST(floor(epoch_us(ts) / 1800000000.0) AS BIGINT) * 1800000000) AS start, min(value) AS least, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_min(spark, sf_dir):
    out = streams.tumbling_min(event_stream(spark, sf_dir), "ts", ["event_type"], "value", late="400 days")
    return streams.drained(out, scratch(spark, "tumbling"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type")
def stream_dedup(spark, sf_dir):
    out = streams.first_per_key(event_stream(spark, sf_dir), "ts", ["event_type", "user_id"], late="400 days")
    return streams.drained(out, scratch(spark, "dedup")).groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def stream_stateful_track(spark, sf_dir):
    """The tracker's state in a stream gives what the batch operator gives."""
    b = beach(spark, sf_dir)
    rows = b.groupBy(F.col("scan").alias("scan_id"), "ti").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", (F.col("z") - F.col("sand")).alias("d")))), lambda s: s["d"]).alias("depth"))
    folder = scratch(spark, "depths")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    return streams.drained(streams.track(stream, 0.0, 0.25, 40.0), scratch(spark, "track"))


__all__ = ["ORACLE_SQL", "QUERIES", "basic"]
