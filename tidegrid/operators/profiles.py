"""Profiles along transects, and fits to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.basic import exact
from tidegrid.operators.gaps import fill_small
from tidegrid.operators.geometry import Transect


def power_sums(df: DataFrame, keys: list[str], x: str, z: str, sx: int, sz: int) -> DataFrame:
    """Sums of x^0..x^4 and z x^0..x^2 of whole numbers of 1/sx and 1/sz, as exact decimals."""
    u, v = exact(x, sx).cast("decimal(18,0)"), exact(z, sz).cast("decimal(18,0)")

    def up(c, n):
        out = c
        for _ in range(n - 1):
            out = (out * u).cast("decimal(38,0)")
        return out

    sums = [F.sum(up(u, k)).cast("decimal(38,0)").alias(f"x{k}") for k in (1, 2, 3, 4)]
    sums += [F.sum(v).cast("decimal(38,0)").alias("z0"), F.sum((v * u).cast("decimal(38,0)")).cast("decimal(38,0)").alias("z1"), F.sum(((v * u).cast("decimal(38,0)") * u).cast("decimal(38,0)")).cast("decimal(38,0)").alias("z2")]
    return df.where(F.col(x).isNotNull() & F.col(z).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(x).alias("nx"), *sums)


def quadratic_fit(df: DataFrame, keys: list[str], x: str, z: str, sx: int | None = None, sz: int | None = None) -> DataFrame:
    """(keys, c0, c1, c2, n): least squares z = c0 + c1 x + c2 x^2; null with fewer than 3 distinct x.

    Nothing is rounded: moments of doubles, x counted from the group's least
    one. Where x and z are known to be whole numbers of 1/sx and 1/sz, these
    scales give exact sums, which do not depend on the order of rows.
    """
    if sx is None or sz is None:
        return quadratic_by_moments(df, keys, x, z)
    s = power_sums(df, keys, x, z, sx, sz)
    d = lambda c: F.col(c).cast("double")
    n, a, b, c, e, p, q, r = d("n"), d("x1"), d("x2"), d("x3"), d("x4"), d("z0"), d("z1"), d("z2")
    det = n * (b * e - c * c) - a * (a * e - b * c) + b * (a * c - b * b)
    d0 = p * (b * e - c * c) - a * (q * e - r * c) + b * (q * c - r * b)
    d1 = n * (q * e - r * c) - p * (a * e - b * c) + b * (a * r - b * q)
    d2 = n * (b * r - c * q) - a * (a * r - b * q) + p * (a * c - b * b)
    ok = (F.col("nx") >= 3) & (det != 0)
    return s.select(
        *keys,
        F.when(ok, d0 / det / float(sz)).alias("c0"),
        F.when(ok, d1 / det / float(sz) * float(sx)).alias("c1"),
        F.when(ok, d2 / det / float(sz) * float(sx * sx)).alias("c2"),
        "n",
    )


def quadratic_by_moments(df: DataFrame, keys: list[str], x: str, z: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(z).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(z).cast("double").alias("_z"))
    least = rows.groupBy(*keys).agg(F.min("_x").alias("_x0"))
    u = rows.join(least, keys).withColumn("_u", F.col("_x") - F.col("_x0")).withColumn("_w", F.col("_u") * F.col("_u"))
    cov = [F.covar_pop(a, b).alias(a + b) for a, b in (("_u", "_u"), ("_u", "_w"), ("_w", "_w"), ("_u", "_z"), ("_w", "_z"))]
    s = u.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("_x").alias("nx"), F.first("_x0").alias("_x0"), *[F.avg(c).alias(f"m{c}") for c in ("_u", "_w", "_z")], *cov)
    det = F.col("_u_u") * F.col("_w_w") - F.col("_u_w") * F.col("_u_w")
    ok = (F.col("nx") >= 3) & (det != 0)
    b = (F.col("_u_z") * F.col("_w_w") - F.col("_w_z") * F.col("_u_w")) / det
    c = (F.col("_w_z") * F.col("_u_u") - F.col("_u_z") * F.col("_u_w")) / det
    s = s.withColumn("_b", F.when(ok, b)).withColumn("_c", F.when(ok, c))
    a = F.col("m_z") - F.col("_b") * F.col("m_u") - F.col("_c") * F.col("m_w")
    x0 = F.col("_x0")
    return s.select(*keys, (a - F.col("_b") * x0 + F.col("_c") * x0 * x0).alias("c0"), (F.col("_b") - 2 * F.col("_c") * x0).alias("c1"), F.col("_c").alias("c2"), "n")


def drop_off_quadratic(df: DataFrame, keys: list[str], x: str, z: str, most: float = 0.4, sx: int | None = None, sz: int | None = None) -> DataFrame:
    """Points whose distance from their group's quadratic is below ``most``; groups without a fit keep all."""
    fit = quadratic_fit(df, keys, x, z, sx, sz).drop("n")
    rows = df.join(fit, keys)
    at = F.col("c0") + F.col("c1") * F.col(x) + F.col("c2") * F.col(x) * F.col(x)
    return rows.where(F.coalesce(F.abs(F.col(z) - at) < most, F.lit(True))).drop("c0", "c1", "c2")


def linear_fit(df: DataFrame, keys: list[str], x: str, z: str, more_than: int = 5, sx: int | None = None, sz: int | None = None) -> DataFrame:
    """(keys, slope, intercept, n): null unless there are more than ``more_than`` points of different x. Scales as in ``quadratic_fit``."""
    if sx is None or sz is None:
        rows = df.where(F.col(x).isNotNull() & F.col(z).isNotNull())
        s = rows.groupBy(*keys).agg(F.regr_slope(z, x).alias("_k"), F.regr_intercept(z, x).alias("_c"), F.count("*").alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        ok = (F.col("n") > more_than) & (F.col("_lo") < F.col("_hi"))
        return s.select(*keys, F.when(ok, F.col("_k")).alias("slope"), F.when(ok, F.col("_c")).alias("intercept"), "n")
    s = power_sums(df, keys, x, z, sx, sz)
    d = lambda c: F.col(c).cast("double")
    n, det = d("n"), d("n") * d("x2") - d("x1") * d("x1")
    ok = (F.col("n") > more_than) & (det != 0)
    slope = (n * d("z1") - d("x1") * d("z0")) / det
    return s.select(*keys, F.when(ok, slope / float(sz) * float(sx)).alias("slope"), F.when(ok, (d("z0") - slope * d("x1")) / n / float(sz)).alias("intercept"), "n")


def detrended(df: DataFrame, keys: list[str], x: str, z: str, name: str = "detrended", sx: int | None = None, sz: int | None = None) -> DataFrame:
    """z less its least-squares line over x; null for a group without one. Scales as in ``quadratic_fit``."""
    line = linear_fit(df, keys, x, z, 1, sx, sz).select(*keys, F.col("slope").alias("_k"), F.col("intercept").alias("_c"))
    return df.join(line, keys).withColumn(name, F.col(z) - F.col("_k") * F.col(x) - F.col("_c")).drop("_k", "_c")


def without_berm(df: DataFrame, keys: list[str], x: str, z: str, most: float = 0.1) -> DataFrame:
    """Where a profile rises more than ``most`` above the chord of its ends, only what lies seaward of its highest point above it stays."""
    ends = df.groupBy(*keys).agg(F.min(F.struct(x, z)).alias("_a"), F.max(F.struct(x, z)).alias("_b"))
    rows = df.join(ends, keys)
    a, b = F.col("_a"), F.col("_b")
    chord = a[z] + (b[z] - a[z]) * F.when(b[x] > a[x], (F.col(x) - a[x]) / (b[x] - a[x])).otherwise(F.lit(0.0))
    rows = rows.withColumn("_r", F.col(z) - chord)
    top = rows.groupBy(*keys).agg(F.max("_r").alias("_top"), F.max_by(x, "_r").alias("_at"))
    return rows.join(top, keys).where((F.col("_top") <= most) | (F.col(x) >= F.col("_at"))).select(*df.columns)


def foreshore_slope(df: DataFrame, keys: list[str], x: str, z: str, variance: str, low: str, high: str, x_off: float, most_variance: float = 0.2, first: float = 4.0, jump: float = 1.0) -> DataFrame:
    """(keys, slope, intercept, n) of the beach between the levels in the columns low and high.

    Nodes of little variance from ``first`` to ``x_off`` are used, up to the
    first jump in x, less the berm; too few of them give a null slope.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.where((F.col(variance) < most_variance) & F.col(x).between(first, x_off))
    rows = rows.withColumn("_d", F.col(x) - F.lag(x).over(w))
    rows = rows.withColumn("_j", F.sum(F.when(F.col("_d") > jump, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_j = 0").drop("_d", "_j")
    rows = rows.where(F.col(z).between(F.col(low), F.col(high)))
    return linear_fit(without_berm(rows, keys, x, z), keys, x, z)


def multi_transect(df: DataFrame, line: Transect, scan: list[str], x: str, y: str, z: str, offsets: list[float], tolerance: float = 1.0, most_gap: int = 4, off_curve: float = 0.4) -> DataFrame:
    """(scan, transect, xi, z) on every node: points near each of several parallel lines, less those off their quadratic, averaged by node, short gaps filled."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("transect"), F.lit(float(o)).alias("offset")) for i, o in enumerate(offsets)])).alias("_o")
    rows = df.select(*scan, line.along(x, y).alias("along"), line.across(x, y).alias("across"), F.col(z).alias("z"), sides)
    rows = rows.select(*scan, "_o.transect", "along", "z", (F.col("across") - F.col("_o.offset")).alias("off")).where(F.abs("off") <= tolerance)
    keys = [*scan, "transect"]
    kept = drop_off_quadratic(rows, keys, "along", "z", off_curve)
    means = kept.withColumn("xi", line.node(F.col("along"))).groupBy(*keys, "xi").agg(F.avg("z").alias("z"))
    nodes = means.select(*keys).distinct().withColumn("xi", F.explode(F.sequence(F.lit(0), F.lit(line.n_nodes - 1))))
    dense = nodes.join(means, [*keys, "xi"], "left")
    return fill_small(dense, keys, "xi", "z", most_gap, "filled").select(*keys, "xi", F.col("filled").alias("z"))


def every_nth_and_last(df: DataFrame, keys: list[str], order: str, n: int = 24) -> DataFrame:
    """From the newest back, every n-th row of each key, oldest first dropped until the count is a multiple of n; fewer than n rows give the last alone."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", total)
    usable = F.col("_n") - F.col("_n") % n
    kept = (F.col("_r") == 0) | ((F.col("_r") < usable) & ((usable - 1 - F.col("_r")) % n == 0))
    return rows.where(kept).withColumn("last", F.col("_r") == 0).drop("_r", "_n")


#: Parallel lines two metres apart, of which the fifth is shown, up to 50 m.
OFFSETS, SHOWN, MOST_X = tuple(float(o) for o in range(-8, 12, 2)), 5, 50.0


def shown_profiles(scans: DataFrame, surfaces: DataFrame, at: str, line: Transect, x: str, y: str, z: str, n: int = 24, offsets: tuple[float, ...] = OFFSETS, transect: int = SHOWN, most_x: float = MOST_X) -> DataFrame:
    """(at, last, x, z) of every n-th scan and the last, all scans counted: the profile along one transect, cropped. Scans without a surface are left out after that."""
    chosen = every_nth_and_last(scans.select(at).distinct().withColumn("_all", F.lit(0)), ["_all"], at, n).drop("_all")
    own = surfaces.join(chosen, at, "left_semi")
    nodes = multi_transect(own, line, [at], x, y, z, list(offsets)).where(F.col("transect") == transect - 1)
    placed = nodes.select(at, (F.col("xi") * F.lit(line.spacing)).alias("x"), "z").where(F.col("x") <= most_x)
    listed = placed.groupBy(at).agg(F.array_sort(F.collect_list(F.struct("x", "z"))).alias("_p"))
    return listed.join(chosen, at).select(at, "last", F.transform("_p", lambda p: p["x"]).alias("x"), F.transform("_p", lambda p: p["z"]).alias("z"))


def plot_document(profiles: DataFrame, order: str, x: str, z: str, label: str) -> DataFrame:
    """One JSON text: the profiles in order, grey but for the last, which is blue. For plots: few profiles."""
    color = F.when(F.col("last"), F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).otherwise(F.array(F.lit(0.6), F.lit(0.6), F.lit(0.6)))
    one = F.struct(F.col(label).alias("dates"), F.col(x).alias("x"), F.col(z).alias("z"), color.alias("color"))
    rows = profiles.select(F.col(order).alias("o"), one.alias("p"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("o", "p"))).alias("all"))
    return whole.select(F.to_json(F.struct(F.transform("all", lambda r: r["p"]).alias("profiles"))).alias("document"))
