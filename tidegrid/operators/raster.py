"""Statistics of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.basic import cell, col, exact, mean_of, std_of


def gridded(df: DataFrame, x: str, y: str, dx: float, dy: float) -> DataFrame:
    """Adds the integer cell (xi, yi)."""
    return df.withColumn("xi", cell(x, dx)).withColumn("yi", cell(y, dy))


def signal_to_noise(mean: Column, std: Column, n: Column) -> Column:
    """mean / (std / sqrt(n)); without spread it is infinite with the mean's sign, and null for a zero mean."""
    inf = F.lit(float("inf"))
    return F.when(std > 0, mean / (std / F.sqrt(n.cast("double")))).when(mean > 0, inf).when(mean < 0, -inf)


def lower_half_stats(df: DataFrame, keys: list[str], value: str, least_n: int = 10, least_snr: float = 100.0, scale: int = 1000, true_max: bool = False) -> DataFrame:
    """(keys, zmean, zmax, zmin, zmode, zstd, n) of each cell's values up to its median.

    Cells with ``least_n`` values or fewer, or a signal-to-noise ratio below
    ``least_snr``, are dropped; a cell without spread stays if its mean is
    positive or zero. zmax is the mean too, as users of these surfaces know
    it, unless ``true_max``. The mode of tied values is the smallest. Moments
    are sums of whole numbers of 1/scale, so they do not depend on order.
    One shuffle by cell: the values are ranked there, in a sort that can
    spill, and those up to the lower of the two middle ones are what is not
    above the median.
    """
    rows = df.select(*keys, col(value).alias("_v"), exact(value, scale).alias("_c"))
    cells = Window.partitionBy(*keys)
    ranked = rows.where("_v is not null").withColumn("_i", F.row_number().over(cells.orderBy("_v"))).withColumn("_n", F.count("*").over(cells))
    middle = F.max(F.when(F.col("_i") == F.floor((F.col("_n") + 1) / 2), F.col("_v"))).over(cells)
    low = ranked.withColumn("_m", middle).where("_v <= _m")
    sums = low.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("_c").alias("_s"),
        F.sum(F.col("_c").cast("decimal(20,0)") * F.col("_c").cast("decimal(18,0)")).alias("_q"),
        F.min("_v").alias("zmin"),
        F.max("_v").alias("_top"),
        F.mode("_v", True).alias("zmode"),
    )
    n = F.col("n")
    out = sums.withColumn("zmean", mean_of(F.col("_s"), n, scale)).withColumn("zstd", std_of(F.col("_s"), F.col("_q"), n, scale))
    snr = signal_to_noise(F.col("zmean"), F.col("zstd"), n)
    kept = out.where((n > least_n) & (snr.isNull() | (snr >= least_snr)))
    return kept.select(*keys, "zmean", (F.col("_top") if true_max else F.col("zmean")).alias("zmax"), "zmin", "zmode", "zstd", "n")


def prctile(df: DataFrame, keys: list[str], value: str, p: float, name: str = "p") -> DataFrame:
    """Percentile by the midpoint rule: the i-th of n sorted values stands at 100 (i - 0.5) / n, between them is linear."""
    rows = df.where(col(value).isNotNull()).select(*keys, col(value).alias("_v"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    at = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.col("_n") * F.lit(p / 100) + 0.5))
    near = ranked.withColumn("_at", at).where((F.col("_i") == F.floor("_at")) | (F.col("_i") == F.ceil("_at")))
    low, high = F.min("_v"), F.max("_v")
    return near.groupBy(*keys).agg((low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias(name))


def cell_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each cell, the smallest of tied ones."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias("mode"))


def cell_lists(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each cell's points as one sorted array: for cells of bounded size."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("points"), F.count("*").alias("n"))


def by_cell(df: DataFrame, x: str = "xi", y: str = "yi") -> DataFrame:
    """Points in the order of their cells, x outer and y inner, as a sort over ranges."""
    return df.orderBy(x, y)


def occupied_cells(df: DataFrame, x: str = "xi", y: str = "yi") -> DataFrame:
    """How many cells hold a point: one row."""
    return df.select(x, y).distinct().agg(F.count("*").alias("n_cells"))


def moments(df: DataFrame, keys: list[str], value: str, scale: int = 1000) -> DataFrame:
    """(keys, n, total, mean, variance, std) of the non-null values, from sums of whole numbers."""
    c = exact(value, scale)
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(c).alias("_s"), F.sum(c.cast("decimal(20,0)") * c.cast("decimal(18,0)")).alias("_q"))
    n = F.col("n")
    std = F.when(n > 0, std_of(F.col("_s"), F.col("_q"), n, scale))
    return sums.select(*keys, "n", (F.col("_s").cast("double") / float(scale)).alias("total"), F.when(n > 0, mean_of(F.col("_s"), n, scale)).alias("mean"), (std * std).alias("variance"), std.alias("std"))
