"""Dense space-time stacks and their re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.basic import exact, mean_of


def stack_mean(df: DataFrame, keys: list[str], value: str, scale: int | None = None, name: str = "z") -> DataFrame:
    """Mean of the non-null values of each (scan, tick, node). Values known to be whole numbers of 1/scale have exact sums."""
    if scale is None:
        return df.groupBy(*keys).agg(F.avg(value).alias(name))
    sums = df.groupBy(*keys).agg(F.sum(exact(value, scale)).alias("_s"), F.count(value).alias("_n"))
    return sums.select(*keys, F.when(F.col("_n") > 0, mean_of(F.col("_s"), F.col("_n"), scale)).alias(name))


def spine(df: DataFrame, x: str = "xi", t: str = "ti", scan: list[str] | None = None) -> DataFrame:
    """Every node at every tick that a scan has: rows where nothing was measured are null.

    Nodes and ticks of one scan are joined by its key; without one they are
    two short lists of distinct values.
    """
    scan = scan or []
    nodes, ticks = df.select(*scan, x).distinct(), df.select(*scan, t).distinct()
    grid = nodes.join(ticks, scan) if scan else nodes.crossJoin(ticks)
    return grid.join(df, [*scan, x, t], "left")


def regular_axis(df: DataFrame, t: str, step: int, keys: list[str]) -> DataFrame:
    """Each key's rows on every step from its first to its last tick; missing steps are null."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    axis = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias(t))
    return axis.join(df, [*keys, t], "left")


def at_index(df: DataFrame, index: DataFrame, keys: list[str], x: str = "xi") -> DataFrame:
    """Rows of a stack at one node a tick, by an equi-join."""
    return index.join(df, [*keys, x], "left")


def nearest_index(position: str, first: float, last: float, step: float):
    """Index of the grid node nearest to a position; a null position, or one not above the first node, gives the last index."""
    n = int(round((last - first) / step)) + 1
    p = F.col(position)
    at = F.round((F.round(p, 1) - F.lit(first)) / F.lit(step)).cast("int")
    return F.when(p.isNull() | (p <= first), F.lit(n - 1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(n - 1), at)))


def change(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Last minus first non-null value along time."""
    there = df.where(F.col(value).isNotNull())
    return there.groupBy(*keys).agg((F.max_by(value, t) - F.min_by(value, t)).alias("change"))


def anomaly(df: DataFrame, keys: list[str], t: str, value: str, first: int, scale: int | None = None) -> DataFrame:
    """Difference of each value from the mean of its node's first steps; scale as in ``stack_mean``."""
    means = stack_mean(df.where(F.col(t) < first), keys, value, scale, "_m")
    return df.join(means, keys, "left").withColumn("anomaly", F.col(value) - F.col("_m")).drop("_m")
