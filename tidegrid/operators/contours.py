"""Threshold contours of a stack, and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.basic import exact, mean_of, std_of
from tidegrid.operators.windows import moving_mean


def seaward_contour(df: DataFrame, keys: list[str], t: str, x: str, value: str, thresholds: list[float], least: int = 3) -> DataFrame:
    """(keys, threshold, t, x) of every tick: the landward node of the last sign change of value - threshold along x.

    Null nodes are left out, ticks with fewer than ``least`` others have no
    contour, and a value on the threshold is a sign of its own.
    """
    every = df.select(*keys, t).distinct()
    levels = F.explode(F.array(*[F.lit(float(v)) for v in thresholds])).alias("threshold")
    rows = df.where(F.col(value).isNotNull()).select(*keys, t, x, value, levels)
    w = Window.partitionBy(*keys, "threshold", t).orderBy(x)
    sign = F.signum(F.col(value) - F.col("threshold"))
    rows = rows.withColumn("_s", sign).withColumn("_next", F.lead("_s").over(w))
    change = F.when(F.col("_next") != F.col("_s"), F.col(x))
    found = rows.groupBy(*keys, "threshold", t).agg(F.when(F.count("*") >= least, F.max(change)).alias(x))
    return every.select(*keys, t, levels).join(found, [*keys, "threshold", t], "left")


def contour_stats(df: DataFrame, keys: list[str], x: str, scale: int = 1000) -> DataFrame:
    """(keys, mean, std, least, most, valid): mean and deviation null and valid 0 where no tick has a contour."""
    c = exact(x, scale)
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(x).alias("nv"), F.sum(c).alias("s1"), F.sum(c.cast("decimal(20,0)") * c.cast("decimal(18,0)")).alias("s2"), F.min(x).alias("least"), F.max(x).alias("most"))
    nv = F.col("nv")
    return sums.select(*keys, F.when(nv > 0, mean_of(F.col("s1"), nv, scale)).alias("mean"), F.when(nv > 0, std_of(F.col("s1"), F.col("s2"), nv, scale)).alias("std"), "least", "most", (nv / F.col("n")).alias("valid"))


def in_intervals(x: str, intervals: list[tuple[float, float]]) -> Column:
    """Within any of some closed intervals."""
    return reduce(lambda a, b: a | b, [F.col(x).between(float(a), float(b)) for a, b in intervals])


def flag_intervals(df: DataFrame, x: str, intervals: list[tuple[float, float]], values: list[str]) -> DataFrame:
    return df.withColumns({v: F.when(~in_intervals(x, intervals), F.col(v)) for v in values})


def offshore_mask(df: DataFrame, keys: list[str], runup: DataFrame, x: str, value: str, least: float = 20.0) -> DataFrame:
    """Values seaward of a scan's mean runup (keys, mean_x) become null where that mean exceeds ``least``."""
    rows = df.join(runup, keys, "left")
    gone = (F.col("mean_x") > least) & (F.col(x) > F.col("mean_x"))
    return rows.withColumn(value, F.when(~F.coalesce(gone, F.lit(False)), F.col(value))).drop("mean_x")


def intensity_mask(z: str, intensity: str, most: float = 30.0) -> Column:
    """z where the return is not brighter than ``most``."""
    return F.when(F.coalesce(F.col(intensity) <= most, F.lit(True)), F.col(z))


def crossings(df: DataFrame, keys: list[str], x: str, value: str, level: Column) -> DataFrame:
    """Points (keys, xc) at which the polyline of value over x meets a level, ends included, flat segments excluded."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.withColumn("_x1", F.lead(x).over(w)).withColumn("_v1", F.lead(value).over(w))
    a, b = F.col(value) - level, F.col("_v1") - level
    met = rows.where((F.col(value) != F.col("_v1")) & (a * b <= 0))
    return met.select(*keys, (F.col(x) + (F.col("_x1") - F.col(x)) * (a / (a - b))).alias("xc")).distinct()


def smooth_contour(df: DataFrame, keys: list[str], t: str, x: str, value: str, level: float, size: int = 5) -> DataFrame:
    """(keys, t, x): the seaward-most crossing between nodes, interpolated, as a moving mean over ticks that have one."""
    found = crossings(df.where(F.col(value).isNotNull()), [*keys, t], x, value, F.lit(float(level)))
    last = found.groupBy(*keys, t).agg(F.max("xc").alias("_x"))
    return moving_mean(last, keys, t, "_x", size, scale=1_000_000, name=x).drop("_x")
