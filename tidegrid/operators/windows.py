"""Moving-window filters over dense rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.basic import exact, frame, mean_of, middle


def moving_min(df: DataFrame, keys: list[str], order: str, value: str, size: int, name: str = "movmin") -> DataFrame:
    """Nulls are skipped."""
    return df.withColumn(name, F.min(value).over(frame(keys, order, size)))


def moving_mean(df: DataFrame, keys: list[str], order: str, value: str, size: int, strict: bool = False, scale: int | None = None, name: str = "movmean") -> DataFrame:
    """Nulls are skipped, or with ``strict`` make the mean null. With a scale, sums are whole numbers of 1/scale."""
    w = frame(keys, order, size)
    n = F.count(value).over(w)
    mean = F.avg(value).over(w) if scale is None else mean_of(F.sum(exact(value, scale)).over(w), n, scale)
    ok = (n == F.count(F.lit(1)).over(w)) if strict else (n > 0)
    return df.withColumn(name, F.when(ok, mean))


def moving_median(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, name: str = "median") -> DataFrame:
    """Median of the non-null values from ``before`` rows back to ``after`` rows ahead, cut at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return df.withColumn(name, middle(F.collect_list(value).over(w)))


def median3_interior(df: DataFrame, keys: list[str], order: str, value: str, name: str = "median3") -> DataFrame:
    """Three-step centred median where a row and two before it exist and one behind; the value itself elsewhere."""
    w = Window.partitionBy(*keys).orderBy(order)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    m = middle(F.collect_list(value).over(w.rowsBetween(-1, 1)))
    return df.withColumn(name, F.when((i > 2) & (i < n), m).otherwise(F.col(value)))


def zero_padded_median(df: DataFrame, keys: list[str], order: str, value: str, size: int = 5, name: str = "medfilt") -> DataFrame:
    """Median of an odd window that is filled up with zeros at the ends; null if any of its values is."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size // 2), size // 2)
    found = F.collect_list(value).over(w)
    rows = F.count(F.lit(1)).over(w)
    padded = F.concat(found, F.array_repeat(F.lit(0.0), (F.lit(size) - rows).cast("int")))
    return df.withColumn(name, F.when(F.size(found) == rows, F.get(F.array_sort(padded), F.lit(size // 2))))
