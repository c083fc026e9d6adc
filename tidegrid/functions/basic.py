"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Missing is null everywhere; NaN is turned into it where data come in."""
    return F.when(~F.isnan(col(c)), col(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.when(b != 0, a / b)


def frame(keys: list[str], order: str, size: int) -> WindowSpec:
    """A moving window of ``size`` rows, cut at the ends: symmetric if odd, else one row more before than behind."""
    before, after = (size // 2, size // 2 - 1) if size % 2 == 0 else (size // 2, size // 2)
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)


def cell(c: str | Column, size: float) -> Column:
    """Index of the grid line nearest to a coordinate, half away from zero."""
    return F.round(col(c) / F.lit(float(size))).cast("long")


def snap(c: str | Column, size: float) -> Column:
    return cell(c, size) * F.lit(float(size))


def exact(c: str | Column, scale: int) -> Column:
    """A measure as a whole number of 1/scale, so that sums do not depend on their order."""
    return F.round(col(c) * F.lit(float(scale))).cast("long")


def mean_of(s1: Column, n: Column, scale: int) -> Column:
    """Mean from a sum of whole numbers."""
    return s1.cast("double") / n / F.lit(float(scale))


def std_of(s1: Column, s2: Column, n: Column, scale: int) -> Column:
    """Sample standard deviation from sums of whole numbers; 0 for one value."""
    a, b = s1.cast("double"), s2.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (b - a * a / n) / (n - 1))) / F.lit(float(scale))).otherwise(F.lit(0.0))


def middle(values: Column) -> Column:
    """Median of an array of non-null values, null if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
