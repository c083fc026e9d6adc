"""Runs of missing values: their sizes, and filling them.

Rows must be dense along ``order``, so that a row's place is its grid place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_size(df: DataFrame, keys: list[str], order: str, value: str, name: str = "gap") -> DataFrame:
    """Length of the run of nulls that a null stands in, 0 elsewhere."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.count(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_run", run)
    own = Window.partitionBy(*keys, "_run")
    n = F.count(F.when(F.col(value).isNull(), 1)).over(own)
    return rows.withColumn(name, F.when(F.col(value).isNull(), n).otherwise(F.lit(0)).cast("long")).drop("_run")


def bracketed(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds the places and values of the nearest non-null rows before and behind."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    there = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return df.withColumn("_a", F.last(there, True).over(before)).withColumn("_b", F.first(there, True).over(after))


def between(order: str):
    a, b = F.col("_a"), F.col("_b")
    return a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["o"]) / (b["o"] - a["o"])


def fill_small(df: DataFrame, keys: list[str], order: str, value: str, most: int = 4, name: str = "filled") -> DataFrame:
    """Linear between both neighbours of runs of at most ``most`` nulls; longer runs and those at an end stay null."""
    rows = bracketed(df, keys, order, value)
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_b.o") - F.col("_a.o") - 1 <= most)
    return rows.withColumn(name, F.coalesce(F.col(value), F.when(ok, between(order)))).drop("_a", "_b")


def fill_max_gap(df: DataFrame, keys: list[str], order: str, value: str, max_gap: float, ends: bool = True, name: str = "filled") -> DataFrame:
    """Linear where the places of both neighbours are at most ``max_gap`` apart; with ``ends``, runs at an end no longer than that continue the nearest two values' line."""
    rows = bracketed(df, keys, order, value)
    inner = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_b.o") - F.col("_a.o") <= max_gap)
    filled = F.when(inner, between(order))
    if ends:
        w = Window.partitionBy(*keys).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        there = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
        # Only the two non-null rows next to each end are needed, so no list of all rows is made.
        previous = F.last(there, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        following = F.first(there, True).over(w.rowsBetween(1, Window.unboundedFollowing))
        rows = rows.withColumn("_before", F.when(F.col(value).isNotNull(), previous)).withColumn("_behind", F.when(F.col(value).isNotNull(), following))
        rows = rows.withColumn("_head", F.first(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col("_behind").alias("n"))), True).over(whole))
        rows = rows.withColumn("_tail", F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col("_before").alias("n"))), True).over(whole))
        rows = rows.withColumn("_lo", F.min(order).over(whole)).withColumn("_hi", F.max(order).over(whole))
        for end, empty, run in (("_head", "_a", F.col("_head.o") - F.col("_lo")), ("_tail", "_b", F.col("_hi") - F.col("_tail.o"))):
            e = F.col(end)
            line = e["v"] + (e["n"]["v"] - e["v"]) * (F.col(order) - e["o"]) / (e["n"]["o"] - e["o"])
            filled = F.coalesce(filled, F.when(F.col(empty).isNull() & (run <= max_gap) & e["n"].isNotNull(), line))
        rows = rows.withColumn(name, F.coalesce(F.col(value), filled)).drop("_before", "_behind", "_head", "_tail", "_lo", "_hi")
    else:
        rows = rows.withColumn(name, F.coalesce(F.col(value), filled))
    return rows.drop("_a", "_b")


def reflect_pad(df: DataFrame, keys: list[str], t: str, size: int) -> DataFrame:
    """Rows mirrored behind the last tick, which is itself repeated first; ticks must be dense."""
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    marked = df.join(last, keys) if keys else df.crossJoin(last)
    mirrored = marked.where(F.col("_last") - F.col(t) < size).withColumn(t, 2 * F.col("_last") - F.col(t) + 1)
    return marked.unionByName(mirrored).drop("_last")
