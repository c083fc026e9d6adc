"""Manifests of files, resuming, and day-partitioned results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.times import at_micros, micros, seconds_of_name

SURFACE = "day date, scan_ts timestamp_ntz, x double, y double, zmean double, zmax double, zmin double, zmode double, zstd double"


def manifest(spark: SparkSession, folder: str, glob: str = "do-lidar_*.la[sz]", pattern: str = r"do-lidar_(\d+)\.la[sz]$") -> DataFrame:
    """(path, file_ts) of a folder's files, times from their names; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return files.withColumn("file_ts", at_micros(seconds_of_name("path", pattern) * 1_000_000))


def recent(df: DataFrame, ts: str, days: int = 10) -> DataFrame:
    """Rows at most so many days older than the newest: a one-row aggregate bounds the scan."""
    newest = df.agg(F.max(F.col(ts)).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_newest")


def within(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def newer(df: DataFrame, ts: str, done: DataFrame, done_ts: str) -> DataFrame:
    """Rows behind the newest one already processed; all, if there is none."""
    mark = done.agg(F.max(done_ts).alias("_mark"))
    return df.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_first(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The first arrival of each key; a rank limit, so Spark drops later ones before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*arrival)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_days(df: DataFrame, folder: str, day: str = "day") -> None:
    """Replaces the days that df holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def read_days(spark: SparkSession, folder: str, schema: str = SURFACE) -> DataFrame:
    """The stored table, or an empty one where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def merge_surfaces(old: DataFrame, new: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Stored rows come before new ones of the same key."""
    both = old.withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(1)))
    return keep_first(both, keys, ["_old", arrival]).drop("_old")


def summary(df: DataFrame, ts: str) -> DataFrame:
    """One row for the log."""
    us = micros(ts)
    return df.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(F.floor(us / F.lit(86_400_000_000))).alias("days"))
