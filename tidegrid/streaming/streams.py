"""Structured Streaming forms of ingestion, half-hour surfaces and tracking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.runup import Tracker
from tidegrid.sources.catalog import merge_surfaces, read_days, write_days


def tumbling_min(df: DataFrame, ts: str, keys: list[str], value: str, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(keys, start, least, n) of each window; rows later than the watermark are dropped."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(*keys, F.window("_ts", width).alias("w")).agg(F.min(value).alias("least"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "least", "n")


def first_per_key(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row seen of each key within the watermark."""
    return df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def scan_sessions(df: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of rows without a longer pause."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(*keys, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def store_surfaces(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], arrival: str):
    """Each micro-batch is merged into the day partitions it touches; the stored row of a key stays. Batches can run again."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = batch.select("day").distinct()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        old = read_days(spark, folder, schema).join(days, "day", "left_semi")
        both = merge_surfaces(old, batch, keys, arrival).checkpoint()  # what is overwritten must not be read lazily
        write_days(both, folder)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TRACK_OUT = "scan_id string, ti long, x_runup double"
TRACK_STATE = "history array<double>, low double, high double, level double, count long, last long"


def track(df: DataFrame, x0: float, spacing: float, x_off: float, threshold: float = 0.1) -> DataFrame:
    """Runup of rows (scan_id, ti, depth array): the tracker's state is kept between micro-batches, steps already seen are ignored."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ti")
        x = x0 + spacing * np.arange(len(rows["depth"].iloc[0]))
        tracker, last = Tracker(x, x_off, threshold, spacing), -1
        if state.exists:
            history, low, high, level, count, last = state.get
            tracker.history = [float("nan") if h is None else h for h in history]
            tracker.segment, tracker.count = (low, high, level), count
        out = []
        for ti, depth in zip(rows["ti"], rows["depth"]):
            if ti > last:
                out.append((key[0], int(ti), tracker.step(np.array([np.nan if d is None else d for d in depth], float))))
                last = int(ti)
        state.update(([h if h == h else None for h in tracker.history], *map(float, tracker.segment), tracker.count, last))
        found = pd.DataFrame(out, columns=["scan_id", "ti", "x_runup"])
        yield found.assign(x_runup=found["x_runup"].astype(float))

    return df.groupBy("scan_id").applyInPandasWithState(run, TRACK_OUT, TRACK_STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet under ``folder``, and reads the rows back.

    The folder, with the stream's checkpoint, must be one that all executors
    share. A complete result is written anew by each micro-batch.
    """
    rows = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    else:
        writer = writer.format("parquet").option("path", rows)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
