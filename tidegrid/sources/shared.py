"""The folder that the driver and all executors share, and what is written there between jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a plain local session, whose driver and executors are one process, may go without and uses a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidegrid-")
    return found.rstrip("/") if "://" in found or found.startswith("file:") else f"file://{found.rstrip('/')}"


#: Folders that this process has made and not yet deleted, oldest first.
_made: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder name in the shared folder. It is deleted when its maker is done with it (``drop``), or else when this process ends."""
    _made.append(f"{shared_dir(spark)}/tidegrid/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def held(df: DataFrame, kind: str = "held") -> DataFrame:
    """Writes the rows to the shared folder and reads them again: no later failure, and no second use, computes anew what led to them."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def so_far() -> int:
    """How many folders there are, for ``drop``."""
    return len(_made)


def drop(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the folders made from ``since`` on, except the last ``but``, through Spark's own file system layer. Nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_made) - but
    for path in _made[since:end]:
        for own in (path, f"{path}-manifest"):
            where = jvm.org.apache.hadoop.fs.Path(own)
            where.getFileSystem(conf).delete(where, True)
    del _made[since:end]


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _made else None
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            drop(spark)
        except Exception:  # noqa: BLE001  the session may be ending too
            pass
