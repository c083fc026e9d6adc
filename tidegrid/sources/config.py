"""Site configuration and calibration epochs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Site:
    dataFolder: str = ""
    processHFolder: str = ""
    processFolder: str = ""
    plotFolder: str = ""
    transformMatrix: tuple = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))
    LidarBoundary: tuple = ()


def read_site(path: str | Path) -> Site:
    """Unknown fields are ignored, missing ones keep their defaults."""
    raw = json.loads(Path(path).read_text())
    known = {f.name for f in fields(Site)}
    lists = {k: tuple(map(tuple, v)) if k in ("transformMatrix", "LidarBoundary") else v for k, v in raw.items() if k in known}
    return Site(**lists)


def write_site(site: Site, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(site), indent=2))


CALIBRATION = "name string, valid_from timestamp, matrix array<array<double>>, boundary array<array<double>>"


def calibrations(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Calibration epochs as rows, instead of one file that a later epoch overwrites."""
    return spark.createDataFrame(rows, CALIBRATION)
