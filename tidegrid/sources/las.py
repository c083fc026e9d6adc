"""Uncompressed LAS point files as a Spark data source.

``spark.read.format("las").load(folder)`` gives (scan_id, pidx, x, y, z,
intensity, gps_s); a file is split by ranges of points, each read by a task
on its own. Compressed files (LAZ) are refused.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "scan_id string, pidx bigint, x double, y double, z double, intensity double, gps_s double"
#: Where point formats keep the GPS time, and their least sizes.
GPS_AT = {0: None, 1: 20, 2: None, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}


@dataclass
class Header:
    begin: int
    size: int
    kind: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def header(raw: bytes) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = raw[25]
    begin, _, kind, size, count = struct.unpack_from("<IIBHI", raw, 96)
    if kind & 0x80:
        raise ValueError("compressed points (LAZ) cannot be read here")
    if minor >= 4 and len(raw) >= 255 and (more := struct.unpack_from("<Q", raw, 247)[0]):
        count = more
    return Header(begin, size, kind, count, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155))


def points(raw: bytes, h: Header) -> dict[str, np.ndarray]:
    """Columns of whole point records."""
    n = len(raw) // h.size
    rows = np.frombuffer(raw, np.uint8, n * h.size).reshape(n, h.size)
    at = lambda i, kind: rows[:, i : i + np.dtype(kind).itemsize].copy().view(kind)[:, 0]
    out = {c: at(4 * i, "<i4") * h.scale[i] + h.offset[i] for i, c in enumerate("xyz")}
    out["intensity"] = at(12, "<u2").astype(float)
    gps = GPS_AT.get(h.kind)
    out["gps_s"] = at(gps, "<f8").astype(float) if gps is not None else np.full(n, np.nan)
    return out


def write_las(path: str, x, y, z, intensity, gps_s, scale: float = 0.001) -> None:
    """A LAS 1.2 file of point format 1, for tests and exchange."""
    xyz = [np.asarray(v, float) for v in (x, y, z)]
    offset = [float(np.floor(v.min())) if len(v) else 0.0 for v in xyz]
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 1, 28, len(xyz[0]))
    struct.pack_into("<3d", head, 131, *[scale] * 3)
    struct.pack_into("<3d", head, 155, *offset)
    body = np.zeros(len(xyz[0]), np.dtype([("p", "<i4", 3), ("i", "<u2"), ("r", "u1", 6), ("g", "<f8")]))
    body["p"] = np.stack([np.round((v - o) / scale) for v, o in zip(xyz, offset)], axis=1)
    body["i"], body["g"] = intensity, gps_s
    with open(path, "wb") as f:
        f.write(bytes(head) + body.tobytes())


class Slice(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class LasReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("pointsperpartition", 1_000_000))

    def _files(self):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(base))
        return files, sorted(i.path for i in found if i.path.lower().endswith(".las"))

    def partitions(self):
        files, paths = self._files()
        out = []
        for p in paths:
            with files.open_input_file(p) as f:
                n = header(f.read(375)).count
            out += [Slice(p, i, min(i + self.rows, n)) for i in range(0, n, self.rows)]
        return out or [Slice("", 0, 0)]

    def read(self, part):
        from pyarrow import fs

        if not part.path:
            return
        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with files.open_input_file(part.path) as f:
            h = header(f.read(375))
            name = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for first in range(part.first, part.last, 100_000):
                last = min(first + 100_000, part.last)
                f.seek(h.begin + first * h.size)
                cols = points(f.read((last - first) * h.size), h)
                n = last - first
                gps = pa.array(cols["gps_s"], mask=np.isnan(cols["gps_s"]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(first, last)), *[pa.array(cols[c]) for c in ("x", "y", "z", "intensity")], gps], names=["scan_id", "pidx", "x", "y", "z", "intensity", "gps_s"])


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(self.options)
