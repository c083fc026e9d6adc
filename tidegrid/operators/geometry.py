"""Rigid transforms, polygons and lines, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.basic import col


def transform(x: str, y: str, z: str, matrix: list[list[float]]) -> list[Column]:
    """The three coordinates of a homogeneous 4 x 4 transform."""
    c = [col(x), col(y), col(z)]
    return [F.lit(float(m[0])) * c[0] + F.lit(float(m[1])) * c[1] + F.lit(float(m[2])) * c[2] + F.lit(float(m[3])) for m in matrix[:3]]


def in_polygon(x: str | Column, y: str | Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a literal list of vertices; points on the border are inside."""
    px, py = col(x).cast("double"), col(y).cast("double")
    crossings, edge = [], []
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:] + vertices[:1]):
        a, b, c, d = (F.lit(float(v)) for v in (ax, ay, bx, by))
        side = (c - a) * (py - b) - (d - b) * (px - a)
        edge.append((side == 0) & px.between(F.least(a, c), F.greatest(a, c)) & py.between(F.least(b, d), F.greatest(b, d)))
        if ay != by:
            crossings.append(((b > py) != (d > py)) & (px < (c - a) * (py - b) / (d - b) + a))
    odd = reduce(lambda s, t: s + t, [t.cast("int") for t in crossings]) % 2 == 1
    return reduce(lambda s, t: s | t, edge) | odd


def in_box(x: str, y: str, vertices: list[tuple[float, float]]) -> Column:
    """A cheap bound of the polygon, which a scan can prune by."""
    xs, ys = zip(*vertices)
    return col(x).between(float(min(xs)), float(max(xs))) & col(y).between(float(min(ys)), float(max(ys)))


@dataclass(frozen=True)
class Transect:
    """A line from the back of the beach seawards; equispaced nodes from its begin."""

    x0: float
    y0: float
    x1: float
    y1: float
    spacing: float
    trim: float = 0.0

    @property
    def angle(self) -> float:
        return math.atan2(self.y1 - self.y0, self.x1 - self.x0)

    @property
    def length(self) -> float:
        return math.hypot(self.x1 - self.x0, self.y1 - self.y0) - self.trim

    @property
    def n_nodes(self) -> int:
        return int(math.floor(self.length / self.spacing + 1e-9)) + 1

    def shifted(self, alongshore: float) -> Transect:
        """Both ends moved at right angles."""
        dx, dy = alongshore * math.cos(self.angle + math.pi / 2), alongshore * math.sin(self.angle + math.pi / 2)
        return Transect(self.x0 + dx, self.y0 + dy, self.x1 + dx, self.y1 + dy, self.spacing, self.trim)

    def along(self, x: str | Column, y: str | Column) -> Column:
        """Distance along the line from its begin."""
        size = math.hypot(self.x1 - self.x0, self.y1 - self.y0)
        return ((col(x) - F.lit(self.x0)) * F.lit(self.x1 - self.x0) + (col(y) - F.lit(self.y0)) * F.lit(self.y1 - self.y0)) / F.lit(size)

    def across(self, x: str | Column, y: str | Column) -> Column:
        """Signed distance from the line, positive to its left."""
        size = math.hypot(self.x1 - self.x0, self.y1 - self.y0)
        return ((col(y) - F.lit(self.y0)) * F.lit(self.x1 - self.x0) - (col(x) - F.lit(self.x0)) * F.lit(self.y1 - self.y0)) / F.lit(size)

    def node(self, along: Column) -> Column:
        """The nearest node: nodes are collinear and equispaced, so no search is needed."""
        return F.greatest(F.lit(0), F.least(F.lit(self.n_nodes - 1), F.round(along / F.lit(self.spacing)).cast("int")))


def near_line(df: DataFrame, line: Transect, x: str, y: str, tolerance: float) -> DataFrame:
    """Rows within a distance of the (infinite) line, with along, across and xi."""
    out = df.withColumn("along", line.along(x, y)).withColumn("across", line.across(x, y))
    return out.where(F.abs("across") <= tolerance).withColumn("xi", line.node(F.col("along")))


def normal_angle(a: list[list[float]], b: list[list[float]]) -> float:
    """Degrees between the normals of two calibrations' planes, seen in the x-z plane."""

    def unit(m):
        x, z = m[0][2], m[2][2]
        n = math.hypot(x, z)
        return x / n, z / n

    (ax, az), (bx, bz) = unit(a), unit(b)
    return math.degrees(math.acos(max(-1.0, min(1.0, ax * bx + az * bz))))


def normal_angle_columns(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """The same over columns."""
    cosine = (ax * bx + az * bz) / (F.sqrt(ax * ax + az * az) * F.sqrt(bx * bx + bz * bz))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def compare_calibrations(df: DataFrame, a: list[list[float]], b: list[list[float]], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Both transforms of each point, and the difference of their heights."""
    names = [f"{n}_{k}" for k in "ab" for n in "xyz"]
    out = df.select("*", *[c.alias(n) for c, n in zip(transform(x, y, z, a) + transform(x, y, z, b), names)])
    return out.withColumn("dz", F.col("z_b") - F.col("z_a"))
