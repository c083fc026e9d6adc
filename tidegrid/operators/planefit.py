"""Total-least-squares planes and the residual filter that uses them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.sources.shared import held

EDGE = 1e-6  # metres within which a point lies on a shared edge


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in "abc"]))
def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Direction of least spread of a covariance, pointing upwards: a batch of 3 x 3 matrices at once."""
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3).astype(float)
    bad = ~np.isfinite(m).all(axis=(1, 2))
    m[bad] = np.eye(3)
    n = np.linalg.eigh(m)[1][:, :, 0]
    n *= np.where(n[:, 2:] < 0, -1.0, 1.0)
    n[bad] = np.nan
    return pd.DataFrame(n, columns=["a", "b", "c"])


def plane_fit(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """(keys, n, mx, my, mz, a, b, c): the plane through the mean with the normal of least spread.

    Coordinates are centred on the group's first corner before they are
    squared; map coordinates of 10^6 m would lose the digits that count. The
    sums combine before their shuffle, and Python sees one row a group.
    """
    low = df.groupBy(*keys).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.min(z).alias("_z0"))
    rows = df.join(low, keys) if keys else df.crossJoin(F.broadcast(low))
    u, v, w = F.col(x) - F.col("_x0"), F.col(y) - F.col("_y0"), F.col(z) - F.col("_z0")
    pairs = {"xx": (u, u), "xy": (u, v), "xz": (u, w), "yy": (v, v), "yz": (v, w), "zz": (w, w)}
    sums = rows.groupBy(*keys, "_x0", "_y0", "_z0").agg(F.count("*").alias("n"), F.avg(u).alias("_u"), F.avg(v).alias("_v"), F.avg(w).alias("_w"), *[F.covar_pop(a, b).alias(n) for n, (a, b) in pairs.items()])
    fitted = sums.withColumn("_n", normal(*pairs))
    return fitted.select(*keys, "n", (F.col("_x0") + F.col("_u")).alias("mx"), (F.col("_y0") + F.col("_v")).alias("my"), (F.col("_z0") + F.col("_w")).alias("mz"), "_n.a", "_n.b", "_n.c")


def residual_filter(df: DataFrame, scan: list[str], x: str, y: str, z: str, size: float = 10.0, most: float = 0.2, least_n: int = 10) -> DataFrame:
    """Points within ``most`` of the plane of their triangle.

    Triangles halve the cells of a grid of 0.9 size by 2.7 size from each
    scan's corner, always along the same diagonal. A point on a shared edge
    belongs to every triangle there and is judged by the last of them in the
    order (column, row, half) that has ``least_n`` points; points without
    such a triangle are dropped.

    The rows are written to the shared folder once, whatever led to them; the
    corner, the planes and the judgement read them there.
    """
    df = held(df.withColumn("_id", F.monotonically_increasing_id()), "surface")
    dx, dy = 0.9 * size, 2.7 * size
    corner = df.groupBy(*scan).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    rows = (df.join(corner, scan) if scan else df.crossJoin(F.broadcast(corner)))
    u, v = (F.col(x) - F.col("_x0")) / dx, (F.col(y) - F.col("_y0")) / dy
    ex, ey = EDGE / dx, EDGE / dy
    rows = rows.withColumn("_u", u).withColumn("_v", v)
    near = lambda c, e: F.array_distinct(F.array(F.floor(F.col(c) - e), F.floor(F.col(c)), F.floor(F.col(c) + e)))
    rows = rows.withColumn("_i", F.explode(near("_u", ex))).withColumn("_j", F.explode(near("_v", ey))).where("_i >= 0 and _j >= 0")
    p, q = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    halves = F.array_compact(F.array(F.when(p + q <= 1 + ex + ey, F.lit(0)), F.when(p + q >= 1 - ex - ey, F.lit(1))))
    rows = rows.withColumn("_h", F.explode(halves))
    triangle = [*scan, "_i", "_j", "_h"]
    planes = plane_fit(rows.select(*triangle, x, y, z), triangle, x, y, z).where((F.col("n") >= least_n) & (F.abs("c") > 1e-12))
    judged = rows.join(planes.drop("n"), triangle)
    fit = F.col("mz") - (F.col("a") * (F.col(x) - F.col("mx")) + F.col("b") * (F.col(y) - F.col("my"))) / F.col("c")
    own = F.struct(F.abs(F.col(z) - fit).alias("r"), F.struct(*[c for c in df.columns if c != "_id"]).alias("row"))
    last = judged.groupBy("_id").agg(F.max_by(own, F.struct("_i", "_j", "_h")).alias("_l"))
    return last.where(F.col("_l.r") < most).select("_l.row.*")


def two_pass_filter(df: DataFrame, scan: list[str], x: str, y: str, z: str) -> DataFrame:
    """The coarse pass, then the fine one on what it left."""
    return residual_filter(residual_filter(df, scan, x, y, z, 10.0, 0.2), scan, x, y, z, 3.0, 0.1)
