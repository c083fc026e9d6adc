"""Two-dimensional stencils over dense (x, t) grids.

A stencil is a sum over neighbours. Along t a window reaches the neighbours;
along x the rows of a tick are one window too, so a 3 x 3 kernel is two
passes of windows and no join. Rows must be dense in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.basic import exact, mean_of, middle, std_of
from tidegrid.operators.windows import moving_mean, moving_min

#: The kernels, rows along x and columns along t.
SOBEL_T = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_X = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def convolve(df: DataFrame, keys: list[str], x: str, t: str, value: str, kernels: dict[str, list[list[float]]]) -> DataFrame:
    """Central part of the 2-D convolution with 3 x 3 kernels; zeros outside, null where a null is under a non-zero weight.

    As a convolution flips its kernel, the weight at (1 + a, 1 + b) meets
    the value at (x - a, t - b).
    """
    wt = Window.partitionBy(*keys, x).orderBy(t)
    wx = Window.partitionBy(*keys, t).orderBy(x)
    zero = F.lit(0.0)
    rows = df
    for b in (-1, 0, 1):
        # The value at t - b: outside the grid it is 0, inside it may be null.
        near = F.col(value) if b == 0 else F.lag(F.struct(F.col(value).alias("v")), b).over(wt)
        rows = rows.withColumn(f"_t{b}", near if b == 0 else F.when(near.isNull(), zero).otherwise(near["v"]))
    names = {(a, b): f"_x{a}_t{b}" for a in (-1, 0, 1) for b in (-1, 0, 1)}
    held = F.struct(*[F.col(f"_t{b}").alias(f"t{b}") for b in (-1, 0, 1)])
    for a in (-1, 1):
        rows = rows.withColumn(f"_x{a}", F.lag(held, a).over(wx))
    cells = {}
    for (a, b), _ in names.items():
        if a == 0:
            cells[a, b] = F.col(f"_t{b}")
        else:
            there = F.col(f"_x{a}")
            cells[a, b] = F.when(there.isNull(), zero).otherwise(there[f"t{b}"])
    for name, kernel in kernels.items():
        total = None
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                weight = kernel[1 + a][1 + b]
                if weight:
                    term = cells[a, b] * F.lit(float(weight))
                    total = term if total is None else total + term
        rows = rows.withColumn(name, total)
    return rows.drop(*[f"_t{b}" for b in (-1, 0, 1)], "_x-1", "_x1")


def median2d(df: DataFrame, keys: list[str], x: str, t: str, value: str, nx: int, nt: int, name: str = "med2d") -> DataFrame:
    """Median of an nx x nt neighbourhood, zeros outside the grid; null where the centre is null, other nulls skipped.

    An even side reaches one further back. Each side is a window of rows, the
    second over the first's lists, so a list holds nx x nt values at most.
    """
    bx, ax = (nx - 1) // 2 if nx % 2 else nx // 2 - 1, nx // 2
    bt, at = (nt - 1) // 2 if nt % 2 else nt // 2 - 1, nt // 2
    wt = Window.partitionBy(*keys, x).orderBy(t).rowsBetween(-bt, at)
    wx = Window.partitionBy(*keys, t).orderBy(x).rowsBetween(-bx, ax)
    one = F.array_compact(F.array(value))  # a side of one needs no window
    rows = df.withColumn("_l", F.collect_list(value).over(wt) if nt > 1 else one).withColumn("_nt", F.count(F.lit(1)).over(wt) if nt > 1 else F.lit(1))
    rows = rows.withColumn("_ll", F.flatten(F.collect_list("_l").over(wx)) if nx > 1 else F.col("_l")).withColumn("_nx", F.count(F.lit(1)).over(wx) if nx > 1 else F.lit(1))
    outside = (F.lit(nx * nt) - F.col("_nx") * F.col("_nt")).cast("int")
    padded = F.concat(F.col("_ll"), F.array_repeat(F.lit(0.0), outside))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), middle(padded))).drop("_l", "_ll", "_nt", "_nx")


def dilate(df: DataFrame, keys: list[str], x: str, t: str, mask: str, nx: int = 6, nt: int = 2, name: str = "dilated") -> DataFrame:
    """True where any mask is set within nx x nt: a rectangle is a maximum along t, then along x."""
    wt = Window.partitionBy(*keys, x).orderBy(t).rowsBetween(-(nt // 2), nt - nt // 2 - 1)
    wx = Window.partitionBy(*keys, t).orderBy(x).rowsBetween(-(nx // 2), nx - nx // 2 - 1)
    rows = df.withColumn("_m", F.max(F.coalesce(F.col(mask), F.lit(False)).cast("int")).over(wt))
    return rows.withColumn(name, F.max("_m").over(wx) == 1).drop("_m")


def outlier_mask(
    df: DataFrame,
    keys: list[str],
    x: str,
    t: str,
    value: str,
    window: int,
    threshold: float = 2.5,
    med: tuple[int, int] = (1, 2),
    dilation: tuple[int, int] = (6, 2),
    scale: int = 10**6,
    mean_scale: int | None = None,
) -> DataFrame:
    """Adds grad, lap, raw (the predicate) and masked (dilated).

    The value less its slowly moving floor is median-filtered; a point is an
    outlier where the gradient exceeds its mean by ``threshold`` standard
    deviations and the absolute Laplacian does so by those of the signed
    one. Means and deviations are one grouped row a key, joined back; their
    sums are whole numbers of 1/scale. The floor's mean is not rounded unless
    mean_scale says of what its values are whole numbers.
    """
    rows = moving_min(df, [*keys, x], t, value, window, name="_floor")
    rows = moving_mean(rows, [*keys, x], t, "_floor", window, strict=True, scale=mean_scale, name="_base")
    rows = rows.withColumn("_d", F.col(value) - F.col("_base"))
    rows = median2d(rows, keys, x, t, "_d", *med, name="_f")
    rows = convolve(rows, keys, x, t, "_f", {"_gx": SOBEL_X, "_gt": SOBEL_T, "lap": LAPLACIAN})
    rows = rows.withColumn("grad", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gt") * F.col("_gt")))
    g, lap, size = exact("grad", scale), exact("lap", scale), exact(F.abs("lap"), scale)
    wide = lambda c: F.sum(c.cast("decimal(20,0)") * c.cast("decimal(18,0)"))
    sums = rows.groupBy(*keys).agg(F.count("grad").alias("ng"), F.sum(g).alias("g1"), wide(g).alias("g2"), F.count("lap").alias("nl"), F.sum(size).alias("a1"), F.sum(lap).alias("l1"), wide(lap).alias("l2"))
    limits = sums.select(
        *keys,
        F.when(F.col("ng") > 0, mean_of(F.col("g1"), F.col("ng"), scale) + threshold * std_of(F.col("g1"), F.col("g2"), F.col("ng"), scale)).alias("_gl"),
        F.when(F.col("nl") > 0, mean_of(F.col("a1"), F.col("nl"), scale) + threshold * std_of(F.col("l1"), F.col("l2"), F.col("nl"), scale)).alias("_ll"),
    )
    rows = rows.join(limits, keys) if keys else rows.crossJoin(F.broadcast(limits))  # without keys it is one row
    rows = rows.withColumn("raw", F.coalesce((F.col("grad") > F.col("_gl")) & (F.abs("lap") > F.col("_ll")), F.lit(False)))
    rows = dilate(rows, keys, x, t, "raw", *dilation, name="masked")
    return rows.drop("_floor", "_base", "_d", "_f", "_gx", "_gt", "_gl", "_ll")


def masked_to_null(df: DataFrame, mask: str, values: list[str]) -> DataFrame:
    return df.withColumns({v: F.when(~F.coalesce(F.col(mask), F.lit(False)), F.col(v)) for v in values})
