"""Whole processing plans: points to half-hourly surfaces, and points to space-time stacks with runup and contours."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.basic import nan_to_null, snap
from tidegrid.functions.times import at_micros, gps_micros, nearest, tick
from tidegrid.operators import contours, gaps, geometry, planefit, raster, runup, spectral, stack, stencil


@dataclass(frozen=True)
class L1:
    matrix: list
    boundary: list
    cell: float = 0.1
    most_intensity: float = 100.0
    most_tick: int = 300
    least_n: int = 10
    least_snr: float = 100.0
    passes: tuple = ((10.0, 0.2), (3.0, 0.1))


def cleaned(points: DataFrame, matrix: list, boundary: list) -> DataFrame:
    """Points in map coordinates within the boundary, with their scan's first stamp."""
    first = points.groupBy("scan_id").agg(F.min_by("gps_s", "pidx").alias("gps_first"))
    x, y, z = geometry.transform("x", "y", "z", matrix)
    rows = points.select("scan_id", "gps_s", "intensity", nan_to_null(x).alias("x"), nan_to_null(y).alias("y"), nan_to_null(z).alias("z"))
    inside = rows.where(geometry.in_box("x", "y", boundary) & geometry.in_polygon("x", "y", boundary))
    return inside.join(first, "scan_id")


def l1_surfaces(points: DataFrame, o: L1) -> DataFrame:
    """(scan_id, scan_ts, x, y, zmean, zmax, zmin, zmode, zstd) of each scan's cells on the beach's surface."""
    rows = cleaned(points.where(F.col("intensity") < o.most_intensity), o.matrix, o.boundary)
    rows = rows.where(tick(F.col("gps_s") - F.col("gps_first"), 1.0, base=1) <= o.most_tick)
    at = rows.groupBy("scan_id").agg(at_micros(nearest(gps_micros(F.first("gps_first"), F.first("gps_first")), 1_800_000_000)).alias("scan_ts"))
    cells = raster.gridded(rows, "x", "y", o.cell, o.cell)
    stats = raster.lower_half_stats(cells, ["scan_id", "xi", "yi"], "z", o.least_n, o.least_snr)
    surface = stats.withColumn("x", F.col("xi") * F.lit(o.cell)).withColumn("y", F.col("yi") * F.lit(o.cell)).drop("xi", "yi", "n")
    for size, most in o.passes:
        surface = planefit.residual_filter(surface, ["scan_id"], "x", "y", "zmode", size, most)
    return surface.join(at, "scan_id").select("scan_id", "scan_ts", "x", "y", "zmean", "zmax", "zmin", "zmode", "zstd")


@dataclass(frozen=True)
class L2:
    matrix: list
    boundary: list
    line: geometry.Transect
    step: float = 0.5
    most_z: float = 4.0
    most_intensity: float = 100.0
    tolerance: float = 2.0
    trim: tuple = (4.0, 100.0)
    k: float = 3.0
    flags: list = field(default_factory=list)
    threshold: float = 0.07
    minutes: float = 2.0
    levels: tuple = (20.0, 10.0, 5.0)


def l2_stack(points: DataFrame, o: L2) -> DataFrame:
    """(scan_id, xi, ti, z, intensity): dense. Cells' centres decide which points are near the line, raw values are averaged."""
    near = points.where(F.col("intensity") < o.most_intensity)
    rows = cleaned(near, o.matrix, o.boundary).where(F.col("z") < o.most_z)
    size = o.line.spacing
    rows = rows.withColumn("ti", tick(F.col("gps_s") - F.col("gps_first"), o.step)).withColumn("cx", snap("x", size)).withColumn("cy", snap("y", size))
    ticks = rows.select("scan_id", "ti").distinct()
    on_line = geometry.near_line(rows, o.line, "cx", "cy", o.tolerance)
    lo, hi = int(o.trim[0] / size + 1e-9), int(round(o.trim[1] / size))
    cells = on_line.where((F.col("xi") > lo) & (F.col("xi") < hi)).groupBy("scan_id", "xi", "ti").agg(F.avg("z").alias("z"), F.avg("intensity").alias("intensity"))
    nodes = ticks.select("scan_id").distinct().withColumn("xi", F.explode(F.sequence(F.lit(lo + 1), F.lit(hi - 1))))
    return nodes.join(ticks, "scan_id").join(cells, ["scan_id", "xi", "ti"], "left")


def l2_cleaned(grid: DataFrame, o: L2) -> DataFrame:
    """Outliers and flagged ranges become null, short gaps near the shore are filled, both fields are median-filtered."""
    rows = stencil.outlier_mask(grid, ["scan_id"], "xi", "ti", "z", int(60 / o.step), o.k)
    rows = stencil.masked_to_null(rows, "masked", ["z", "intensity"]).drop("raw", "masked", "grad", "lap")
    rows = rows.withColumn("x", F.col("xi") * F.lit(o.line.spacing))
    if o.flags:
        rows = contours.flag_intervals(rows, "x", o.flags, ["z", "intensity"])
    for v in ("z", "intensity"):
        near = gaps.fill_max_gap(rows, ["scan_id", "ti"], "xi", v, 8, ends=False, name="_g")
        rows = near.withColumn(v, F.when(F.col("x") <= 30, F.col("_g")).otherwise(F.col(v))).drop("_g")
        rows = stencil.median2d(rows, ["scan_id"], "xi", "ti", v, 10, 2, "_m").withColumn(v, F.col("_m")).drop("_m")
    last = rows.groupBy("scan_id").agg(F.max("ti").alias("_last"))
    return rows.join(last, "scan_id").where("ti < _last").drop("_last")


def l2_products(clean: DataFrame, o: L2) -> dict[str, DataFrame]:
    """runup, spectrum, bulk, contours and their statistics of cleaned stacks."""
    minutes = int(120 / o.step)
    sand = runup.dry_beach(clean, ["scan_id"], "x", "ti", "z", minutes, int(50 / o.step))
    tracks = runup.runup(sand, ["scan_id"], dt=o.step, threshold=o.threshold)
    spectrum = spectral.spectrum(tracks, ["scan_id"], "ti", "z_filled", o.step, o.minutes)
    mean_x = tracks.groupBy("scan_id").agg(F.avg("x_runup").alias("mean_x"))
    bright = stencil.median2d(contours.offshore_mask(clean, ["scan_id"], mean_x, "x", "intensity"), ["scan_id"], "xi", "ti", "intensity", 10, 5, "i")
    lines = contours.seaward_contour(bright, ["scan_id"], "ti", "x", "i", list(o.levels))
    return {
        "runup": tracks,
        "spectrum": spectrum,
        "bulk": spectral.wave_bulk(spectrum, ["scan_id"]).join(runup.eta(tracks, ["scan_id"], "z_runup"), "scan_id"),
        "contours": lines,
        "contour_stats": contours.contour_stats(lines, ["scan_id", "threshold"], "x"),
        "regular": stack.regular_axis(tracks, "ti", 1, ["scan_id"]),
    }
