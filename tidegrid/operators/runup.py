"""The runup tracker: where a thin sheet of water meets the beach, step by step.

Position at one step depends on those of the four before, so a scan is one
sequential state; scans run in parallel. ``Tracker`` is that state: the
batch operator runs it over a scan's columns, the streaming one keeps it
between micro-batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.gaps import fill_max_gap
from tidegrid.operators.inpaint import inpaint_runs
from tidegrid.operators.windows import moving_mean, moving_min


def median_zero_padded(y: np.ndarray, size: int = 5) -> np.ndarray:
    padded = np.pad(y, size // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)


def mean5(y: np.ndarray) -> np.ndarray:
    """Moving mean of five, missing values skipped, ends cut."""
    ok = ~np.isnan(y)
    s = np.convolve(np.where(ok, y, 0.0), np.ones(5), "same")
    n = np.convolve(ok.astype(float), np.ones(5), "same")
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, s / n, np.nan)


def median_skipping(columns: list[np.ndarray]) -> np.ndarray:
    s = np.sort(np.stack(columns), axis=0)  # missing values come last
    n = (~np.isnan(s)).sum(axis=0)
    i = np.arange(s.shape[1])
    with np.errstate(invalid="ignore"):
        m = (s[np.maximum((n - 1) // 2, 0), i] + s[np.maximum(n // 2, 0).clip(max=len(s) - 1), i]) / 2
    return np.where(n > 0, m, np.nan)


def meets(x: np.ndarray, depth: np.ndarray, low: float, high: float, level: float, spike: int = 15) -> np.ndarray:
    """Where the depth polyline meets a level between two ends, in order of x; crossings with another sign change nearby are spikes and left out."""
    d = depth - level
    a, b = d[:-1], d[1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        hit = (a * b <= 0) & (a != b)
        at = x[:-1] + (x[1:] - x[:-1]) * (a / (a - b))
    found = np.unique(at[hit & (at >= low) & (at <= high)])
    sign = np.sign(d)
    kept = []
    for p in found:
        near = int(np.abs(x - p).argmin())
        own = np.arange(max(0, near - spike), min(len(x), near + spike + 1))
        own = own[(x[own] >= low) & (x[own] <= high)]
        # A missing node counts as a node of the window, but a step from or to it is no change of sign.
        if len(own) > 2 and (np.abs(np.diff(sign[own])) > 0).sum() <= 1:
            kept.append(p)
    return np.array(kept)


@dataclass
class Tracker:
    x: np.ndarray
    x_off: float
    threshold: float = 0.1
    spacing: float | None = None
    history: list[float] = field(default_factory=list)  # the last four positions, missing ones as NaN
    segment: tuple[float, float, float] | None = None
    count: int = 0

    def __post_init__(self):
        self.spacing = self.spacing or float(np.median(np.diff(self.x)))
        self.segment = self.segment or (0.0, self.x_off, self.threshold)

    @property
    def half(self) -> float:
        return 0.5 / self.spacing

    def step(self, depth: np.ndarray) -> float:
        """The position at the next step, NaN if none; the last segment looked at stays."""
        self.count += 1
        last4 = self.history[-4:]
        there = [p for p in last4 if p == p]
        center = sum(there) / len(there) if len(last4) == 4 and there else float("nan")  # missing ones are skipped
        if self.count > 4 and last4[-1] == last4[-1]:
            c = max(4.0, center)
            self.segment = (c - self.half, c + self.half, self.threshold)
        found = meets(self.x, depth, *self.segment)
        if not len(found):
            if self.count > 5 and center == center:
                self.segment = (center - 2 * self.half, center + 2 * self.half, self.threshold + 0.01)
            else:
                self.segment = (0.0, self.x_off, self.threshold)
            found = meets(self.x, depth, *self.segment)
        position = float(found[0]) if len(found) else float("nan")
        self.history = [*self.history[-3:], position]
        return position


def track_scan(z: np.ndarray, sand: np.ndarray, x: np.ndarray, threshold: float, x_off: float, intensity: np.ndarray | None = None, bright: float = 30.0) -> np.ndarray:
    """Positions of one scan; z and its dry beach are nodes x steps.

    With an intensity, what is brighter than ``bright`` is missing from its
    own step on: the step ahead is still whole when the one before it looks
    there. z is changed so.
    """
    n = z.shape[1]
    tracker, out = Tracker(x, x_off, threshold), np.full(n, np.nan)
    for i in range(n):
        if intensity is not None:
            with np.errstate(invalid="ignore"):
                z[intensity[:, i] > bright, i] = np.nan
        beach = median_zero_padded(sand[:, i])
        water = median_skipping([z[:, i - 1], z[:, i], z[:, i + 1]]) if 2 <= i < n - 1 else z[:, i]
        out[i] = tracker.step(mean5(water - beach))
    return out


def sparse_from(z: np.ndarray, x: np.ndarray, dt: float) -> float:
    """First node whose sum of elevations over time is below a quarter of the scan's seconds; the last node if none is."""
    low = np.nansum(z, axis=1) < 0.25 * z.shape[1] * dt
    return float(x[low.argmax()]) if low.any() else float(x[-1])


def nearest_node(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the node nearest to a position, which is first rounded to 0.1; the first node below them all, the last one above, at the first node itself and for a missing position."""
    p = np.sign(at) * np.floor(np.abs(at) * 10 + 0.5) / 10
    with np.errstate(invalid="ignore"):
        inside, below = (p > x[0]) & (p < x[-1]), p < x[0]
    out = np.full(len(at), len(x) - 1)
    out[below] = 0
    right = np.searchsorted(x, p[inside])
    out[inside] = np.where(p[inside] - x[right - 1] <= x[right] - p[inside], right - 1, right)
    return out


TRACK = [("ti", T.LongType()), ("x_runup", T.DoubleType()), ("z_runup", T.DoubleType()), ("x_filled", T.DoubleType()), ("z_filled", T.DoubleType())]


def runup(df: DataFrame, keys: list[str], x: str = "x", t: str = "ti", z: str = "z", sand: str = "sand", dt: float = 0.5, threshold: float = 0.1, x_off: float | None = None, intensity: str | None = None, bright: float = 30.0) -> DataFrame:
    """(keys, ti, x_runup, z_runup, x_filled, z_filled) of each scan.

    Elevation at the edge is a lookup at the nearest node, then the median of
    each step and the one before; both series are also given without gaps.
    With ``intensity``, what is brighter than ``bright`` is masked step by
    step. A scan is one sequential state and one task: memory grows with its
    nodes times steps (a scan of 20 minutes is some 40 MB), not with the table.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(*c) for c in TRACK])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([x, t])
        nodes, ticks = np.sort(rows[x].unique()).astype(float), np.sort(rows[t].unique())
        grid = rows[z].to_numpy(float, copy=True).reshape(len(nodes), len(ticks))
        dry = rows[sand].to_numpy(float).reshape(grid.shape)
        far = sparse_from(grid, nodes, dt) if x_off is None else x_off
        r = track_scan(grid, dry, nodes, threshold, far, None if intensity is None else rows[intensity].to_numpy(float).reshape(grid.shape), bright)
        filled = inpaint_runs(r)
        height = grid[nearest_node(nodes, filled), np.arange(len(r))]
        smooth = median_skipping([np.concatenate([[np.nan], height[:-1]]), height])
        out = pd.DataFrame({"ti": ticks.astype("int64"), "x_runup": r, "z_runup": smooth, "x_filled": filled, "z_filled": inpaint_runs(smooth)})
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out

    return df.select(*keys, x, t, z, sand, *([] if intensity is None else [intensity])).groupBy(*keys).applyInPandas(run, schema)


def dry_beach(df: DataFrame, keys: list[str], x: str, t: str, z: str, min_window: int, mean_window: int, name: str = "sand") -> DataFrame:
    """Moving minimum over time, short gaps along x filled, moving mean over time."""
    rows = moving_min(df, [*keys, x], t, z, min_window, "_m")
    rows = fill_max_gap(rows, [*keys, t], x, "_m", 6, name="_filled").drop("_m")
    return moving_mean(rows, [*keys, x], t, "_filled", mean_window, strict=True, name=name).drop("_filled")


def water_depth(z: str, sand: str):
    return F.col(z) - F.col(sand)


def eta(df: DataFrame, keys: list[str], z_runup: str, still: float = 0.774) -> DataFrame:
    """Mean runup elevation of each scan, the still level where it has none."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(z_runup), F.lit(still)).alias("eta"))


__all__ = ["Tracker", "dry_beach", "eta", "runup", "track_scan", "water_depth"]
