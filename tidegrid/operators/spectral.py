"""Welch spectra and bulk wave statistics, one scan at a time in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.chi2 import chi2inv


def detrend(y: np.ndarray) -> np.ndarray:
    """Less its least-squares line; the mean alone for fewer than two values."""
    if len(y) < 2:
        return y - y.mean() if len(y) else y
    t = np.arange(len(y)) - (len(y) - 1) / 2
    y = y - y.mean()
    return y - t * (t @ y) / (t @ t)


def welch(y: np.ndarray, dt: float, window_minutes: float, alpha: float = 0.05) -> dict[str, np.ndarray | float]:
    """One-sided spectrum of half-overlapping Hann segments, each scaled back to its own variance; bounds in order lo <= s <= up."""
    nfft = int(round(window_minutes * 60 / dt))
    nfft -= nfft % 2
    n = 2 * len(y) // nfft - 1 if nfft else 0
    if n < 1:
        return {"f": np.zeros(0), "s": np.zeros(0), "lo": np.zeros(0), "up": np.zeros(0), "dof": 0.0}
    y = np.nan_to_num(y - np.nanmean(y))
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(nfft) / (nfft - 1)))
    powers = []
    for i in range(n):
        part = detrend(y[i * nfft // 2 : i * nfft // 2 + nfft])
        tapered = part * hann
        spread = tapered.var(ddof=1)
        tapered = tapered * np.sqrt(part.var(ddof=1) / spread) if spread > 0 else tapered * 0
        powers.append(np.abs(np.fft.fft(tapered)[: nfft // 2 + 1] / np.sqrt(nfft)) ** 2)
    fs = 1 / dt
    df = fs / (nfft - 1)
    s = np.mean(powers, axis=0) / ((nfft // 2 + 1) * df)
    dof = 8 / 3 * n
    return {"f": np.arange(nfft // 2 + 1) * df, "s": s, "lo": dof * s / chi2inv(1 - alpha / 2, dof), "up": dof * s / chi2inv(alpha / 2, dof), "dof": dof}


SPECTRUM = [("f", T.DoubleType()), ("s", T.DoubleType()), ("lo", T.DoubleType()), ("up", T.DoubleType()), ("dof", T.DoubleType())]


def spectrum(df: DataFrame, keys: list[str], order: str, value: str, dt: float, window_minutes: float) -> DataFrame:
    """(keys, f, s, lo, up, dof) of each scan's series."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(*x) for x in SPECTRUM])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        found = pd.DataFrame(welch(detrend_missing(t[value].to_numpy(float)), dt, window_minutes))
        for k in reversed(keys):
            found.insert(0, k, t[k].iloc[0])
        return found

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def detrend_missing(y: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(y)
    if ok.sum() < 2:
        return y
    t = np.arange(len(y), dtype=float)
    slope, level = np.polyfit(t[ok], y[ok], 1)
    return y - slope * t - level


#: The bands of low and incident frequencies in Hz, lower ends excluded.
BANDS = {"ig": (0.004, 0.04), "ss": (0.04, 0.25)}


@F.pandas_udf(T.DoubleType())
def chi2_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2inv(a, b) if a == a and b == b else float("nan") for a, b in zip(p, dof)])


def wave_bulk(spectra: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]] = BANDS, a: float = 0.025) -> DataFrame:
    """(keys, band, hs, edof, lo, up, f_peak): significant height of each band, its effective degrees of freedom and bounds, and the first frequency of its greatest density."""
    rows = spectra.withColumn("band", F.explode(F.array(*[F.when((F.col("f") > lo) & (F.col("f") <= hi), F.lit(n)) for n, (lo, hi) in bands.items()]))).where("band is not null")
    step = spectra.groupBy(*keys).agg(F.max(F.when(F.col("f") > 0, F.col("f"))).alias("_m"), F.count("*").alias("_n")).select(*keys, (F.col("_m") / (F.col("_n") - 1)).alias("_df"))
    sums = rows.groupBy(*keys, "band").agg(F.sum("s").alias("_e"), F.sum(F.col("s") * F.col("s")).alias("_q"), F.max("dof").alias("_dof"), F.max_by("f", F.struct("s", -F.col("f"))).alias("f_peak")).join(step, keys)
    hs = 4 * F.sqrt(F.col("_e") * F.col("_df"))
    edof = F.when(F.col("_q") > 0, F.col("_dof") * F.col("_e") * F.col("_e") / F.col("_q") / (1 + 2 / F.col("_dof")))
    out = sums.withColumn("hs", hs).withColumn("edof", edof)
    bound = lambda p: F.col("hs") * F.sqrt(F.col("edof") / chi2_quantile(F.lit(p), "edof"))
    return out.select(*keys, "band", "hs", "edof", bound(1 - a).alias("lo"), bound(a).alias("up"), "f_peak")
