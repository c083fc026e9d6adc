"""The tracker, the spectrum and the solvers against plain step-by-step versions."""

import math

import numpy as np
import pytest

from tidegrid.operators import inpaint, profiles, runup, spectral

NAN = float("nan")


def median(values):
    own = sorted(v for v in values if v == v)
    n = len(own)
    return NAN if not n else (own[(n - 1) // 2] + own[n // 2]) / 2


def first_crossing(x, y, lo, hi, level):
    found = set()
    for k in range(len(x) - 1):
        a, b = y[k] - level, y[k + 1] - level
        if a * b <= 0 and a != b:
            p = x[k] + (x[k + 1] - x[k]) * (a / (a - b))
            if lo <= p <= hi:
                found.add(p)
    for p in sorted(found):
        near = min(range(len(x)), key=lambda k: abs(x[k] - p))
        own = [k for k in range(max(0, near - 15), min(len(x), near + 16)) if lo <= x[k] <= hi]
        turns = sum(abs(np.sign(y[b] - level) - np.sign(y[a] - level)) > 0 for a, b in zip(own, own[1:]))
        if len(own) > 2 and turns <= 1:
            return p
    return NAN


def plain_track(z, sand, x, threshold, x_off, intensity=None, bright=30.0):
    z, (nodes, n) = z.copy(), z.shape
    half, out, segment = 0.5 / (x[1] - x[0]), [], (0.0, x_off, threshold)
    for i in range(n):
        if intensity is not None:
            for k in range(nodes):
                if intensity[k, i] > bright:
                    z[k, i] = NAN
        padded = [0.0, 0.0, *sand[:, i], 0.0, 0.0]
        beach = [sorted(padded[k : k + 5])[2] for k in range(nodes)]
        water = [median(z[k, i - 1 : i + 2]) if 2 <= i < n - 1 else z[k, i] for k in range(nodes)]
        deep = [w - b for w, b in zip(water, beach)]
        level = []
        for k in range(nodes):
            own = [v for v in deep[max(0, k - 2) : k + 3] if v == v]
            level.append(sum(own) / len(own) if own else NAN)
        last = [p for p in out[-4:] if p == p]
        center = sum(last) / len(last) if len(out) >= 4 and last else NAN
        if i >= 4 and out[-1] == out[-1]:
            segment = (max(4.0, center) - half, max(4.0, center) + half, threshold)
        p = first_crossing(x, level, *segment)
        if p != p:
            segment = (center - 2 * half, center + 2 * half, threshold + 0.01) if i >= 5 and center == center else (0.0, x_off, threshold)
            p = first_crossing(x, level, *segment)
        out.append(p)
    return np.array(out), z


def stack(seed, missing, noise=0.0, n=70, nodes=160):
    r = np.random.default_rng(seed)
    x = np.arange(nodes) * 0.25
    sand = np.repeat((4 - 0.1 * x)[:, None], n, 1)
    edge = 19.8 + 2 * np.sin(np.arange(n) / 7)
    z = sand + np.where(x[:, None] >= edge, 0.3, 0.0) + noise * r.normal(size=sand.shape)
    z[(x >= 6) & (x <= 11), 7:] += 0.3  # a puddle
    for i in missing:
        z[:, max(0, i - 1) : i + 2] = NAN
    z[r.random(z.shape) < 0.05] = NAN
    return x, sand, z


@pytest.mark.parametrize("seed,missing,noise", [(1, [], 0.0), (2, [9], 0.0), (3, [9, 23, 24, 50], 0.0), (4, [12, 30], 0.05), (5, [], 0.08)])
def test_tracker_equals_the_plain_one(seed, missing, noise):
    x, sand, z = stack(seed, missing, noise)
    want, _ = plain_track(z, sand, x, 0.1, 39.0)
    got = runup.track_scan(z.copy(), sand, x, 0.1, 39.0)
    assert np.allclose(got, want, atol=1e-12, equal_nan=True) and np.isfinite(want).sum() > 30


def test_a_missing_step_does_not_send_the_track_to_a_puddle():
    x, sand, z = stack(2, [9])
    got = runup.track_scan(z, sand, x, 0.1, 39.0)
    assert np.nanmin(got[14:]) > 15


def test_intensity_masks_step_by_step(spark):
    x, sand, z = stack(6, [])
    bright = np.where(np.random.default_rng(0).random(z.shape) < 0.3, 50.0, 10.0)
    want, masked = plain_track(z, sand, x, 0.1, 39.0, bright)
    own = z.copy()
    assert np.allclose(runup.track_scan(own, sand, x, 0.1, 39.0, bright), want, atol=1e-12, equal_nan=True)
    assert np.array_equal(own, masked, equal_nan=True)
    assert not np.allclose(want, plain_track(z, sand, x, 0.1, 39.0)[0], equal_nan=True)
    rows = [("a", i, float(x[k]), None if z[k, i] != z[k, i] else float(z[k, i]), float(sand[k, i]), float(bright[k, i])) for i in range(z.shape[1]) for k in range(len(x))]
    df = spark.createDataFrame(rows, "scan string, ti long, x double, z double, sand double, intensity double")
    out = runup.runup(df, ["scan"], x_off=39.0, intensity="intensity").orderBy("ti").collect()
    assert np.allclose([NAN if o.x_runup is None else o.x_runup for o in out], want, atol=1e-12, equal_nan=True)


def test_nearest_node_rounds_and_falls_to_the_last():
    x = np.arange(4, 8, 0.25)
    assert runup.nearest_node(x, np.array([3.0, 4.0, 4.04, 4.13, 4.3, 7.7, 9.0, NAN])).tolist() == [0, 15, 15, 0, 1, 15, 15, 15]


def test_spectrum_equals_the_formula():
    r = np.random.default_rng(4)
    y, dt, nfft = r.normal(size=700), 0.5, 60
    got = spectral.welch(y, dt, 0.5)
    y = y - y.mean()
    hann = np.array([0.5 * (1 - math.cos(2 * math.pi * k / (nfft - 1))) for k in range(nfft)])
    parts, t = [], np.arange(nfft)
    for a in range(0, len(y) - nfft + 1, nfft // 2):
        own = y[a : a + nfft]
        own = own - np.polyval(np.polyfit(t, own, 1), t)
        tapered = own * hann * math.sqrt(own.var(ddof=1) / (own * hann).var(ddof=1))
        parts.append([abs(sum(tapered * np.exp(-2j * math.pi * k * t / nfft))) ** 2 / nfft for k in range(nfft // 2 + 1)])
    want = np.mean(parts, axis=0) / ((nfft / 2 + 1) * (1 / dt) / (nfft - 1))
    assert len(parts) == 2 * 700 // nfft - 1 and np.allclose(got["s"], want, rtol=1e-12, atol=1e-12)


def test_peak_frequency(spark):
    df = spark.createDataFrame([("a", f, s, 8.0) for f, s in ((0.0, 9.0), (0.01, 1.0), (0.02, 3.0), (0.03, 3.0), (0.1, 2.0), (0.2, 5.0), (0.3, 50.0))], "k string, f double, s double, dof double")
    assert {r.band: r.f_peak for r in spectral.wave_bulk(df, ["k"]).collect()} == {"ig": 0.02, "ss": 0.2}


def test_large_holes_by_conjugate_gradients():
    r = np.random.default_rng(5)
    grid = r.normal(size=(30, 40)).cumsum(0).cumsum(1)
    grid[5:20, 8:30] = NAN
    grid[25, 35] = grid[2, 3] = NAN
    for method in inpaint.METHODS:
        dense = inpaint.inpaint(grid, method)
        old = inpaint.solve.__defaults__
        inpaint.solve.__defaults__ = (50,)
        try:
            assert np.allclose(inpaint.inpaint(grid, method), dense, atol=1e-5 * np.abs(dense).max()), method
        finally:
            inpaint.solve.__defaults__ = old


def test_fits_do_not_round(spark):
    x = 480_000 + np.arange(60) * 0.05
    df = spark.createDataFrame([(0, float(a), float(0.1 * (a - 480_000)), float(1 + 0.2 * (a - 480_000) - 0.03 * (a - 480_000) ** 2)) for a in x], "k int, x double, z double, q double")
    line = profiles.linear_fit(df, ["k"], "x", "z").first()
    assert math.isclose(line.slope, 0.1, rel_tol=1e-6)
    near = df.selectExpr("k", "x - 480000 AS x", "z", "q")
    c = profiles.quadratic_fit(near, ["k"], "x", "q").first()
    assert np.allclose([c.c0, c.c1, c.c2], [1, 0.2, -0.03], atol=1e-7)
    far = profiles.drop_off_quadratic(df, ["k"], "x", "q", most=1e-3)
    assert far.count() == 60
