import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import basic, times
from tidegrid.functions.chi2 import chi2inv
from tidegrid.operators import contours, gaps, geometry, inpaint, planefit, profiles, raster, runup, spectral, stencil, windows


def series(spark, values, key=0):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k int, i long, v double")


def got(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_half_hours(spark):
    rows = [("2024-01-01 10:14:59",), ("2024-01-01 10:15:00",), ("2024-01-01 10:44:59",), ("2024-01-01 10:45:00",), ("2024-01-01 23:59:59",)]
    df = spark.createDataFrame(rows, "s string").select(F.to_timestamp_ntz("s").alias("ts"))
    a = [str(r[0]) for r in df.select(times.half_hour("ts")).collect()]
    b = [str(r[0]) for r in df.select(times.half_hour_by_minute("ts")).collect()]
    assert a == b == ["2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 10:30:00", "2024-01-01 11:00:00", "2024-01-02 00:00:00"]


def test_names_and_gps(spark):
    df = spark.createDataFrame([("x/do-lidar_1700000000.laz", "timestackraw_0721_1530.mat"), ("do-lidar_x.laz", "none")], "a string, b string")
    r = df.select(times.seconds_of_name("a").alias("a"), times.time_of_name("b", 2024).alias("b")).collect()
    assert r[0].a == 1700000000 and str(r[0].b) == "2024-07-21 15:30:00" and r[1].a is None and r[1].b is None
    g = spark.range(1).select(times.at_micros(times.gps_micros(F.lit(0.0), F.lit(2e9))).alias("t")).first().t
    assert str(g) == "1980-01-06 00:00:00"


def test_polygon_border_is_inside(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    pts = [(0.0, 0.0, True), (2.0, 0.0, True), (4.0, 2.0, True), (2.0, 2.0, True), (4.1, 2.0, False), (-1.0, 4.0, False), (2.0, 4.0, True)]
    df = spark.createDataFrame(pts, "x double, y double, want boolean")
    assert df.where(geometry.in_polygon("x", "y", square) != F.col("want")).count() == 0


def test_transect(spark):
    line = geometry.Transect(476190.0618275550, 3636333.442333425, 475620.6132784432, 3636465.645345889, 0.25, 300.0)
    assert line.n_nodes == 1139 and math.isclose(line.length + 300, 584.5932659, abs_tol=1e-6) and math.isclose(line.angle, 2.9134740, abs_tol=1e-6)
    df = spark.createDataFrame([(line.x0, line.y0), (line.x1, line.y1)], "x double, y double")
    r = geometry.near_line(df, line, "x", "y", 1e-6).orderBy("along").collect()
    assert r[0].xi == 0 and r[1].xi == 1138
    off = line.shifted(2.0)
    assert math.isclose(spark.createDataFrame([(off.x0, off.y0)], "x double, y double").select(line.across("x", "y")).first()[0], 2.0, abs_tol=1e-6)


def test_lower_half(spark):
    rows = [(1, 10.0 + 0.001 * i) for i in range(23)] + [(2, 5.0)] * 11 + [(3, -5.0)] * 11 + [(4, 7.0)] * 10 + [(5, 0.0)] * 11
    df = spark.createDataFrame(rows, "c int, z double")
    out = {r.c: r for r in raster.lower_half_stats(df, ["c"], "z").collect()}
    assert set(out) == {1, 2, 5}  # no spread and a negative mean is dropped, ten values are too few
    assert out[1].n == 12 and math.isclose(out[1].zmean, 10.0055) and out[1].zmax == out[1].zmean and out[1].zmin == 10.0
    assert out[2].zstd == 0 and out[2].zmode == 5.0
    true = {r.c: r.zmax for r in raster.lower_half_stats(df, ["c"], "z", true_max=True).collect()}
    assert math.isclose(true[1], 10.011)


def test_order_does_not_matter(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), r.gauss(10, 0.01)) for _ in range(300)]
    a = raster.lower_half_stats(spark.createDataFrame(rows, "c int, z double"), ["c"], "z").orderBy("c").collect()
    r.shuffle(rows)
    assert a == raster.lower_half_stats(spark.createDataFrame(rows, "c int, z double").repartition(7), ["c"], "z").orderBy("c").collect()


def test_percentile_by_midpoints(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)] + [(1, 5.0)], "k int, v double")
    assert {r.k: r.p for r in raster.prctile(df, ["k"], "v", 25).collect()} == {0: 1.5, 1: 5.0}
    assert {r.k: r.p for r in raster.prctile(df, ["k"], "v", 100).collect()} == {0: 4.0, 1: 5.0}


def test_gaps(spark):
    v = [None, None, 1.0, None, None, None, None, 6.0, None, None, None, None, None, 12.0, None]
    df = series(spark, v)
    assert got(gaps.gap_size(df, ["k"], "i", "v"), "gap") == [2, 2, 0, 4, 4, 4, 4, 0, 5, 5, 5, 5, 5, 0, 1]
    assert got(gaps.fill_small(df, ["k"], "i", "v", 4), "filled") == [None, None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, None, None, None, 12.0, None]
    assert got(gaps.fill_max_gap(df, ["k"], "i", "v", 5, ends=False), "filled") == got(gaps.fill_small(df, ["k"], "i", "v", 4), "filled")
    assert got(gaps.fill_max_gap(df, ["k"], "i", "v", 6), "filled") == [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 13.0]
    assert got(gaps.fill_max_gap(series(spark, [None, 3.0, None]), ["k"], "i", "v", 6), "filled") == [None, 3.0, None]
    assert got(gaps.reflect_pad(series(spark, [1.0, 2.0, 3.0]), ["k"], "i", 2), "v") == [1.0, 2.0, 3.0, 3.0, 2.0]


def test_windows(spark):
    df = series(spark, [4.0, None, 2.0, 8.0, 1.0])
    assert got(windows.moving_min(df, ["k"], "i", "v", 2), "movmin") == [4.0, 4.0, 2.0, 2.0, 1.0]
    assert got(windows.moving_mean(df, ["k"], "i", "v", 3, strict=True), "movmean") == [None, None, None, 11 / 3, 4.5]
    assert got(windows.moving_mean(df, ["k"], "i", "v", 3), "movmean") == [4.0, 3.0, 5.0, 11 / 3, 4.5]
    assert got(windows.median3_interior(df, ["k"], "i", "v"), "median3") == [4.0, None, 5.0, 2.0, 1.0]
    assert got(windows.zero_padded_median(series(spark, [5.0, 4.0, 3.0]), ["k"], "i", "v", 5), "medfilt") == [3.0, 3.0, 3.0]
    assert got(windows.zero_padded_median(df, ["k"], "i", "v", 3), "medfilt") == [None, None, None, 2.0, 1.0]


def grid(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)], "x int, t long, v double")


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.x, r.t] = r[name]
    return out


def test_stencils(spark):
    r = np.random.default_rng(1)
    a = np.round(r.normal(size=(7, 6)), 2)
    a[3, 2] = np.nan
    kernels = {"gx": stencil.SOBEL_X, "gt": stencil.SOBEL_T, "lap": stencil.LAPLACIAN}
    out = stencil.convolve(grid(spark, a), [], "x", "t", "v", kernels)
    p = np.pad(a, 1)
    for name, k in kernels.items():
        flipped = np.array(k, float)[::-1, ::-1]
        want = np.zeros_like(a)
        for i in range(3):
            for j in range(3):
                if flipped[i, j]:
                    want = want + flipped[i, j] * p[i : i + 7, j : j + 6]
        assert np.allclose(back(out, name, a.shape), want, equal_nan=True)
    med = back(stencil.median2d(grid(spark, a), [], "x", "t", "v", 3, 2), "med2d", a.shape)
    for i in range(7):
        for j in range(6):
            near = p[i : i + 3, j + 1 : j + 3].ravel()
            assert np.isnan(med[i, j]) if np.isnan(a[i, j]) else math.isclose(med[i, j], np.median(near[~np.isnan(near)]))


def test_dilation(spark):
    m = np.zeros((9, 5))
    m[4, 2] = 1
    df = grid(spark, m).withColumn("m", F.col("v") > 0)
    out = back(stencil.dilate(df, [], "x", "t", "m").withColumn("d", F.col("dilated").cast("double")), "d", m.shape)
    want = np.zeros_like(m)
    want[2:8, 2:4] = 1
    assert (out == want).all()


def test_outliers_of_a_smooth_stack(spark):
    a = np.add.outer(np.linspace(0, 1, 30), 0.01 * np.sin(np.arange(40)))
    a[15, 20] += 5
    df = grid(spark, a).withColumn("s", F.lit("a"))
    out = stencil.outlier_mask(df, ["s"], "x", "t", "v", 10, 3.0)
    masked = {(r.x, r.t) for r in out.where("masked").collect()}
    assert (15, 20) in masked and len(masked) < 120


def test_contours(spark):
    a = np.array([[9, 1, 20, np.nan], [12, 2, 20, 5], [30, 3, 20, np.nan], [8, 4, 10, 7]], float)
    out = contours.seaward_contour(grid(spark, a), [], "t", "x", "v", [10.0])
    assert {r.t: r.x for r in out.collect()} == {0: 2, 1: None, 2: 2, 3: None}
    s = contours.contour_stats(out, ["threshold"], "x").first()
    assert (s.mean, s.std, s.least, s.most, s.valid) == (2.0, 0.0, 2, 2, 0.5)


def test_fits(spark):
    rows = [(0, x, 2 + 3 * x - 0.5 * x * x) for x in range(8)] + [(1, 1, 5.0), (1, 1, 6.0)]
    df = spark.createDataFrame(rows, "k int, x int, z double")
    q = {r.k: r for r in profiles.quadratic_fit(df, ["k"], "x", "z").collect()}
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((q[0].c0, q[0].c1, q[0].c2), (2, 3, -0.5))) and q[1].c0 is None
    bent = df.unionByName(spark.createDataFrame([(0, 4, 90.0)], df.schema))
    assert profiles.drop_off_quadratic(bent, ["k"], "x", "z", most=60.0).where("k = 0").count() == 8
    line = spark.createDataFrame([(0, x, 4 - 0.1 * x) for x in range(9)] + [(1, x, 1.0) for x in range(5)], "k int, x int, z double")
    f = {r.k: r for r in profiles.linear_fit(line, ["k"], "x", "z").collect()}
    assert math.isclose(f[0].slope, -0.1) and math.isclose(f[0].intercept, 4) and f[1].slope is None


def test_slope_of_a_beach(spark):
    rows = [("a", 0.5 * i, 4 - 0.1 * 0.5 * i, 0.01, 1.0, 3.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, x double, z double, v double, lo double, hi double")
    s = profiles.foreshore_slope(df, ["k"], "x", "z", "v", "lo", "hi", x_off=40.0).first()
    assert math.isclose(s.slope, -0.1, rel_tol=1e-6)


def test_planes(spark):
    r = np.random.default_rng(2)
    x, y = r.uniform(0, 30, 4000) + 476000, r.uniform(0, 40, 4000) + 3636000
    z = 1 + 0.05 * (x - 476000) - 0.02 * (y - 3636000) + r.normal(0, 0.005, 4000)
    spikes = r.choice(4000, 40, replace=False)
    z[spikes] += 1.5
    df = spark.createDataFrame([("s", float(a), float(b), float(c), i) for i, (a, b, c) in enumerate(zip(x, y, z))], "scan string, x double, y double, z double, id int")
    kept = {q.id for q in planefit.two_pass_filter(df, ["scan"], "x", "y", "z").collect()}
    assert not kept & set(spikes.tolist()) and len(kept) > 3500
    fit = planefit.plane_fit(df.where(~F.col("id").isin(spikes.tolist())), ["scan"], "x", "y", "z").first()
    assert abs(-fit.a / fit.c - 0.05) < 1e-3 and abs(-fit.b / fit.c + 0.02) < 1e-3


def test_points_on_shared_edges_are_kept_once(spark):
    rows = [("s", 0.9 * i, 2.7 * j, 1.0) for i in range(13) for j in range(13)]
    df = spark.createDataFrame(rows + rows[:5], "scan string, x double, y double, z double")
    assert planefit.residual_filter(df, ["scan"], "x", "y", "z", size=3.0, most=0.1).count() == len(rows) + 5


@pytest.mark.parametrize("method", [0, 1, 3, 4, 5])
def test_inpaint_keeps_what_is_known(method):
    r = np.random.default_rng(method)
    a = np.exp(np.add.outer(np.linspace(0, 1, 9), np.linspace(0, 1, 8)))
    holes = a.copy()
    holes[r.random(a.shape) < 0.2] = np.nan
    out = inpaint.inpaint(holes, method)
    assert (out[~np.isnan(holes)] == holes[~np.isnan(holes)]).all() and np.isfinite(out).all()
    assert np.abs(out - a).max() < (0.1 if method in (0, 1, 3) else 2)


def test_inpaint_of_lines():
    n = np.nan
    for f in (inpaint.inpaint, inpaint.inpaint_runs):
        assert np.allclose(f(np.array([0, 0, n, n, 3, 0.0])), [0, 0, 1.5, 3, 3, 0])
        assert np.allclose(f(np.array([0, 1, 2, n, n, 5, 6.0])), range(7))
        assert np.allclose(f(np.array([n, 1, 3, n])), [-1, 1, 3, 5])
    r = np.random.default_rng(3)
    v = r.normal(size=80)
    v[r.random(80) < 0.3] = n
    assert np.allclose(inpaint.inpaint_runs(v), inpaint.inpaint(v))
    assert np.allclose(inpaint.inpaint(np.array([[1, 2, 3], [2, n, 4], [3, 4, 5.0]]), 2)[1, 1], 3)
    with pytest.raises(ValueError):
        inpaint.inpaint(v, 2)
    assert np.isfinite(inpaint.diffuse(v[:, None])).all() and np.isfinite(inpaint.gaussian_fill(v.reshape(10, 8))).all()


def test_chi2():
    assert math.isclose(chi2inv(0.95, 10), 18.307038, abs_tol=1e-5)
    assert math.isclose(chi2inv(0.025, 8 / 3 * 3), 2.179731, abs_tol=1e-5)
    assert math.isnan(chi2inv(1.0, 3))


def test_spectrum_of_a_sine(spark):
    t = np.arange(2400) * 0.5
    a = 0.4
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in enumerate(a * np.sin(2 * np.pi * 0.1 * t))], "k string, i long, v double")
    s = spectral.spectrum(df, ["k"], "i", "v", 0.5, 5)
    rows = s.collect()
    assert all(r.lo <= r.s <= r.up for r in rows)
    peak = max(rows, key=lambda r: r.s)
    assert abs(peak.f - 0.1) < 0.005
    bulk = {r.band: r for r in spectral.wave_bulk(s, ["k"]).collect()}
    assert abs(bulk["ss"].hs - 4 * a / math.sqrt(2)) < 0.05 and bulk["ss"].lo < bulk["ss"].hs < bulk["ss"].up
    assert len(spectral.welch(np.zeros(10), 0.5, 5)["f"]) == 0


def sheet(n=300, nodes=400, dx=0.1):
    x = np.arange(nodes) * dx
    sand = 4 - 0.1 * x
    edge = 20 + 3 * np.sin(2 * np.pi * np.arange(n) / 60)
    z = sand[:, None] + np.where(x[:, None] >= edge[None, :], 0.3, 0.0)
    return x, sand, edge, z


def test_tracker_follows_a_sheet_of_water(spark):
    x, sand, edge, z = sheet()
    r = runup.track_scan(z, np.repeat(sand[:, None], z.shape[1], 1), x, 0.1, 39.0)
    assert np.isfinite(r[6:]).all() and np.abs(r[6:-1] - edge[6:-1]).max() < 0.6
    rows = [("a", int(i), float(x[j]), float(z[j, i]), float(sand[j])) for i in range(60) for j in range(0, 400, 2)]
    out = runup.runup(spark.createDataFrame(rows, "scan string, ti long, x double, z double, sand double"), ["scan"], x_off=39.0).orderBy("ti").collect()
    assert len(out) == 60 and all(abs(o.x_runup - e) < 1.0 for o, e in list(zip(out, edge))[6:-1])


def test_dry_beach(spark):
    rows = [("a", x, t, 1.0 + (0.3 if t % 10 < 3 else 0.0)) for x in range(5) for t in range(60)]
    df = spark.createDataFrame(rows, "scan string, x int, t int, z double")
    sand = runup.dry_beach(df, ["scan"], "x", "t", "z", 20, 10).collect()
    assert all(math.isclose(r.sand, 1.0) for r in sand)


def test_subsample(spark):
    df = spark.createDataFrame([(0, i) for i in range(50)] + [(1, i) for i in range(5)], "k int, i int")
    out = profiles.every_nth_and_last(df, ["k"], "i", 24).orderBy("k", "i").collect()
    assert [(r.k, r.i, r["last"]) for r in out] == [(0, 2, False), (0, 26, False), (0, 49, True), (1, 4, True)]


def test_helpers(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, 0.0), (2.0, 1.0, 2.0)], "a double, b double, c double")
    r = df.select(basic.nan_to_null("a").alias("a"), basic.ratio(F.col("b"), F.col("c")).alias("r"), basic.cell(F.lit(-0.25), 0.1).alias("c")).collect()
    assert r[0].a is None and r[0].r is None and r[1].r == 0.5 and r[0].c == -3 or r[0].c == -2
