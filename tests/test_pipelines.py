import numpy as np

from tidegrid.operators import geometry
from tidegrid.plans import pipelines

EYE = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
SCHEMA = "scan_id string, pidx long, x double, y double, z double, intensity double, gps_s double"


def test_l1(spark):
    r = np.random.default_rng(1)
    n = 60000
    x, y = r.uniform(0, 6, n), r.uniform(0, 9, n)
    z = 2 + 0.05 * x + r.normal(0, 0.004, n)
    spike = (np.abs(x - 3) < 0.06) & (np.abs(y - 4) < 0.06)
    z[spike] += 1
    t = 1.3e9 + np.linspace(0, 400, n)
    rows = [("a", i, *map(float, (x[i], y[i], z[i], 50.0 if i % 50 else 150.0, t[i]))) for i in range(n)]
    o = pipelines.L1(EYE, [(0.0, 0.0), (6.0, 0.0), (6.0, 9.0), (0.0, 9.0)], cell=0.2, least_n=5, passes=((2.0, 0.2), (1.0, 0.1)))
    out = pipelines.l1_surfaces(spark.createDataFrame(rows, SCHEMA), o).toPandas()
    assert len(out) > 800 and (np.abs(out.zmean - 2 - 0.05 * out.x) < 0.03).all()
    assert out.scan_ts.nunique() == 1


def test_l2(spark):
    nodes, steps = np.arange(4.0, 24.0, 0.25), 30
    edge = 12 + 4 * np.sin(np.arange(steps) / 8)  # always-wet nodes look dry, so the swash must be wide
    rows, i = [], 0
    for s in range(steps):
        for x in nodes:
            wet = x >= edge[s]
            rows.append(("a", i, float(x), 0.0, 3 - 0.1 * float(x) + (0.3 if wet else 0.0), 40.0 if wet else 2.0, 1.3e9 + 0.5 * s))
            i += 1
    line = geometry.Transect(0.0, 0.0, 30.0, 0.0, 0.25)
    o = pipelines.L2(EYE, [(0.0, -1.0), (30.0, -1.0), (30.0, 1.0), (0.0, 1.0)], line, trim=(4.0, 24.0), k=50.0, minutes=0.1)
    grid = pipelines.l2_stack(spark.createDataFrame(rows, SCHEMA), o)
    assert grid.count() == 79 * steps and grid.where("z is null").count() == 0
    clean = pipelines.l2_cleaned(grid, o).cache()
    assert clean.select("ti").distinct().count() == steps - 1
    products = pipelines.l2_products(clean, o)
    assert products["runup"].count() == steps - 1 and products["contours"].count() == 3 * (steps - 1)
    track = products["runup"].toPandas().sort_values("ti")
    off = np.abs(track.x_runup.to_numpy(float) - edge[: steps - 1])
    assert np.isfinite(off).sum() > 5 and np.nanmedian(off) < 1.5
    assert products["contour_stats"].count() == 3 and products["bulk"].count() >= 1
