import numpy as np

from tidegrid.plans import queries


def plain_slope(rows):
    """(slope, intercept, n) of the lowest z of each x over all ticks, between the levels 0.5 and 3.5 and from x = 4 to 40; no berm."""
    low = {}
    for _, _, x, z, _ in rows:
        low[x] = min(z, low.get(x, z))
    own = [(x, z) for x, z in sorted(low.items()) if 4 <= x <= 40 and 0.5 <= z <= 3.5]
    return *np.polyfit(*zip(*own), 1), len(own)


def test_every_tick_reaches_the_fit(spark, monkeypatch):
    """Each node is dry on one tick only, of which few are divisible by 24."""
    rows = []
    for i in range(161):
        x, sand = 0.25 * i, 4.0 - 0.1 * 0.25 * i
        rows += [("a", t, x, sand + (0.0 if t == i % 47 else 0.3 + 0.01 * (i % 5)), sand) for t in range(48)]
    df = spark.createDataFrame(rows, "scan string, ti long, x double, z double, sand double")
    monkeypatch.setattr(queries, "beach", lambda spark, sf_dir: df)
    got = queries.foreshore_slope(spark, "").first()
    slope, intercept, n = plain_slope(rows)
    assert got.n == n and np.isclose(got.slope, slope, atol=1e-4) and np.isclose(got.intercept, intercept, atol=5e-3)
    assert np.isclose(got.slope, -0.1, atol=1e-4) and np.isclose(got.intercept, 4.0, atol=5e-3)
