import datetime as dt

import numpy as np
import pytest

from tidegrid.sources import catalog, config, las
from tidegrid.streaming import streams


def test_las(spark, tmp_path):
    r = np.random.default_rng(1)
    n = 2500
    x, y, z = r.uniform(476000, 476100, n), r.uniform(3636000, 3636100, n), r.uniform(0, 5, n)
    las.write_las(str(tmp_path / "do-lidar_1700000000.las"), x, y, z, np.arange(n) % 300, np.arange(n) * 0.01 + 1e9)
    las.write_las(str(tmp_path / "do-lidar_1700001800.las"), x[:3], y[:3], z[:3], [1, 2, 3], [0.0, 1.0, 2.0])
    spark.dataSource.register(las.LasSource)
    df = spark.read.format("las").option("pointsPerPartition", "1000").load(str(tmp_path))
    got = df.where("scan_id = 'do-lidar_1700000000'").orderBy("pidx").toPandas()
    assert len(got) == n and df.count() == n + 3 and df.rdd.getNumPartitions() == 4
    assert np.abs(got.x - x).max() < 0.0006 and np.abs(got.z - z).max() < 0.0006
    assert (got.intensity == np.arange(n) % 300).all() and (got.gps_s == np.arange(n) * 0.01 + 1e9).all()
    with pytest.raises(ValueError):
        las.header(b"LASF" + bytes(100) + b"\x81" + bytes(300))


def test_config(tmp_path):
    site = config.Site(dataFolder="/d", transformMatrix=((1.0, 2.0), (3.0, 4.0)), LidarBoundary=((0.0, 1.0),))
    config.write_site(site, tmp_path / "c.json")
    assert config.read_site(tmp_path / "c.json") == site
    (tmp_path / "c.json").write_text('{"dataFolder": "/e", "other": 1}')
    assert config.read_site(tmp_path / "c.json").dataFolder == "/e"


def test_manifest(spark, tmp_path):
    for name in ("do-lidar_60.laz", "do-lidar_x.laz", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = sorted(catalog.manifest(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert [r.file_ts for r in got] == [dt.datetime(1970, 1, 1, 0, 1), None]


ROW = "day date, scan_ts timestamp_ntz, x double, y double, zmean double, zmax double, zmin double, zmode double, zstd double"


def surfaces(spark, rows):
    return spark.createDataFrame([(d, dt.datetime(d.year, d.month, d.day, h), x, 0.0, z, z, z, z, 0.0) for d, h, x, z in rows], ROW)


def test_days_are_replaced_one_by_one(spark, tmp_path):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    folder = str(tmp_path / "t")
    assert catalog.read_days(spark, folder).count() == 0
    catalog.write_days(surfaces(spark, [(a, 1, 0.0, 1.0), (b, 1, 0.0, 2.0)]), folder)
    catalog.write_days(surfaces(spark, [(b, 2, 0.0, 3.0)]), folder)
    assert sorted((r.day, r.zmean) for r in catalog.read_days(spark, folder).collect()) == [(a, 1.0), (b, 3.0)]


def test_stream_stores_the_first_of_each_key(spark, tmp_path):
    a = dt.date(2024, 1, 1)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(a, 1, 0.0, 1.0), (a, 1, 0.0, 9.0), (a, 2, 0.0, 2.0)], [(a, 1, 0.0, 7.0), (a, 3, 0.0, 3.0)]):
        surfaces(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        streams.store_surfaces(stream, folder, str(tmp_path / "cp"), ["scan_ts", "x", "y"], "zmean").awaitTermination()
    assert sorted(r.zmean for r in catalog.read_days(spark, folder).collect()) == [1.0, 2.0, 3.0]


def test_stream_equals_batch_for_sessions(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 55)]
    spark.createDataFrame(rows, "k int, ts timestamp_ntz").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k int, ts timestamp_ntz").parquet(str(tmp_path / "s"))
    out = streams.drained(streams.scan_sessions(stream, "ts", ["k"]), str(tmp_path / "out"), "complete")
    assert sorted(r.n for r in out.collect()) == [1, 2]
