import base64
import gzip
import hashlib
import io

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import warc
from tidegrid.llm.common import open_fs
from tidegrid.llm.queries import op3_warc


def plain(rows, least=0):
    first = {}
    for key, html in rows:
        p = (html or "").encode()
        if key is not None and len(p) >= least:
            first[p] = min(first.get(p, key), key)
    out = []
    for key, html in rows:
        p = (html or "").encode()
        to = first.get(p)
        to = None if to == key else to
        out.append(str((key, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to)))
    return sorted(out)


def got(out):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out.collect())


def test_whole_table(spark):
    t = ds.dataset("/root/testdata/sf0.001/pages.parquet").to_table().to_pylist()
    assert got(op3_warc(spark, "/root/testdata/sf0.001")) == plain([(r["page_id"], r["html"]) for r in t])


ROWS = [(1, None, None), (2, "u", ""), (9, "v", "same"), (4, "w", "same"), (7, "é\r\nx", "ü" * 300000), (7, "y", "other"), (None, "z", "same"), (8, "q", "WARC/1.1\r\n\r\n\r\n\r\n"), (4, "w", "same")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, b"x") for r in ROWS], "page_id long, url string, html string, size int, sha1 binary")
    pairs = [(r[0], r[2]) for r in ROWS]
    assert got(warc.write_and_read(df)) == plain(pairs)
    assert got(warc.write_and_read(df, least=5)) == plain(pairs, least=5)
    assert warc.write_and_read(df.where(F.lit(False))).count() == 0
    kept = {r.page_id: bytes(r.payload).decode() for r in warc.write_and_read(df).where("record_type = 'response' and page_id is not null").collect()}
    assert kept[4] == "same" and kept[8] == ROWS[7][2]


def test_archives_are_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string")
    listed = warc.write(df.coalesce(1), f"file://{tmp_path}/w", most_bytes=4000).collect()
    assert len(listed) > 5 and sum(r.n_records for r in listed) == 200
    files, path = open_fs(listed[0].path)
    raw = files.open_input_stream(path).read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == listed[0].n_records
    assert sum(1 for _ in warc.members(io.BytesIO(raw))) == listed[0].n_records
    for chunk in (1, 7, 1 << 20):
        assert sum(len(b"".join(m)) for m in warc.members(io.BytesIO(raw), chunk)) == len(gzip.decompress(raw))


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", 7, warc.digest(b"payload"), None)
    assert [r.http[1] for r in warc.records(io.BytesIO(good + good))] == [b"payload"] * 2
    text = gzip.decompress(good)
    for bad in (text.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"), text.replace(b"payload\r\n\r\n", b"payloads\r\n\r\n"), text[:-3], b"HTTP" + text):
        with pytest.raises(warc.Broken):
            list(warc.records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.Broken):
        list(warc.records(io.BytesIO(good[:-5])))


def test_very_long_urls_come_back(spark):
    rows = [(1, "u" * (3 << 20), "one"), (2, "v" * (3 << 20), "one"), (3, None, "two")]
    out = warc.write_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (len(r.url), r.record_type, r.refers_to) for r in out} == {1: (3 << 20, "response", None), 2: (3 << 20, "revisit", 1), 3: (0, "response", None)}
