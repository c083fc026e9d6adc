import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import mixing
from tidegrid.llm.queries import op2_mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is over a cap goes to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check(rows, out):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(d), size(t)) for d, t, _ in rows)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        epochs = int(r.target // r.source_size) if r.source_size else 0
        assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    for s in sizes:  # at most one document is taken in part
        assert sum(0 < r.taken - int(r.target // r.source_size) * r.size < r.size for r in out if r.source == s and r.source_size) <= 1


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    got = mixing.mix(t).collect()
    check([tuple(r) for r in t.collect()], got)
    again = {r.doc_id: r.taken for r in op2_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "x y z", "b"), (4, "w " * 50000, "c"), (5, " \n", "d"), (5, "a b", "b"), (5, "a b", "b")]
    rows += [(100 + i, " word" * r.randrange(40) + "\t", r.choice(["", "a", "b", "Z", "é"])) for i in range(300)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, bin int")
    check(rows, mixing.mix(df).collect())
    assert mixing.mix(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000}, {"a": 5}, {"a": 0, "b": 7}, {"a": 0}, {None: 3, "b": 30, "c": 300, "d": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1.0, 3.0), quality=F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.2)).where("source = 'b'")
    part = {bool(r.good): r.n for r in mixing.mix(df, weights=(3.0, 1.0), quality=F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.2)).where("source = 'b' and taken > 0").groupBy((F.col("doc_id") % 4 < 2).alias("good")).agg(F.count("*").alias("n")).collect()}
    assert part[True] > 2 * part[False] and got.count() == 2000


def test_mixed_documents_hold_what_mix_takes(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(30))), r.choice(["a", "b", None]), "x", 7) for i in range(200)]
    rows += [(900, None, "a", "x", 7), (901, "", "b", None, None), (902, "one two", "b", "x", 7), (902, "one two", "b", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words string, part int")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = {}
    for x in out.collect():
        taken[x.doc_id] = taken.get(x.doc_id, 0) + len(x.text.split())
        whole = {t for d, t, *_ in rows if d == x.doc_id}
        assert x.text in whole or any(t and t.split()[: len(x.text.split())] == x.text.split() for t in whole)
    want = {}
    for x in mixing.mix(df).collect():
        want[x.doc_id] = want.get(x.doc_id, 0) + x.taken
    assert taken == {d: n for d, n in want.items() if n}
    assert mixing.mixed_documents(df.where(F.lit(False))).count() == 0


def test_no_bin_holds_much_of_a_source(spark):
    """Whatever the quality weight, the bin in which a budget may end is a small share of the documents."""
    for quality in (0.048, 0.2, 1.0):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col("id")), 11) + 0.5) / float(1 << 53)
        bins = spark.range(200_000).select(F.floor(mixing.BINS * F.log2(-F.log(u) / quality)).alias("bin")).groupBy("bin").count()
        assert bins.agg(F.max("count")).first()[0] < 0.001 * 200_000
