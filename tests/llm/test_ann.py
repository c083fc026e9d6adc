import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tidegrid.llm import ann
from tidegrid.llm.queries import op8_ann


def plain(ids, vectors, every=50, k=5):
    v = np.array(vectors, np.float64)
    norm = np.sqrt((v * v).sum(1))
    out = {}
    for i, key in enumerate(ids):
        if key % every == 0:
            s = (v * v[i]).sum(1) / (norm * norm[i])
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != key][:k]
            out[key] = [(ids[j], float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def recall(want, got):
    assert want.keys() == got.keys()
    return np.mean([len({x[0] for x in want[q]} & {x[0] for x in got[q]}) / max(1, len(want[q])) for q in want])


def test_whole_table_is_exact_where_all_is_ranked(spark):
    t = ds.dataset("/root/testdata/sf0.001/embeddings.parquet").to_table().to_pylist()
    want = plain(np.array([r["vec_id"] for r in t]), [r["embedding"] for r in t])
    got = found(op8_ann(spark, "/root/testdata/sf0.001"))
    assert recall(want, got) == 1.0
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(want[q], got[q]))


def test_recall_with_a_cluster_and_copies(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(6000, 32))
    v[1000:2200] = v[7] + 0.07 * r.normal(size=(1200, 32))
    v[3000:3400] = v[3000]
    ids = r.permutation(6000)
    df = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in zip(ids, v)], "vec_id long, embedding array<double>, block int")
    want, got = plain(ids, v), found(ann.search(df, rerank=256, block=2048, group=60))
    assert recall(want, got) >= 0.95
    for q in want:
        if q in ids[3000:3400]:
            assert [x[0] for x in got[q]] == [x[0] for x in want[q]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [1.0, None]), (250, [1.0, inf]), (None, [1.0, 1.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 1.0]), (300, [1.0, 2.0, 3.0]), (350, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    got = found(ann.search(df))
    assert got == {0: [(2, 1.0), (3, 1.0), (4, 0.0)]}
    assert ann.search(df.where(F.lit(False))).count() == 0


def test_beam_search_beats_the_greedy_code():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.fit(x, books=4, size=64)
    errors = [np.square(model.sums(model.encode(x, beam)[0]) - x).sum() for beam in (1, 4, 16)]
    assert errors[0] > errors[1] > errors[2]
    codes, lengths = model.encode(x[:10])
    scores = model.scores(x[:3], codes, lengths)
    sums = model.sums(codes)
    assert np.allclose(scores, x[:3] @ sums.T / np.linalg.norm(sums, axis=1), atol=1e-5)


def test_repeated_rows_count_once(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(120, 8))
    v[51] = v[50]
    ids = list(range(120)) + [50] * 6 + [1] * 9 + [51] * 3
    df = spark.createDataFrame([(i, v[i].tolist()) for i in ids], "vec_id long, embedding array<double>")
    assert found(ann.search(df)) == found(ann.search(df.dropDuplicates(["vec_id"])))
    got, want = found(ann.search(df)), plain(np.arange(120), v)
    assert {q: [x[0] for x in own] for q, own in got.items()} == {q: [x[0] for x in own] for q, own in want.items()}
    assert got[50][0][0] == 51


def test_recall_of_the_defaults(spark):
    v = np.random.default_rng(7).normal(size=(9000, 64))
    want = plain(np.arange(9000), v)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert recall(want, found(ann.search(df))) >= 0.97
