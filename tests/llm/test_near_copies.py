import random

import numpy as np
import pyarrow.dataset as ds

import corpus_pipeline
from tidegrid.llm import near_copies

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_kept(rows):
    """doc_ids of the least of each component, by every pair."""
    root, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if root[i] == i}


def planted():
    """(doc_id, text) of originals of 200 words and one copy each with some words in a row replaced: similarity 0.74 to 0.95."""
    r = random.Random(4)
    rows = []
    for n in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        k = 1 + n % 25
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:90] + [f"x{n}y{i}" for i in range(k)] + words[90 + k :]))]
    return rows


def test_planted_copies_at_080_to_095_go_and_less_similar_ones_stay(spark):
    rows = planted()
    sim = {b[0]: jaccard(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[::2], rows[1::2])}
    assert min(sim.values()) < 0.78 and sum(0.8 <= s < 0.85 for s in sim.values()) >= 5 and sum(0.85 <= s < 0.95 for s in sim.values()) >= 10
    df = spark.createDataFrame([(*x, "s") for x in rows], SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == {i for i, _ in rows if sim.get(i, 0) < 0.8} == plain_kept(rows)


def test_documents_against_every_pair(spark):
    t = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    rows = [(x["doc_id"], x["text"]) for x in t if x["text"] and x["text"].split()]
    df = spark.createDataFrame([(*x, "s") for x in rows], SCHEMA)
    assert {x.doc_id for x in near_copies.one_of_each(df).collect()} == plain_kept(rows)


def test_large_keys_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(90):
        k = r.randrange(3) if n % 2 else r.randrange(4, 30)
        at = r.randrange(120)
        rows.append((n, " ".join(base[:at] + [f"x{r.randrange(4)}y{i}" for i in range(k)] + base[at + k :])))
    tasks = []
    monkeypatch.setattr(near_copies, "blocks_of", lambda hard, f=near_copies.blocks_of: tasks.append(f(hard).cache()) or tasks[-1])
    df = spark.createDataFrame([(*x, "s") for x in rows], SCHEMA)
    kept = {x.doc_id for x in near_copies.one_of_each(df).collect()}
    assert kept == plain_kept(rows) and 1 < len(kept) < 60
    sizes = tasks[0].groupBy("key", "i", "j").count()
    assert sizes.where("i > 0").count() and sizes.where("i < 0").count() and sizes.where("j > 0").count()


def test_blocks_hold_every_pair_outside_main(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    hard = spark.createDataFrame([(1, c, c if c >= 17 else 0, c < 17, 17, 13) for c in range(30)], "key long, cls long, cluster long, main boolean, n_in long, n_out long")
    met, per_task = set(), {}
    for x in near_copies.blocks_of(hard).collect():
        per_task.setdefault((x.i, x.j), []).append(x.cls)
    for own in per_task.values():
        assert len(own) < 24
        met |= {(a, b) for a in own for b in own if a < b}
    assert {(a, b) for a in range(30) for b in range(17, 30) if a < b} <= met


def test_components_of_sets_against_every_pair():
    r = np.random.default_rng(3)
    base = [r.choice(300, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.where(r.random(60) < r.uniform(0, 0.25), r.integers(300, 900, 60), b)).astype(np.uint64) for b in base for _ in range(30)]
    root = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard(set(a.tolist()), set(b.tolist())) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root[root == y] = x
    assert (near_copies.similar(sets, 0.8) == root).all() and 4 < len(set(root.tolist())) < len(sets)


def test_odd_rows(spark):
    rows = [(3, "a b c d", "x"), (1, "A b  c d", "y"), (None, "a b c d", "z"), (None, "lone one", "z"), (None, "lone one", "q"), (None, "other one", "z"), (7, None, None), (8, "", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, (tuple(x) for x in near_copies.one_of_each(df).collect())))
    assert got == sorted(map(str, [(1, "A b  c d", "y"), (None, "lone one", "q"), (None, "other one", "z"), (7, None, None)]))
    assert near_copies.one_of_each(df.where("false")).count() == 0
