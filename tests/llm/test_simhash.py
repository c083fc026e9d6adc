import random

import numpy as np
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import simhash
from tidegrid.llm.components import components
from tidegrid.llm.queries import op9_simhash


def plain_fingerprint(text, words=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(parts[i : i + words]).encode(), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, errors=2):
    """{row index: least doc_id}"""
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array(distinct, np.uint64)
    for i, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(v ^ np.uint64(p)) <= errors):
            a, b = find(p), find(distinct[j])
            root[max(a, b)] = min(a, b)
    least = {}
    for (key, _), p in zip(rows, prints):
        r = find(p)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return sorted((str(key), f"{p:016x}", str(least.get(find(p)))) for (key, _), p in zip(rows, prints))


def check(out, rows):
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out.collect()) == plain_components(rows)


def test_whole_table(spark):
    t = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    check(op9_simhash(spark, "/root/testdata/sf0.001"), [(r["doc_id"], r["text"]) for r in t])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(4, None), (3, ""), (9, " \n\t"), (7, "One Two"), (8, "one two"), (8, "one two"), (None, "one two"), (None, "lone null here"), (1, long), (2, long + " more"), (11, "É é"), (12, "é é")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, fingerprint string")
    check(simhash.near_duplicates(df), rows)
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def planted(r, n, spread):
    base = [r.getrandbits(64) for _ in range(n)]
    near = []
    for b in base[: n // 3]:
        for _ in range(r.randrange(1, spread)):
            x = b
            for bit in r.sample(range(64), r.randrange(1, 5)):
                x ^= 1 << bit
            near.append(x)
    return sorted({*base, *near})


def roots_of(n, a, b):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(a, b):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_trie_finds_every_link():
    r = random.Random(5)
    for n, exact in ((60, 0), (900, 0), (400, 9)):
        v = np.array(planted(r, n, 6), np.uint64)
        a, b = simhash.trie_links(v, np.zeros(len(v), np.int64), np.full(1, exact).repeat(len(v)), 2)
        got = sorted(zip(a.tolist(), b.tolist()))
        want = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2 and (int(v[i]) >> 64 - exact) == (int(v[j]) >> 64 - exact)]
        assert got == want
    child, root = simhash.forest(a, b, len(v))
    assert roots_of(len(v), child, root) == roots_of(len(v), a, b)


def test_links_join_hot_groups_too(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_HOT", 3)
    r = random.Random(6)
    center = r.getrandbits(64)
    values = {center}
    for _ in range(1500):
        x = center
        for bit in r.sample(range(20, 40), r.randrange(1, 6)):
            x ^= 1 << bit
        values.add(x)
    values = sorted(values | set(planted(r, 200, 4)))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    want = roots_of(len(values), *zip(*pairs))
    place = {s: i for i, s in enumerate(signed)}
    got = {place[f.node]: place[f.root] for f in found}
    same = {}
    for i, w in enumerate(want):
        assert same.setdefault(w, got.get(i, i)) == got.get(i, i)
    assert len(set(same.values())) == len(same)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (2000, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 2000: 0}
