"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint takes, for each of 64 bits, the majority of the
hashes of its word shingles. Equal fingerprints are one class; the join
runs over distinct fingerprints only. Two fingerprints within ``errors``
bits agree in at least one of ``errors + 1`` blocks of bits, so each is
dealt once by each block's value. Within what a task gets, a trie whose
first levels are that block is joined with itself: pairs of nodes descend
together, differing bits are added up (none is allowed in the block) and a
pair that exceeds the budget is left. All pairs of one level go at once,
as numpy arrays of ranges in the sorted fingerprints.

A block value that very many distinct fingerprints share (more than a
quarter of a task's mean load) is dealt further in the same way: of the
remaining bits too, one of ``errors + 1`` parts must agree, so no task needs
a whole group. Of the links found a task keeps a spanning forest: no component
changes, and no task returns more links than it has fingerprints.

Defined results: null and empty texts and texts without a word have the
fingerprint zero and link like any other; rows with a null doc_id take
part, and a component's id is the smallest doc_id that is not null (null if
there is none); repeated rows share their class; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import cut, slices, spread
from tidegrid.llm.components import components

BITS, SEED = 64, 42
#: A group of distinct fingerprints up to this size is never dealt further.
LEAST_HOT = 256


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """Unsigned; a bit is 1 if set in more than half of the shingles' hashes."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in slices(batches, 1):
            own = np.array([fingerprint_of(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], names=["doc_id", "fp"])

    return spread(df.select(doc_id, text)).mapInArrow(run, schema)


def blocks(errors: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of bits."""
    edges = [round(BITS * i / (errors + 1)) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def rotated(fp: F.Column, shift: int, width: int) -> F.Column:
    """The fingerprint with the block's bits moved to the top."""
    top = shift + width
    return fp if top == BITS else F.shiftleft(fp, BITS - top).bitwiseOR(F.shiftrightunsigned(fp, top))


def dealt(distinct: DataFrame, errors: int, tasks: int) -> DataFrame:
    """(block, key, part, fp, turned): each fingerprint once for each block, or where that group is hot, once for each part of the other bits too."""
    each = F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(r, BITS - w).alias("key"), r.alias("turned"))
            for i, (s, w) in enumerate(blocks(errors))
            for r in [rotated(F.col("fp"), s, w)]
        ]
    )
    rows = distinct.select("fp", F.explode(each).alias("x")).select("fp", "x.*")
    hot = max(LEAST_HOT, (errors + 1) * distinct.count() // (4 * tasks))
    large = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("block", "key", F.lit(True).alias("hot"))
    parts = F.array(*[F.lit(-1).cast("long")])
    for i, (_, w) in enumerate(blocks(errors)):
        rest = BITS - w
        edges = [round(rest * j / (errors + 1)) for j in range(errors + 2)]
        own = [F.shiftrightunsigned(F.shiftleft("turned", BITS - hi), BITS - hi + lo) + (j << 48) for j, (lo, hi) in enumerate(zip(edges, edges[1:]))]
        parts = F.when(F.col("hot") & (F.col("block") == i), F.array(*own)).otherwise(parts)
    marked = rows.join(large, ["block", "key"], "left")
    return marked.select("block", "key", F.explode(parts).alias("part"), "fp", "turned")


def trie_links(turned: np.ndarray, group: np.ndarray, exact: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``errors`` bits of the sorted, distinct (group, turned).

    exact: how many leading bits must agree, by row. Nodes are ranges of
    rows; a pair of nodes holds its differing bits so far. A pair of small
    nodes is settled by comparing their members.
    """
    change = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(change[1:], len(group))
    some = ends - change > 1
    a0, a1 = change[some], ends[some]
    b0, b1, diff = a0.copy(), a1.copy(), np.zeros(len(a0), np.int64)
    found_a, found_b = [], []
    for level in range(BITS):
        small = (a1 - a0) * (b1 - b0) <= 64
        if small.any():
            i, j = _members(a0[small], a1[small], b0[small], b1[small])
            keep = i < j
            i, j = i[keep], j[keep]
            apart = np.bitwise_count(turned[i] ^ turned[j])
            near = (apart <= errors) & (_lead(turned[i] ^ turned[j]) >= exact[i])
            found_a.append(i[near])
            found_b.append(j[near])
            a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            break
        am, bm = _split(turned, a0, a1, level), _split(turned, b0, b1, level)
        same = (a0 == b0) & (a1 == b1)
        block = level < exact[a0]
        nxt = []
        for (p0, p1), (q0, q1), more, use in (
            ((a0, am), (b0, bm), 0, None),
            ((am, a1), (bm, b1), 0, None),
            ((a0, am), (bm, b1), 1, None),
            ((am, a1), (b0, bm), 1, ~same),
        ):
            ok = (p1 > p0) & (q1 > q0) & (diff + more <= errors)
            if more:
                ok &= ~block
            if use is not None:
                ok &= use
            nxt.append([x[ok] for x in (p0, p1, q0, q1)] + [diff[ok] + more])
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*nxt))
        alone = (a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1)
        a0, a1, b0, b1, diff = (x[~alone] for x in (a0, a1, b0, b1, diff))
    else:
        i, j = _members(a0, a1, b0, b1)
        found_a.append(i[i < j])
        found_b.append(j[i < j])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64),) * 2


def _lead(x: np.ndarray) -> np.ndarray:
    """Leading zero bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return BITS - np.bitwise_count(x).astype(np.int64)


def _members(a0, a1, b0, b1):
    """All index pairs of these pairs of ranges."""
    la, lb = a1 - a0, b1 - b0
    n = la * lb
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[which] + k // lb[which], b0[which] + k % lb[which]


def _split(turned, lo, hi, level):
    """For each range of rows that agree above this level, where its ones begin: a binary search over all ranges together."""
    lo, hi = lo.copy(), hi.copy()
    bit = np.uint64(BITS - 1 - level)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (turned[np.minimum(mid, len(turned) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few of these links as join the same nodes: (node, least node of its component) of the nodes they touch."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (deeper := new[new] != new).any():
            new[deeper] = new[new[deeper]]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def links(distinct: DataFrame, errors: int = 2) -> DataFrame:
    """(u, v): fingerprints that join all of the column fp that are within ``errors`` bits of each other."""
    # A task gets about a million fingerprints at most, however many there are.
    n = max(2, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(errors + 1) * distinct.count() // 1_000_000))
    rows = dealt(distinct, errors, n)
    widths = np.array([w for _, w in blocks(errors)])

    def run(batches):
        held = [b.to_pandas() for b in batches if b.num_rows]
        if not held:
            return
        t = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        group = t.groupby(["block", "key", "part"], sort=False).ngroup().to_numpy()
        turned = t["turned"].to_numpy().view(np.uint64)
        order = np.lexsort((turned, group))
        block = t["block"].to_numpy()[order]
        fp = t["fp"].to_numpy()[order]
        a, b = trie_links(turned[order], group[order], widths[block], errors)
        values, index = np.unique(fp, return_inverse=True)
        child, root = forest(index[a], index[b], len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values[child]), pa.array(values[root])], names=["u", "v"])

    return rows.repartition(n, "block", "key", "part").mapInArrow(run, LINKS)


def near_duplicates(df: DataFrame, errors: int = 2, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    kind = df.schema[doc_id].dataType
    prints = cut(fingerprints(df, doc_id, text, words), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(classes.select("fp"), errors))
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("least"))
    least = linked.join(lows, "root").select("fp", "least")
    # Written, so that the join below is one of two plain shuffles: Spark splits the fingerprint that very many copies share.
    ids = cut(classes.join(least, "fp", "left").select("fp", F.coalesce("least", "low").cast(kind).alias("component_id")), "classes")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, errors: int = 2, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, with all columns of df.

    Of rows that share this doc_id the one of least text stays. A group
    whose doc_ids are all null keeps one row for each of its fingerprints.
    """
    found = near_duplicates(df, errors, words, doc_id, text)
    stay = found.where("component_id is not null").select(F.col("component_id").alias("stays")).distinct()
    rows = df.join(stay, df[doc_id] == stay.stays, "left_semi")
    others = [c for c in df.columns if c not in (doc_id, text)]
    first = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first(), *others)
    named = rows.withColumn("~n", F.row_number().over(first)).where(F.col("~n") == 1).drop("~n")
    lone = found.where("doc_id is null and component_id is null").select(F.conv("fingerprint", 16, -10).cast("long").alias("~fp")).distinct()
    nameless = df.where(F.col(doc_id).isNull())
    prints = fingerprint_column(nameless, text, words)
    least = Window.partitionBy("~fp").orderBy(F.col(text).asc_nulls_first(), *others)
    kept = prints.join(lone, "~fp", "left_semi").withColumn("~n", F.row_number().over(least)).where(F.col("~n") == 1).drop("~n", "~fp")
    return named.unionByName(kept.select(*df.columns))


def fingerprint_column(df: DataFrame, text: str, words: int) -> DataFrame:
    """df with its fingerprints in the column ~fp."""
    schema = T.StructType([*df.schema.fields, T.StructField("~fp", T.LongType())])

    def run(batches):
        for batch in slices(batches, text):
            own = np.array([fingerprint_of(t, words) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "~fp"])

    return df.mapInArrow(run, schema)
