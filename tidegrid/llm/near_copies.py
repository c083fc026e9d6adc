"""Near-duplicates by exact Jaccard similarity of word shingles.

SimHash alone does not reach a similarity of 0.8: at that similarity about
ten of 64 bits differ, and a budget of ten bits leaves trie blocks so short
that the join grows with the square of the table. So what may be similar is
gathered by keys: the component that SimHash's trie links, and ``BANDS``
bands of ``ROWS`` MinHash values each. A pair of similarity 0.8 agrees in no
band with a chance of 3 in a million, a closer pair with less.

Keys decide nothing. Documents with the same set of shingles are one class,
and the similarity of classes is counted exactly on their whole texts, in
two steps. First each class of a key meets the key's least class, as plain
pairs; the classes that pass are joined to clusters. A key whose classes
then are one cluster, as those of a group of copies of any size are, is done.
Of the other keys with three classes or more, those outside the cluster of
the least class meet it and each other, in tasks of ``BLOCK`` classes of
either side at most, so that no task holds a whole group; the work grows with
the square of the classes outside.

Defined results: words are lower-cased (ASCII) and split at white space, as
for the fingerprint; a text of fewer words than a shingle is one shingle;
null and empty texts and texts without a word are copies of each other and
of nothing else; groups are connected components of the pairs at ``least``
or above; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import simhash
from tidegrid.llm.common import cut, slices, spread
from tidegrid.llm.components import components

BANDS, ROWS, BLOCK = 32, 5, 1024
_r = np.random.default_rng(9)
#: Odd multipliers, one for each MinHash value.
_factors = _r.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_mix = _r.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_band = _r.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def hashes_of(text: str | None, words: int) -> np.ndarray:
    """The hash of each shingle, in the text's order."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, simhash.SEED) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of these hashes, zero of none."""
    ones = np.zeros(simhash.BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def class_of(shingles: np.ndarray) -> int:
    """A signed number for a set of shingles: the hash of its sorted hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One signed key for each band; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    x = shingles ^ (shingles >> np.uint64(31))
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(x), 64):
        low = np.minimum(low, (x[i : i + 64, None] * _factors).min(axis=0))
    low ^= low >> np.uint64(29)
    key = (low.reshape(BANDS, ROWS) * _mix).sum(axis=1, dtype=np.uint64) ^ _band
    return key.view(np.int64)


def prints(df: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, cls, fp, bands, n, text): the class, the fingerprint, the bands' keys and the number of distinct shingles of each row."""
    fields = [T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("cls", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        for batch in slices(batches, 1):
            cls, fp, bands, n = [], [], [], []
            for t in batch.column(1).to_pylist():
                h = hashes_of(t, words)
                s = np.unique(h)
                cls.append(class_of(s))
                fp.append(majority(h))
                bands.append(bands_of(s))
                n.append(len(s))
            fp = np.array(fp, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(fp), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64()), batch.column(1)], names=schema.names)

    return spread(df.select(doc_id, text)).mapInArrow(run, schema)


def keyed(classes: DataFrame, errors: int) -> DataFrame:
    """(key, cls, n, v, vn, members) of the classes (cls, fp, bands, n) that share a key with others; v is the key's least class and vn its n."""
    near = components(simhash.links(classes.select("fp").distinct(), errors))
    by_print = classes.select("cls", "n", "fp").join(near, F.col("fp") == near.node, "left").select("cls", "n", F.xxhash64(F.lit("print"), F.coalesce("root", "fp")).alias("key"))
    keys = by_print.union(classes.select("cls", "n", F.explode("bands")))
    low = keys.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("low"), F.count("*").alias("members")).where("members > 1")
    return keys.join(low, "key").select("key", "cls", "n", F.col("low.cls").alias("v"), F.col("low.n").alias("vn"), "members")


def passing(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the class pairs (u, v) whose similarity is ``least`` or more."""
    own = texts.select(F.col("cls").alias("u"), F.col("text").alias("text_u"))
    other = texts.select(F.col("cls").alias("v"), F.col("text").alias("text_v"))

    def run(batches):
        last, held = None, None
        for batch in slices(batches, 2):
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, y, a, b in zip(u, v, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if y != last:
                    last, held = y, np.unique(hashes_of(b, words))
                s = np.unique(hashes_of(a, words))
                shared = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(shared >= least * (len(s) + len(held) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(own, "u").join(other, "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def blocks_of(hard: DataFrame) -> DataFrame:
    """(key, i, j, cls, cluster): the classes of each key (key, cls, cluster, main, n_in, n_out), main those of the least class's cluster, dealt to tasks in which every pair that is not within main meets."""
    n_in, n_out = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int") for c in ("n_in", "n_out"))
    sized = hard.withColumns({"b_in": n_in, "b_out": n_out, "h": F.xxhash64(F.lit(3), "cls")})
    at_in, at_out = F.pmod("h", F.col("b_in")).cast("int"), F.pmod("h", F.col("b_out")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # i >= 0: block i of main with block j of the others; i < 0: block -1-i of the others with block j of them, -1-i <= j.
    inside = F.transform(upto(F.col("b_out")), lambda j: F.struct(at_in.alias("i"), j.alias("j")))
    outside = F.concat(
        F.transform(upto(F.col("b_in")), lambda i: F.struct(i.alias("i"), at_out.alias("j"))),
        F.when(F.col("b_out") > 1, F.transform(upto(F.col("b_out")), lambda k: F.struct((-1 - F.least(k, at_out)).alias("i"), F.greatest(k, at_out).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
    )
    return sized.withColumn("task", F.explode(F.when(F.col("main"), inside).otherwise(outside))).select("key", "task.i", "task.j", "cls", "cluster")


def similar(sets: list[np.ndarray], least: float, root: np.ndarray | None = None) -> np.ndarray:
    """For each of these sets of distinct values the first index of its component under Jaccard similarity ``least`` or more.

    root: components that are known already, by their first indices.

    Two sets that similar share one of the first values of each, in any order
    of values: of n values all but ceil(least * n) and one more. Rare values
    come first. Whole intersections are counted for sets that so meet one of
    another component.
    """
    n = len(sets)
    root = np.arange(n) if root is None else root.copy()
    size = np.array([len(s) for s in sets])
    values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(values))
    owner = np.repeat(np.arange(n), size)
    ranks = place[index]
    order = np.lexsort((ranks, owner))
    ranks = ranks[order]  # by set, rare values first
    starts = np.concatenate([[0], np.cumsum(size)])
    head = size - np.ceil(size * least - 1e-9).astype(np.int64) + 1
    first = np.arange(len(ranks)) - starts[owner] < head[owner]
    whole, lead = _postings(ranks, owner, len(values)), _postings(ranks[first], owner[first], len(values))
    for i in range(n):
        own = ranks[starts[i] : starts[i + 1]]
        met = _owners(lead, own[: head[i]])
        met = np.unique(met[(met > i) & (root[met] != root[i])])
        if len(met):
            shared = np.bincount(_owners(whole, own), minlength=n)[met]
            for j in met[shared >= least * (size[met] + size[i] - shared) - 1e-9]:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return root


def _postings(ranks: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each value's owners start, owners by value)."""
    order = np.argsort(ranks, kind="stable")
    return np.searchsorted(ranks[order], np.arange(n + 1)), owner[order]


def _owners(postings: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    at, owners = postings
    return np.concatenate([owners[a:b] for a, b in zip(at[values], at[values + 1])]) if len(values) else owners[:0]


def groups(rows: DataFrame, words: int, least: float, errors: int) -> DataFrame:
    """(cls, own) of the classes of these prints that have near-duplicates among other classes: own is the group's least class."""
    found = rows.where("cls != 0").groupBy("cls").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    classes = cut(found, "classes")
    held = cut(keyed(classes, errors), "keys")
    # One row stands for its class, so no class that many rows share meets in one task.
    texts = cut(rows.select("row", "text").join(classes.select("row", "cls").join(held.select("cls").distinct(), "cls"), "row").select("cls", "text"), "texts")
    fits = F.least("n", "vn") >= least * F.greatest("n", "vn") - 1e-9
    pairs = held.where((F.col("cls") != F.col("v")) & fits).select(F.col("cls").alias("u"), "v").distinct()
    sure = cut(passing(pairs, texts, words, least), "links")
    clusters = components(sure).withColumnRenamed("node", "cls")
    # What the first step has left open: keys of three classes or more in more than one cluster.
    some = held.where("members > 2").select("key", "cls", "v").join(clusters, "cls", "left").withColumn("cluster", F.coalesce("root", "cls"))
    heads = some.where("cls = v").select("key", F.col("cluster").alias("head"))
    # Written, so that what follows counts each key's classes before it shuffles them, and Spark can split a large key's join.
    told = cut(some.join(heads, "key").select("key", "cls", "cluster", (F.col("cluster") == F.col("head")).alias("main")), "open")
    sizes = told.groupBy("key").agg(F.sum(F.col("main").cast("long")).alias("n_in"), F.sum((~F.col("main")).cast("long")).alias("n_out"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("members")).where("n_out > 0")
    # Keys of the same classes are looked at once.
    once = sizes.groupBy("members", "n_in", "n_out").agg(F.min("key").alias("key"))
    tasks = blocks_of(told.join(once, "key"))

    def exact(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_numpy()
        order = np.argsort(cls)
        cls, texts = cls[order], t.column("text").take(pa.array(order)).to_pylist()
        _, first, back = np.unique(t.column("cluster").to_numpy()[order], return_index=True, return_inverse=True)
        before = first[back]
        after = similar([np.unique(hashes_of(x, words)) for x in texts], least, before)
        new = after != before
        return pa.table({"u": cls[new], "v": cls[after[new]]})

    late = tasks.join(texts, "cls").groupBy("key", "i", "j").applyInArrow(exact, "u long, v long")
    return components(sure.union(late)).select(F.col("node").alias("cls"), F.col("root").alias("own"))


def one_of_each(df: DataFrame, words: int = 5, least: float = 0.8, errors: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, with all columns of df.

    Of rows that share this doc_id the one of least text stays. A group
    whose doc_ids are all null keeps one row, of its least class.
    """
    rows = cut(prints(df, doc_id, text, words).withColumn("row", F.monotonically_increasing_id()), "prints")
    low = rows.groupBy("cls").agg(F.min("doc_id").alias("low"))
    own = low.join(groups(rows, words, least, errors), "cls", "left").select(F.coalesce("own", "cls").alias("own"), "low")
    found = cut(own.groupBy("own").agg(F.min("low").alias("stays")), "groups")
    stay = found.where("stays is not null").select("stays").distinct()
    others = [c for c in df.columns if c not in (doc_id, text)]
    first = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first(), *others)
    named = df.join(stay, df[doc_id] == stay.stays, "left_semi").withColumn("~n", F.row_number().over(first)).where(F.col("~n") == 1).drop("~n")
    lone = found.where("stays is null").select(F.col("own").alias("~cls"))
    least_text = Window.partitionBy("~cls").orderBy(F.col(text).asc_nulls_first(), *others)
    nameless = class_column(df.where(F.col(doc_id).isNull()), text, words).join(lone, "~cls", "left_semi")
    kept = nameless.withColumn("~n", F.row_number().over(least_text)).where(F.col("~n") == 1)
    return named.unionByName(kept.select(*df.columns))


def class_column(df: DataFrame, text: str, words: int) -> DataFrame:
    """df with its classes in the column ~cls."""
    schema = T.StructType([*df.schema.fields, T.StructField("~cls", T.LongType())])

    def run(batches):
        for batch in slices(batches, text):
            own = [class_of(np.unique(hashes_of(t, words))) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "~cls"])

    return df.mapInArrow(run, schema)
