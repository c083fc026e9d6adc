"""Nearest neighbours by additive quantisation.

A vector, scaled to length 1, is coded as a sum of one codeword from each of
``books`` full-dimensional codebooks. The books are fitted one after the
other to the residuals of a bounded sample; a code is found by beam search
over all of them, and the length of what it stands for is stored beside it.
A query scores a code by looking up its products with the codewords, over
that length; the best of each block are then ranked exactly, in double
precision, on the original vectors.

The stated queries meet all rows in blocks: the index is dealt to blocks of
about ``block`` rows, the queries in groups of ``group`` go to each block,
and a block returns ``k`` rows a query. A grouped minimum-like merge, one
group a query, is all that follows. No row is left out of the index: of
rows with one and the same vector, those beyond the ``k + 1`` of smallest
vec_id can never be among a query's k nearest and are coded once.

Defined results: vectors that are null, empty, zero or hold a null, NaN or
infinite component take no part, as query or candidate, and neither do those
whose length is not the commonest; ties go to the smaller vec_id; rows with
a null vec_id take no part; repeated rows of one vec_id and vector count
once, as query and as candidate; of one vec_id with different vectors each is
a candidate, and the query is the first of them in the order of arrays; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import cut


@dataclass
class Codebooks:
    words: np.ndarray  # books x codewords x dimension

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths of their sums): the best of ``beam`` partial sums a book.

        The squared distance to a sum changes, with one more codeword c, by
        |c|^2 - 2 x.c + 2 sum.c.
        """
        books, size, width = self.words.shape
        squares = (self.flat**2).sum(1)
        codes_all, lengths = [], []
        for i in range(0, len(x), 512):
            part = x[i : i + 512].astype(np.float32)
            dots = part @ self.flat.T
            n = len(part)
            codes, sums = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1, width), np.float32)
            cost = np.zeros((n, 1), np.float32)
            for b in range(books):
                own = slice(b * size, (b + 1) * size)
                # A partial sum's products with this book's codewords: one product of matrices, whatever came before.
                step = (sums.reshape(-1, width) @ (2 * self.words[b]).T).reshape(n, -1, size)
                step += (squares[own] - 2 * dots[:, own])[:, None]
                step += cost[:, :, None]
                total = step.reshape(n, -1)
                keep = min(beam, total.shape[1])
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
                rows = np.arange(n)[:, None]
                codes = np.concatenate([codes[rows, best // size], (best % size)[:, :, None]], axis=2)
                sums = sums[rows, best // size] + self.words[b][best % size]
                cost = total[rows, best]
            top = cost.argmin(1)
            codes_all.append(codes[np.arange(n), top].astype(np.uint8))
            lengths.append(np.linalg.norm(self.sums(codes_all[-1]), axis=1))
        if not codes_all:
            return np.zeros((0, books), np.uint8), np.zeros(0, np.float32)
        return np.concatenate(codes_all), np.concatenate(lengths).astype(np.float32)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for b in range(len(self.words)):
            out += self.words[b][codes[:, b]]
        return out

    def scores(self, queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Approximate cosines, queries x codes, by looking up products; always added in the order of the books, so equal codes score equally."""
        tables = np.einsum("bkd,qd->bkq", self.words, queries.astype(np.float32))
        out = np.zeros((len(codes), len(queries)), np.float32)
        for b in range(len(self.words)):
            out += tables[b][codes[:, b]]
        out /= np.maximum(lengths, 1e-12)[:, None]
        return out.T


def fit(sample: np.ndarray, books: int = 16, size: int = 256, rounds: int = 6, seed: int = 3) -> Codebooks:
    """Residual codebooks of a sample of vectors of length 1, by Lloyd's rounds."""
    r = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    words = np.zeros((books, size, sample.shape[1]), np.float32)
    for b in range(books):
        centers = rest[r.choice(len(rest), size, replace=len(rest) < size)].copy()
        for _ in range(rounds):
            near = ((centers**2).sum(1) - 2 * rest @ centers.T).argmin(1)
            count = np.bincount(near, minlength=size)
            order = np.argsort(near, kind="stable")
            begin = np.cumsum(count) - count
            full = count > 0
            centers[full] = np.add.reduceat(rest[order], begin[full], axis=0) / count[full, None]
        words[b] = centers
        rest -= centers[((centers**2).sum(1) - 2 * rest @ centers.T).argmin(1)]
    return Codebooks(words)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), ok.alias("ok")).where("ok and vec_id is not null").drop("ok")
    return rows


RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exactly the measure, in double precision."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


def search(
    df: DataFrame,
    every: int = 50,
    k: int = 5,
    rerank: int = 512,
    block: int = 16384,
    group: int = 16384,
    sample: int = 8192,
    books: int = 16,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by ``every``.

    sample: the most rows the codebooks are fitted on, those of least hash.
    """
    rows = usable(df, vec_id, embedding)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes.d)
    learned = [r.v for r in rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample).select("v").collect()]
    x = np.array(learned, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = fit(x, books)
    wide = {"v": "array<double>", "codes": "binary", "length": "float"}

    # Only the k + 1 smallest ids of equal vectors can be found; the limit works before the shuffle too.
    # Equal vectors are told by a hash; of those that merely share it none is lost, for a set of their distinct pairs is kept.
    few = rows.groupBy(F.xxhash64("v").alias("h"), "vec_id", "v").agg(F.lit(1).alias("once"))
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    unique = few.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "v")
    n_blocks = max(1, -(-int(sizes.n) // block))
    n_groups = max(1, -(-int(sizes.n) // every // group))
    schema = T.StructType([T.StructField("vec_id", T.LongType())] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in wide.items()])

    def code(batches):
        for t in batches:
            if len(t):
                v = stacked(t["v"])
                codes, lengths = model.encode(v / np.linalg.norm(v, axis=1, keepdims=True))
                yield pd.DataFrame({"vec_id": t["vec_id"], "v": t["v"], "codes": [c.tobytes() for c in codes], "length": lengths})

    index = cut(unique.mapInPandas(code, schema), "index").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("part", F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(n_groups)).cast("int"))
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def meet(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = found.sort_values("vec_id", kind="stable")
        ids, v = found["vec_id"].to_numpy(), stacked(found["v"])
        codes = np.frombuffer(b"".join(found["codes"]), np.uint8).reshape(len(ids), -1)
        asked_ids, q = queries["vec_id"].to_numpy(), stacked(queries["v"])
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        out = []
        for i in range(0, len(q), 32):
            scores = model.scores(unit[i : i + 32], codes, found["length"].to_numpy())
            for j, s in enumerate(scores, start=i):
                s[ids == asked_ids[j]] = -np.inf
                if len(s) > rerank:
                    # All that score as the last of the best do are ranked too, so ties are not cut.
                    near = np.flatnonzero(s >= np.partition(s, len(s) - rerank)[len(s) - rerank])
                else:
                    near = np.arange(len(s))
                near = near[ids[near] != asked_ids[j]]
                exact = cosines(q[j], v[near])
                best = np.lexsort((ids[near], -exact))[:k]
                out.append(pd.DataFrame({"query_id": asked_ids[j], "vec_id": ids[near[best]], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ("block", "part")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
