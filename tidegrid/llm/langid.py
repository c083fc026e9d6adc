"""Language identification by averaged hashed subword embeddings.

A text's subwords are the byte n-grams of its lower-cased words, borders
included. Each is hashed to a row of an embedding table; their mean goes
through a linear softmax. Table and softmax are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; a part of
the sample, held back from training, fits a temperature (so that the
softmax gives probabilities).

The softmax knows only the learned languages. How familiar a text is, that
is the mean log share that its subwords have in the language that uses each
most, is set against negatives: held texts scored without their own
language's shares, and held texts with the letters of each word shuffled. A
logistic curve makes of it the chance that the text is in a learned language
at all. The score is the product of both, and a score under ``LEAST`` is
rejected. The curve's middle counts a lost clean text as much as ``CLEAN``
passed negatives.

As the mean is linear, prediction needs only each bucket's product with the
softmax weights: one small table, whatever the text's length. Every text is
read whole.

Defined results: null, empty and letterless texts are ``und`` with score 0
and rejected; rows with a null or repeated doc_id are predicted like any
other (a null doc_id is not held out); languages are the non-null labels of
the sample, and with none of them every row is ``und``; other columns pass
through, and those named as the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import slices, spread

UNKNOWN = "und"
#: Labels up to which the tables of labels and of chosen ids are broadcast.
MOST_LANGUAGES = 10_000
ORDERS = (1, 2, 3, 4)
LEAST, CLEAN = 0.5, 50
LETTER = regex.compile(r"\p{L}")
#: Bytes that stand for a border: ASCII white space, digits and marks.
BORDER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def subwords(raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of the n-grams of these lower-cased bytes; a place is the n-gram's first byte."""
    b = np.frombuffer(raw, np.uint8)
    border = BORDER[b]
    x = np.where(border, np.uint32(32), b.astype(np.uint32))
    shift = np.uint32(32 - buckets.bit_length() + 1)
    found, places = [], []
    h, inner = np.zeros(len(b) + 1, np.uint32), np.zeros(len(b) + 1, bool)
    for n in ORDERS:
        if len(b) < n:
            break
        # No border inside; one at either end marks a word's begin or end.
        h = (h[: len(b) - n + 1] * np.uint32(0x01000193)) ^ x[n - 1 :]
        inner = inner[: len(b) - n + 1] | border[n - 2 : len(b) - 1] if n > 2 else np.zeros(len(b) - n + 1, bool)
        own = ~inner & (~border[: len(b) - n + 1] | ~border[n - 1 :])
        at = np.flatnonzero(own)
        found.append(((h[at] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift)
        places.append(at)
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def prepared(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" "


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: what a subword adds to each language's mean logit
    bias: np.ndarray
    temperature: float
    least: float  # a lower score is rejected
    familiar: np.ndarray | None = None  # by bucket: log share in the language that uses it most
    middle: float = 0.0  # familiarity of an even chance
    slope: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Means over each text's subwords, some texts at once."""
        return self.read(texts)[0]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, familiarity) of each text."""
        ends = np.cumsum([len(t) for t in texts])
        bucket, place = subwords(b"".join(texts), len(self.table))
        doc = np.searchsorted(ends, place, "right")
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        sums = np.stack([np.bincount(doc, self.table[bucket, k], len(texts)) for k in range(len(self.languages))], axis=1)
        known = np.zeros(len(texts)) if self.familiar is None else np.bincount(doc, self.familiar[bucket], len(texts)) / n
        return sums / n[:, None] + self.bias, known

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        start = 0
        while start < len(some):
            end, size = start, 0
            while end < len(some) and (size == 0 or size + len(texts[some[end]]) < 200_000):
                size += len(texts[some[end]])
                end += 1
            z, known = self.read([prepared(texts[i]) for i in some[start:end]])
            p = softmax(z / self.temperature)
            chance = logistic(self.slope * (known - self.middle)) if self.slope else np.ones(len(known))
            for i, k, s in zip(some[start:end], p.argmax(1), p.max(1) * chance):
                out[i], scores[i] = self.languages[k], float(s)
            start = end
        return out, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def familiarity(samples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By bucket: the greatest log share in a language, that language, and the second greatest; samples are (buckets, counts, language)."""
    first, second, owner = np.full(buckets, -np.inf), np.full(buckets, -np.inf), np.full(buckets, -1)
    by: dict[int, list] = {}
    for rows, count, y in samples:
        by.setdefault(y, []).append((rows, count))
    for y, own in sorted(by.items()):
        n = np.bincount(np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]), buckets)
        share = np.log((n + 0.1) / (n.sum() + 0.1 * buckets))
        more = share > first
        second = np.where(more, first, np.maximum(second, share))
        first, owner = np.where(more, share, first), np.where(more, y, owner)
    return first, owner, second


def shuffled(text: str, r: np.random.Generator) -> str:
    return " ".join("".join(r.permutation(list(w))) for w in text.split())


def set_rejection(model: Model, held: list[tuple[str, int]], samples: list, r: np.random.Generator) -> None:
    """Fits the curve of familiarity on held (text, language), whole and in passages, against the negatives made of them."""
    buckets = len(model.table)
    first, owner, second = familiarity(samples, buckets)
    model.familiar, model.least = first, LEAST
    clean, others = [], []
    several = len({y for _, _, y in samples}) > 1
    for text, y in held:
        words = text.split()
        at = int(r.integers(max(1, len(words) - 4)))
        for part in (text, " ".join(words[at : at + int(r.integers(5, 40))])):
            if not LETTER.search(part):
                continue
            bucket, _ = subwords(prepared(part), buckets)
            clean.append(first[bucket].mean())
            mixed, _ = subwords(prepared(shuffled(part, r)), buckets)
            others.append(first[mixed].mean())
            if several:
                others.append(np.where(owner[bucket] == y, second[bucket], first[bucket]).mean())
    if not clean:
        return
    clean, others = np.sort(clean), np.sort(others)
    # Half-way between neighbours, so that a clean text at the edge stays; of equal losses the lowest.
    edges = np.unique(np.concatenate([clean, others]))
    at = np.concatenate([[edges[0] - 0.1], (edges[1:] + edges[:-1]) / 2])
    loss = CLEAN * np.searchsorted(clean, at) / len(clean) + 1 - np.searchsorted(others, at) / len(others)
    model.middle = float(at[loss.argmin()])
    x, y = np.concatenate([clean, others]) - model.middle, np.concatenate([np.ones(len(clean)), np.zeros(len(others))])
    weight = np.where(y == 1, 1 / len(clean), 1 / len(others))
    model.slope = float(min(np.geomspace(1, 60, 41), key=lambda k: -(weight * np.log(logistic(k * np.where(y == 1, x, -x)) + 1e-12)).sum()))


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, rate: float = 1.0, held: int = 5, seed: int = 7) -> Model:
    """SGD over whole texts and one short passage of each; every ``held``-th text calibrates."""
    r = np.random.default_rng(seed)
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    label = {x: i for i, x in enumerate(names)}
    e = r.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    samples, calibration, whole, kept_back = [], [], [], []
    for i, (t, x) in enumerate(zip(texts, langs)):
        if i % held == 0:
            calibration.append((prepared(t), label[x]))
            kept_back.append((t, label[x]))
            continue
        words = t.split()
        at = int(r.integers(max(1, len(words))))
        for part in (t, " ".join(words[at : at + int(r.integers(5, 40))])):
            bucket, _ = subwords(prepared(part), buckets)
            if len(bucket):
                rows, count = np.unique(bucket, return_counts=True)
                samples.append((rows, (count / len(bucket)).astype(np.float32), label[x]))
                if part is t:
                    whole.append((rows, count, label[x]))
    steps = epochs * len(samples)
    for step in range(steps):
        if step % len(samples) == 0:
            order = r.permutation(len(samples))
        rows, weight, y = samples[order[step % len(samples)]]
        lr = np.float32(rate * (1 - step / steps))
        h = weight @ e[rows]
        g = softmax(h @ w + bias)
        g[y] -= 1
        back = w @ g
        w -= lr * np.outer(h, g)
        bias -= np.float32(0.01) * lr * g
        e[rows] -= lr * (len(rows) ** 0.5) * weight[:, None] * back
    model = Model(names, e @ w, bias.astype(np.float64), 1.0, 0.0)
    if calibration:
        z, y = model.logits([c[0] for c in calibration]), np.array([c[1] for c in calibration])
        grid = np.geomspace(0.0005, 20, 91)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        if whole:
            set_rejection(model, kept_back, whole, np.random.default_rng(seed + 1))
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that training never sees: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame, each: int = 600, most_bytes: int = 1 << 24, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> Model:
    """Trains on at most ``each`` documents a language, those of least hash, and of these on the first ``most_bytes`` bytes' worth of whole texts (one at least): the bounded sample.

    The sample is chosen from ids and labels alone; texts are read for its
    rows only after that.
    """
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    keyed = usable.select(F.col(lang).alias("lang"), F.col(doc_id).alias("key"), F.xxhash64(F.lit(11), F.col(doc_id)).alias("h"))
    keyed = keyed.where(F.col("key").isNotNull())
    # Of a language's n ids only those in the lowest share of hashes can be among its first: about 4 times as many as are wanted are ranked, whatever n is.
    counts = keyed.groupBy("lang").agg(F.count("*").alias("n_lang"))
    few = counts.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    small = F.broadcast if few else lambda t: t
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)
    low = keyed.withColumn("h", share).join(small(counts), "lang").where(F.col("h") * F.col("n_lang") <= 4 * each + 200)
    first = Window.partitionBy("lang").orderBy("h", "key")
    picked = low.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)
    bound = small(picked.select("lang", "key").distinct())  # `each` rows a language at most
    own = usable.select(F.col(lang).alias("lang"), F.col(doc_id).alias("key"), F.col(text).alias("text"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", F.xxhash64("text"))
    chosen = own.join(bound, ["lang", "key"]).withColumn("n", F.row_number().over(by_hash)).withColumn("size", F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.where((F.col("n") <= each) & ((F.col("n") == 1) | (F.col("size") <= most_bytes)))
    rows = sorted(((r.key, r.text, r.lang) for r in chosen.select("key", "text", "lang").collect()), key=lambda x: (hash_of(x[0]), x[1], x[2]))
    return train([x[1] for x in rows], [x[2] for x in rows], **options)


def hash_of(key) -> int:
    import zlib

    return zlib.crc32(f"order {key}".encode())


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected."""
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for batch in slices(batches, text):
            lang, score = model.predict(batch.column(text).to_pylist())
            gone = [x == UNKNOWN or s < model.least for x, s in zip(lang, score)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], names=[*kept, *new])

    return spread(df).mapInArrow(run, schema)
