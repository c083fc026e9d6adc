"""What the operators of this subpackage share: tables, the shared folder and committed files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources.shared import drop, so_far  # noqa: F401
from tidegrid.sources.shared import held as cut  # noqa: F401
from tidegrid.sources.shared import scratch  # noqa: F401

#: ``[^\\x20\\x09-\\x0D]+`` in Java's syntax: a word is a run of anything but ASCII white space.
WORD_BREAK = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out anew where they lie in fewer partitions than the session has cores, as those of a few small files do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI: file, hdfs, s3, gs and what else pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def written_files(df: DataFrame, folder: str, write: Callable[[Iterator[pa.RecordBatch], Callable], Iterator[dict]], schema) -> DataFrame:
    """Runs ``write(batches, create)`` on each partition and returns the committed manifest.

    ``create(suffix)`` opens a new file of the folder, named by partition and
    attempt, and returns (path, stream). The manifest's rows are committed by
    Spark's own Parquet writer, so files of failed or doubled attempts are
    never listed and thus never read.
    """
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        made = [0]

        def create(suffix: str):
            name = f"{TaskContext.get().partitionId():06d}-{made[0]:04d}-{uuid.uuid4().hex[:12]}{suffix}"
            made[0] += 1
            return f"{folder}/{name}", files.open_output_stream(f"{base}/{name}")

        for row in write(batches, create):
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    manifest = f"{folder}-manifest"
    df.mapInArrow(run, schema).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def as_text(column) -> F.Column:
    """A string column with null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, at most ``rows`` at once and, where a single row isn't longer, ``most`` bytes of this column: what a worker holds as Python objects is bounded by that."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(start, end - start)
            start = end


def texts_of(column: pa.Array) -> list[str]:
    """Python texts of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


class UnitEncoder:
    """Ids of whole texts, some texts at a time, by what lies between two single spaces.

    Byte-level pre-tokenisation never joins white space to what stands
    before it, so such a word with the one space before it is encoded alike
    wherever it stands. Words of letters alone are matched by the pattern
    together with that space; ASCII marks behind them, a line break and the
    letters behind it are matches of their own. Known words are looked up, the others of some texts are encoded together. Texts
    with other runs of white space are encoded whole.
    """

    PLAIN = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)(?:\n([^\W\d_]+)([!-/:-@\[-`{-~]*))?")
    LONGEST = 64  # words of more characters are not kept

    def __init__(self, entries: int, part: int):
        """entries: how many words are kept before these become the older ones, from which what is met again comes back; part: characters of the texts that go together."""
        self.entries, self.part = entries, part
        self.bare: dict[str, bytes] = {}  # what stands without a space before it: marks, line breaks, letters behind these
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def letters(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each of these words of letters."""
        raise NotImplementedError

    def others(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each of these words, which neither begin nor end with white space."""
        raise NotImplementedError

    def wholes(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def alone(self, parts: list[str]) -> list[bytes]:
        """The ids of these parts, each letters alone, marks alone or a line break."""
        return self.wholes(parts)

    def apart(self, text: str) -> bool:
        """Whether this text, or word, must be encoded whole."""
        return False

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, start = [], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size < self.part):
                size += len(texts[end])
                end += 1
            out += self._some(texts[start:end])
            start = end
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.now) > self.entries:
            self.older, self.now = self.now, {}
        get, now, older = self.now.get, self.now, self.older
        whole, split, new, odd = set(), [], set(), set()
        for i, text in enumerate(texts):
            words = text.split(" ")
            head = words.pop(0)  # the first word has no space before it
            if words and (not head or head[-1].isspace()) or self.apart(text):
                whole.add(i)
                continue
            ids = list(map(get, words))
            holes = []
            if None in ids:
                holes = [k for k, x in enumerate(ids) if x is None]
                for k in holes:
                    w = words[k]
                    if w in older:
                        now[w] = older[w]
                    elif w not in new:
                        if not w or w[0].isspace() or w[-1].isspace():
                            whole.add(i)
                            break
                        new.add(w)
            split.append((i, head, words, ids, holes))
        self._learn(new)
        alone = sorted(whole)
        split = [x for x in split if x[0] not in whole]
        known = self.wholes([texts[i] for i in alone] + [x[1] for x in split])
        out = [b""] * len(texts)
        for i, first in zip(alone, known):
            out[i] = first
        for (i, _, words, ids, holes), first in zip(split, known[len(alone) :]):
            for k in holes:
                ids[k] = now[words[k]]
            out[i] = b"".join([first, *ids])
        for w in new:
            if len(w) > self.LONGEST:
                now.pop(w, None)
        return out

    def _learn(self, new: set[str]) -> None:
        """Takes in these words, which neither begin nor end with white space."""
        now, older = self.now, self.older
        letters = [w for w in new if w.isalpha()]
        parted, others, bare = [], [], {}
        for w in new.difference(letters):
            m = self.PLAIN.fullmatch(w)
            first, *rest = m.groups("") if m else ("",)
            if first.isalpha() and (not rest[1] or rest[1].isalpha()):
                rest = [x for x in (rest[0], "\n" if rest[1] else "", rest[1], rest[2]) if x]
                parted.append((w, first, rest))
                bare.update((x, None) for x in rest if x not in self.bare)
            else:
                others.append(w)
        letters += {b for _, b, _ in parted if b not in new and b not in now and b not in older}
        if letters:
            now.update(zip(letters, self.letters(letters), strict=True))
        if bare:
            if len(self.bare) > self.entries // 4:
                self.bare = {}
                bare = dict.fromkeys(x for _, _, rest in parted for x in rest)
            self.bare.update(zip(bare, self.alone(list(bare)), strict=True))
        get = self.bare.__getitem__
        for w, first, rest in parted:
            now[w] = b"".join([now[first] if first in now else older[first], *map(get, rest)])
        if others:
            now.update(zip(others, self.others(others), strict=True))
