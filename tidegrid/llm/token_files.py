"""Token ids in files of fixed-width bits.

A file holds ids in the fewest bits that the vocabulary needs, in blocks of
``BLOCK`` ids that begin at whole 8-byte words, so that each block unpacks
by itself with numpy. Layout, little-endian:

- 8 bytes ``TGBITS01``; uint32 bits; uint32 ids in a block
- blocks: the ids' bits, lowest first, padded to 8 bytes
- uint64 begin of each block in the file
- for each document: int64 doc_id, uint64 first id in the file, uint8 1 if doc_id is null
- footer: uint64 documents, uint64 ids, uint64 blocks, uint64 begin of the block table, 8 bytes ``TGBITS01``

Files are dealt by ranges of doc_id, and a manifest lists them in that order.

Defined results: a null text is the empty text and has the end id alone; a
null doc_id comes first; rows with one doc_id follow each other by their
text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import UnitEncoder, open_fs, scratch, slices, written_files

MAGIC, BLOCK = b"TGBITS01", 4096
FOOTER = struct.Struct("<QQQQ8s")
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fewest whole 8-byte words that hold these ids, ``bits`` each."""
    if bits in (8, 16, 32):
        raw = ids.astype(f"<u{bits // 8}").tobytes()
    else:
        planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        raw = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return raw + bytes(-len(raw) % 8)


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids: each is cut out of the two words that it may lie in."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    words = np.concatenate([np.frombuffer(raw, "<u8"), np.zeros(1, np.uint64)])
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.at = stream, bits, 0
        self.rest, self.begins, self.docs, self.n_ids = [], [], [], 0
        self.waiting = 0
        self._put(MAGIC + struct.pack("<II", bits, BLOCK))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, self.n_ids, doc_id is None))
        self.rest.append(ids)
        self.n_ids += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._blocks(BLOCK)

    def _blocks(self, least: int) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(flat) // BLOCK * BLOCK if least == BLOCK else len(flat)
        for i in range(0, whole, BLOCK):
            self.begins.append(self.at)
            self._put(pack(flat[i : min(i + BLOCK, whole)], self.bits))
        self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        self._blocks(1)
        table = self.at
        self._put(np.array(self.begins, "<u8").tobytes())
        self._put(np.array([d[0] for d in self.docs], "<i8").tobytes())
        self._put(np.array([d[1] for d in self.docs], "<u8").tobytes())
        self._put(np.array([d[2] for d in self.docs], "<u1").tobytes())
        self._put(FOOTER.pack(len(self.docs), self.n_ids, len(self.begins), table, MAGIC))
        self.stream.close()


class Reader:
    """Documents in order, or any range of ids, from a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        n_docs, self.n_ids, n_blocks, table, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        head = self._read(0, 16)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = struct.unpack("<II", head[8:])
        raw = self._read(table, 8 * n_blocks + 17 * n_docs)
        self.begins = np.append(np.frombuffer(raw, "<u8", n_blocks), np.uint64(table)).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, 8 * n_blocks)
        self.firsts = np.append(np.frombuffer(raw, "<u8", n_docs, 8 * (n_blocks + n_docs)), np.uint64(self.n_ids)).astype(np.int64)
        self.nulls = np.frombuffer(raw, "<u1", n_docs, 8 * (n_blocks + 2 * n_docs))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(size)
        if len(raw) != size:
            raise ValueError("a token file ends early")
        return raw

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Random access: the ids from begin up to end, reading only the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        raw = self._read(int(self.begins[first]), int(self.begins[last + 1] - self.begins[first]))
        base = self.begins[first]
        parts = [unpack(raw[self.begins[b] - base : self.begins[b + 1] - base], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        flat = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return flat[begin - first * self.block : end - first * self.block]

    def documents(self, at_once: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) in the file's order, some documents' blocks read at once."""
        for i in range(0, len(self.doc_ids), at_once):
            j = min(i + at_once, len(self.doc_ids))
            base, flat = self.firsts[i], self.ids(int(self.firsts[i]), int(self.firsts[j]))
            for k in range(i, j):
                yield None if self.nulls[k] else int(self.doc_ids[k]), int(self.firsts[k]), flat[self.firsts[k] - base : self.firsts[k + 1] - base]


def spelled() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: printable ones of Latin-1 as themselves, the others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class CachedTokenizer(UnitEncoder):
    """The tokenizers library, with words cached.

    Unknown words of letters, which are one match of the pattern each, go
    to the library's model as one text that is parted at the spaces alone;
    other words as one text through the whole library. In both a word's
    ids begin where a token begins with a space, for it has no other. Texts
    that hold a special token's string go to the library whole.
    """

    def __init__(self, path: str, entries: int = 400_000, part: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(entries, part)
        self.library, self.spelled = Tokenizer.from_file(path), spelled()
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.spelled[32], "merged_with_next")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.opens = np.zeros(self.size, bool)  # tokens that begin with a space
        self.length = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab().items():
            self.length[i] = len(token)
            self.opens[i] = token.startswith(self.spelled[32]) and token not in self.special

    def apart(self, text: str) -> bool:
        return any(map(text.__contains__, self.special))

    def wholes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        text = f" {' '.join(words)}"
        text = text.replace(" ", self.spelled[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.spelled)
        return self._parted(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, len(words))

    def others(self, words: list[str]) -> list[bytes]:
        text = f" {' '.join(words)}"
        if self.apart(text):  # a special token that holds a space, made by joining
            return self.wholes([f" {w}" for w in words])
        return self._parted(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, len(words))

    def alone(self, parts: list[str]) -> list[bytes]:
        words = [p if p.isascii() and p != "\n" else p.encode().decode("latin-1").translate(self.spelled) for p in parts]
        ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        # A part's ids end where their lengths have made up its own.
        ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))) + 1
        raw, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[i:j] for i, j in zip(edges, edges[1:])]

    def _parted(self, ids: list[int], n: int) -> list[bytes]:
        flat = np.array(ids, "<u4")
        edges = (4 * np.append(np.flatnonzero(self.opens[flat]), len(flat))).tolist()
        if len(edges) != n + 1:
            raise ValueError("a word does not begin with its space")
        raw = flat.tobytes()
        return [raw[i:j] for i, j in zip(edges, edges[1:])]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    """One for each process, so that a Python worker keeps its cache from task to task."""
    return CachedTokenizer(path)


def write(df: DataFrame, path: str, folder: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and writes; returns the manifest. The one shuffle deals the texts by ranges of (doc_id, text's hash), so a doc_id that many rows share is split too."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)

    def run(batches, create):
        from pyspark import TaskContext

        own, name, out = tokenizer(path), "", None
        end = b"" if end_id is None else struct.pack("<I", end_id)
        for batch in slices(batches, 1):
            if out is None:
                name, stream = create(".bits")
                out = Writer(stream, bits_for(own.size))
            for key, ids in zip(batch.column(0).to_pylist(), own.encode_batch(batch.column(1).to_pylist()), strict=True):
                out.add(key, np.frombuffer(ids + end, "<u4"))
        if out is not None:
            out.close()
            yield {"path": name, "shard": TaskContext.get().partitionId(), "n_docs": len(out.docs), "n_ids": out.n_ids}

    return written_files(dealt, folder, run, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids as little-endian uint32 bytes) of every document in the files; start counts the ids of all documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, path = open_fs(uri)
                with files.open_input_file(path) as f:
                    reader, rows, held = Reader(f, f.size()), [], 0
                    for key, first, ids in reader.documents():
                        rows.append((key, base + first, ids.astype("<u4").tobytes()))
                        held += 4 * len(ids)
                        if held > 4 << 20:
                            yield spans(rows)
                            rows, held = [], 0
                    if rows:
                        yield spans(rows)

    def spans(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=SPANS.names)

    return files.select("path", "base").repartition(n, "path").mapInArrow(run, SPANS)


def write_and_read(df: DataFrame, path: str, end_id: int | None, folder: str | None = None) -> DataFrame:
    return read(write(df, path, folder or scratch(df.sparkSession, "bits"), end_id))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
