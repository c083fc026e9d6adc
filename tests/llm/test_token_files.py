import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import token_files

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 1000):
        ids = r.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
        raw = token_files.pack(ids, bits)
        assert len(raw) == -(-n * bits // 64) * 8
        assert (token_files.unpack(raw, bits, n) == ids).all()


def test_random_access(tmp_path):
    r = np.random.default_rng(1)
    docs = [(i, r.integers(0, 50257, int(n), dtype=np.uint32)) for i, n in enumerate([0, 3, 9000, 1, 70000, 0, 5])]
    path = tmp_path / "x"
    w = token_files.Writer(open(path, "wb"), token_files.bits_for(50257))
    for d in docs:
        w.add(*d)
    w.add(None, docs[1][1])
    w.close()
    flat = np.concatenate([d[1] for d in docs] + [docs[1][1]])
    with open(path, "rb") as f:
        reader = token_files.Reader(f, path.stat().st_size)
        for a, b in ((0, 1), (4095, 4097), (8000, 60000), (len(flat) - 2, len(flat)), (7, 7)):
            assert (reader.ids(a, b) == flat[a:b]).all()
        got = list(reader.documents(at_once=2))
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 5, 6, None]
    assert all((g[2] == d[1]).all() for g, d in zip(got, docs))


def test_cached_as_the_library():
    library, own, r = Tokenizer.from_file(PATH), token_files.CachedTokenizer(PATH, entries=40), random.Random(3)
    letters = "ab cdéß 's'll\n\t  \x1c \0中12½_#  theing"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)] + ["a <|endoftext|> b", "a b\0 \0b", "\0b a"]
    for i in range(0, len(texts), 50):
        want = [e.ids for e in library.encode_batch(texts[i : i + 50], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts[i : i + 50])] == want


def test_rows(spark):
    rows = [(5, "the thing", 1), (2, None, 2), (None, "first", 3), (9, "", 4), (2, "again", 5), (7, "long text " * 20000, 6)] + [(100 + i, f"row {i} of many", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = token_files.write_and_read(df, PATH, end_id=2).collect()
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for key, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [w[0] for w in want]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids))) for r in got)
    for r in ordered:
        assert r.start == start
        start += len(r.ids) // 4
    assert token_files.write_and_read(df.where(F.lit(False)), PATH, end_id=2).count() == 0
