import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidegrid.llm import bpe
from tidegrid.llm.queries import bpe_digests

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_texts_as_the_library(vocabulary, library):
    own, r = bpe.TextEncoder(vocabulary, entries=50), random.Random(1)
    letters = "ab cdeéßñ 's'll\n\t  \x1c 中文字12٣½_#%  theingerstion"
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
    for text in ("x" * 5000, "the ing" * 3000, " ", "  ", " a", "a ", "a  b", "\n\n a", "ab" * 2000):
        assert own.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(vocabulary):
    r = random.Random(2)
    for _ in range(300):
        data = bytes(r.choice(b"aab theion") for _ in range(r.randrange(1, 60)))
        p = bpe.Prefixes(vocabulary, data[:7])
        p.append(data[7:])
        assert p.tokens() == vocabulary.merged(data)
        for _ in range(3):
            at = r.randrange(len(p.data) + 1)
            p.edit(at, r.randrange(len(p.data) - at + 1), bytes(r.choice(b"aab thei") for _ in range(r.randrange(5))))
            assert p.last == bpe.Prefixes(vocabulary, bytes(p.data)).last
            assert p.tokens() == vocabulary.merged(bytes(p.data))


def test_an_edit_recomputes_only_near_it(vocabulary):
    p = bpe.Prefixes(vocabulary, b"the thing is here and there " * 200)
    assert p.edit(100, 1, b"q") < 200


def test_rows(spark, library):
    rows = [(1, "the thing", "x"), (2, None, "y"), (3, "", None), (1, "the thing", "x"), (4, "é\n\n  ünd 's" * 900, "z"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_decode(df, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe_digests(out.where("doc_id = 4")).collect():
        ids = library.encode_ordinary(rows[4][1])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[4][1].encode()).hexdigest()
    assert bpe.encode_decode(df.where(F.lit(False)), PATH, P.PATTERN).count() == 0
