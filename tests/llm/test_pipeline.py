import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_mixing import plain_targets  # noqa: E402
from tests.llm.test_near_copies import plain_kept  # noqa: E402
from tidegrid.llm import bpe, langid, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "quality rules", "SimHash near-dedup", "source mixing", "byte-level BPE"]
    now = [r.asDict() for r in docs.collect()]

    model = langid.fit(docs)
    lang, score = model.predict([r["text"] for r in now])
    now = [r for r, x, s in zip(now, lang, score) if x != "und" and s >= model.least]
    assert len(now) > 190
    now = [r for r in now if quality.measure(r["text"])["kept"]]

    stay = plain_kept([(r["doc_id"], r["text"]) for r in now])
    now = [r for r in now if r["doc_id"] in stay]

    sizes = Counter()
    for r in now:
        sizes[r["source"]] += len(r["text"].encode().split())
    target = plain_targets(dict(sizes))
    out = corpus_pipeline.run(spark, SF).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary.load(corpus_pipeline.VOCABULARY, P.PATTERN).ranks, special_tokens={})
    texts, got, cut_docs = {r["doc_id"]: r["text"] for r in now}, Counter(), 0
    for r in out:
        text = library.decode(r.ids)
        assert hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256 and r.n_tokens == len(r.ids)
        assert r.ids == library.encode_ordinary(text)
        if text != texts[r.doc_id]:
            cut_docs += 1
            words = text.split(" ")
            assert texts[r.doc_id].encode().split()[: len(words)] == [w.encode() for w in words]
        got[r.source] += len(text.encode().split())
    assert cut_docs <= len(sizes)
    assert all(abs(got[s] - target[s]) <= 1 for s in sizes)
    assert max(Counter(r.doc_id for r in out).values()) <= 3


def test_one_of_each_with_odd_rows(spark):
    from tidegrid.llm import simhash

    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "a b c d", "z"), (None, "lone one", "z"), (None, "lone one", "z"), (7, None, None), (8, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in simhash.one_of_each(df).collect())))
    assert got == sorted(map(str, [(1, "a b c d", "y"), (None, "lone one", "z"), (7, None, None)]))
    assert simhash.one_of_each(df.where("false")).count() == 0


def test_stages_with_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns whose names the stages use themselves."""
    t = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, size long, row long"
    long_text = " ".join(f"{a} {b}" for a, b in zip("the people of this country walked along".split() * 9000, (f"word{i}" for i in range(63000))))
    good = t.where("lang = 'en'").orderBy("doc_id").first().text
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t", "en", None, 3), (3, long_text, None, "a", 9), (4, good, "en", "b", 1), (4, good, "en", "b", 1), (None, good + " and more", None, None, None)]
    odd = spark.createDataFrame([(*x, 0.5, 1, 2, 3) for x in rows], kinds)
    docs = t.selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "0.5D AS score", "1L AS cls", "2L AS size", "3L AS row").union(odd)
    for made in (docs, docs.where("false"), odd.where("text is null")):
        now = made
        for name, stage in corpus_pipeline.STAGES:
            columns = now.columns
            now = stage(spark, now, "")
            if name != "byte-level BPE":
                assert now.columns == columns, name
        found = now.collect()
        assert bool(found) == (made is docs)
