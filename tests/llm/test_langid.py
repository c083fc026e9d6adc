import zlib

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tidegrid.llm import langid
from tidegrid.llm.queries import op7_langid


def test_held_out_accuracy(spark):
    t = {r["doc_id"]: r for r in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().to_pylist()}
    got = op7_langid(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(t) and len(got) == len(t)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == t[r.doc_id]["lang"] for r in own]) >= 0.98
    assert np.mean([r.rejected for r in got]) < 0.01


def test_scores_are_calibrated_and_training_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = langid.fit(docs, each=60), langid.fit(docs, each=60)
    assert a.languages == ["de", "en", "es", "fr"] and (a.table == b.table).all() and a.least == b.least
    p = a.probabilities([langid.prepared("the and of to is"), langid.prepared("der die und das ist")])
    assert np.allclose(p.sum(1), 1) and p[0].argmax() == 1 and p[1].argmax() == 0


def test_held_out_rows_and_labels_of_others_are_not_learned(spark):
    rows = [(i, "aaa bbb" if i % 2 else "xyz zyx", "one" if i % 2 else "two") for i in range(80)]
    poisoned = [(i, t, "bad" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(poisoned, schema), buckets=1 << 10)
    assert model.languages == ["one", "two"]


def test_odd_rows(spark):
    rows = [(1, "the one", "en"), (2, None, "en"), (3, "", None), (4, "12 34 !?", "fr"), (None, "le la les", "fr"), (1, "the one", "en"), (5, "ein wort " * 30000, None), (6, "中文", "en")]
    df = spark.createDataFrame([(*r, "old", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df, buckets=1 << 10)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert langid.identify(df, model).count() == len(rows)
    for key in (2, 3, 4):
        assert got[key].lang_pred == "und" and got[key].score == 0 and got[key].rejected
    assert got[1].lang_pred in model.languages and got[6].lang_pred in model.languages
    empty = df.where(F.lit(False))
    none = langid.fit(empty)
    assert none.languages == [] and langid.identify(empty, none).count() == 0
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_batches_do_not_change_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, each=40)
    texts = [r.text for r in docs.select("text").collect()]
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "すべての人間は、生まれながらにして自由であり",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar",
]


def test_gibberish_and_foreign_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    r = np.random.default_rng(1)
    noise = [" ".join("".join(r.choice(list("bcdfghjklmnpqrstvwxz"), int(r.integers(3, 9)))) for _ in range(20)) for _ in range(100)]
    for some in (docs, docs.where("lang in ('en', 'de')")):
        model = langid.fit(some)

        def share(texts):
            lang, score = model.predict(texts)
            assert "und" not in lang
            return np.mean([s < model.least for s in score])

        assert share(noise) >= 0.99 and share(FOREIGN) == 1
        own = [x.text for x in some.where(langid.held_out()).collect()]
        assert share(own) < 0.01
    french = [x.text for x in docs.where("lang = 'fr'").collect()]
    assert share(french) >= 0.95
