from tidegrid.llm import langid


def test_labels_above_the_broadcast_bound_are_learned(spark, monkeypatch):
    rows = [(i, f"word{i % 4} text", f"l{i % 4}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    assert langid.fit(df, buckets=1 << 10).languages == ["l0", "l1", "l2", "l3"]
