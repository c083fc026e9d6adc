import random
import re
from collections import Counter

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import quality
from tidegrid.llm.queries import op5_quality


def plain_inside(words, n):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}
    return inside, count


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    inside, _ = plain_inside(words, 5)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    share = max([0.0, *(sum(len(words[i]) for i in plain_inside(words, n)[0]) / max(1, sum(map(len, words))) for n in range(5, 11))])
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words),
        "dup_chars_share": pytest.approx(share),
    }


def same(got, text):
    want = plain(text)
    assert {k: got[k] for k in want} == want
    assert not (got["base_failed"] and got["kept"])


def test_whole_table(spark):
    t = {r["doc_id"]: r["text"] for r in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()}
    got = op5_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(t)
    for r in got:
        same(r.asDict(), t[r.doc_id])


def test_random_texts():
    r = random.Random(4)
    for _ in range(400):
        words = [r.choice(["a", "b", "cé", "#", "d<>", "word"]) for _ in range(r.randrange(60))]
        text = "".join(w + r.choice([" ", " ", "\n", "\t", "\v ", " ", "\n\n"]) for w in words)
        same(quality.measure(text), text)


def test_verdicts():
    r = random.Random(5)
    clean = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    assert quality.measure(clean)["kept"]
    assert not quality.measure("too short")["kept"]
    assert not quality.measure("spam and eggs again " * 60)["kept"]
    assert not quality.measure(" ".join(w + "###" for w in clean.split()))["kept"]
    lines = "\n".join(clean.split()[:40])
    assert not quality.measure("\n".join([lines] + ["menu"] * 60))["kept"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two " * 50000), (4, "one two " * 50000), (None, "x")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_words int, kept boolean")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        same(r.asDict(), r.text)
    assert quality.judge(df.where(F.lit(False))).count() == 0


def test_no_step_in_length():
    """A text of a given make is not judged by whether it has some number of words."""
    r = random.Random(1)
    lengths = list(range(12, 120))
    for share in (0.1, 0.3, 0.5):
        verdicts = []
        for n in lengths:
            own = [f"w{r.randrange(10**9)}" for _ in range(n)]
            for k in range(0, int(share * n) - 1, 3):
                own[k : k + 2] = ["same", "pair"]
            verdicts.append(quality.measure(" ".join(own))["kept"])
        changes = sum(a != b for a, b in zip(verdicts, verdicts[1:]))
        assert verdicts == sorted(verdicts, reverse=True) or changes <= 4, (share, changes)
    assert not quality.measure(" ".join(["same pair"] * 24))["kept"] and not quality.measure(" ".join(["same pair"] * 26))["kept"]
