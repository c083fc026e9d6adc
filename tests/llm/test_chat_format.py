import random

from pyspark.sql import functions as F

from tidegrid.llm import chat_format

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string, piece int"


def turns(spark, events):
    df = spark.createDataFrame([(*e, 1) for e in events], SCHEMA)
    whole = chat_format.parse(chat_format.render(chat_format.fold(df)))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted) for r in whole.collect()}


def test_fold(spark):
    events = [
        (1, 1, 0, "message", "user", "hel"),
        (1, 3, 0, "delta", None, "o"),
        (1, 2, 0, "delta", None, "l"),
        (1, 4, 1, "message", "assistant", None),
        (1, 5, 1, "delta", None, "first try"),
        (1, 6, 1, "regenerate", None, None),
        (1, 7, 1, "delta", None, "second "),
        (1, 8, 1, "delta", None, "try"),
        (1, 9, 2, "message", "user", "wrong"),
        (1, 10, 2, "edit", None, "right"),
        (1, 11, 3, "message", "assistant", "gone"),
        (1, 12, 3, "retract", None, None),
        (1, 13, 4, "delta", "assistant", "headless"),
    ]
    got = turns(spark, events)[1]
    assert got[0] == [("user", "hello"), ("assistant", "second try"), ("user", "right"), ("assistant", "headless")]
    assert got[1] == "second tryheadless"
    assert got[2].startswith("<turn>user\nhello</turn>\n<turn>assistant\nsecond try</turn>\n")


def test_round_trip_of_hostile_texts(spark):
    r, events, want = random.Random(1), [], {}
    bits = ["<turn>", "</turn>", "\\", "\n", "<", "/turn>", "n", "é", "user", "\\n", " ", "</turn>\n<turn>user\nx", "\\<turn>"]
    for c in range(60):
        for t in range(r.randrange(1, 6)):
            role = r.choice(["user", "assistant", "a\nb", "<turn>", "\\n", ""])
            text = "".join(r.choice(bits) for _ in range(r.randrange(9)))
            events.append((c, t, t, "message", role, text))
            want.setdefault(c, []).append((role, text))
    got = turns(spark, events)
    assert {c: g[0] for c, g in got.items()} == want
    assert all(g[1] == "".join(t for role, t in want[c] if role == "assistant") for c, g in got.items())


def test_odd_rows(spark):
    long = "</turn>\n" * 40000
    events = [(None, 0, 0, "message", "user", "x"), (5, 1, 1, "message", None, None), (5, 1, 1, "message", "user", "same"), (5, 1, 1, "message", "user", "same"), (5, 0, None, "message", "system", "first"), (6, 0, 0, "message", "assistant", long)]
    events += [(9, i, i, "message", "user", str(i)) for i in range(2000)]
    got = turns(spark, events)
    assert got[None][0] == [("user", "x")]
    assert got[5][0] == [("system", "first"), ("", ""), ("user", "same"), ("user", "same")]
    assert got[6][0] == [("assistant", long)] and got[6][1] == long
    assert got[9][0] == [("user", str(i)) for i in range(2000)]
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.parse(chat_format.render(chat_format.fold(empty))).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, 0, "message", "user", "x", 1)], SCHEMA).where(F.col("conv_id") > 0)
    plan = chat_format.parse(chat_format.render(chat_format.fold(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
