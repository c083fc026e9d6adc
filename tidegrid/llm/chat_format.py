"""Chat formatting as event-sourced reconstruction, in DataFrame expressions only.

A log holds events of conversations: (conv_id, seq, turn, kind, role, text).
The events of one turn fold in the order of their sequence:

- ``message`` opens a message with its role and text
- ``delta`` appends its text
- ``edit`` replaces the text
- ``regenerate`` clears the text; later deltas build it anew
- ``retract`` removes the message

Every event but a delta begins a new state of the text, so the fold is a
running count: the deltas of a message's last state, joined in order. Turns
are then rendered row by row, gathered within ranges of a conversation, and
the ranges joined. Control strings inside texts are escaped reversibly by a
backslash, so ``parse`` gives back exactly the turns and the loss mask.

Rendered: for each turn ``<turn>ROLE\\n``, the escaped text and ``</turn>\\n``.
Escaped: a backslash, and the angle bracket of ``<turn>`` and ``</turn>``,
get a backslash before them. A role is escaped alike, its line breaks as
``\\n``. The loss mask covers the texts of ``assistant`` turns.

Defined results: a null text is empty, a null role is the empty role;
deltas before any message open one; events with one sequence fold in the
order of role, text and kind, equal ones as often as they occur, and turns
with one number follow in that order; a null conversation or turn is one of
its own and comes first; an empty log gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import as_text

OPEN, CLOSE = "<turn>", "</turn>"


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, place, role, text); place tells a turn's messages apart.

    Events are dealt once, by ranges of (conversation, turn): a long
    conversation spreads over partitions, and all that follows up to the
    joining of turns stays where it is.
    """
    n = max(2, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    events = events.repartitionByRange(n, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first())
    one = Window.partitionBy("conv_id", "turn").orderBy("seq", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), "kind")
    until = one.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.select(
        "conv_id",
        "turn",
        "kind",
        "role",
        as_text(F.col("text")).alias("text"),
        F.row_number().over(one).alias("n"),
        F.sum((F.col("kind") == "message").cast("long")).over(until).alias("place"),
        F.sum((F.col("kind") != "delta").cast("long")).over(until).alias("state"),
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("kind").isin("message", "delta", "edit"), F.struct("n", "text"))))
    states = counted.groupBy("conv_id", "turn", "place", "state").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max((F.col("kind") == "retract").cast("int")).alias("gone"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("n", "role"))).alias("said"),
    )
    last = states.groupBy("conv_id", "turn", "place").agg(F.max_by(F.struct("text", "gone"), "state").alias("m"), F.max("said").alias("said"))
    return last.where("m.gone = 0").select("conv_id", "turn", "place", as_text(F.col("said.role")).alias("role"), "m.text")


def escape(text: F.Column) -> F.Column:
    backslashes = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(backslashes, "<(/?turn>)", r"\\<$1")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"\\([\\<])", "$1")


def escape_role(role: F.Column) -> F.Column:
    return F.regexp_replace(escape(role), "\n", r"\\n")


def unescape_role(role: F.Column) -> F.Column:
    # Left to right: an escaped backslash is taken whole, so that an n behind it stays an n.
    parts = F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p == r"\n", "\n").when(F.substring(p, 1, 1) == "\\", F.substring(p, 2, 1)).otherwise(p)), "")


def rendered_turn(role: F.Column, text: F.Column) -> F.Column:
    return F.concat(F.lit(OPEN), escape_role(as_text(role)), F.lit("\n"), escape(as_text(text)), F.lit(CLOSE + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of turns (conv_id, turn, place, role, text): one row a conversation.

    Turns are rendered where they are, and each partition's are gathered
    before the one shuffle, so a long conversation arrives in few pieces.
    """
    line = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "place", "role", rendered_turn(F.col("role"), F.col("text")).alias("line"))
    lines = turns.select("conv_id", line.alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["line"]), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text), and loss_text, what lies under the loss mask, both read from the rendered output.

    A line break before an unescaped ``<turn>`` occurs between turns alone.
    """
    inner = F.substr(F.col("formatted"), F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN + CLOSE) - 1)
    turns = F.transform(
        F.split(inner, f"{CLOSE}\n{OPEN}"),
        lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")),
    )
    masked = F.filter("turns", lambda t: t["role"] == "assistant")
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(F.transform(masked, lambda t: t["text"]), ""))
