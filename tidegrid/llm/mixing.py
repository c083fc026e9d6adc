"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Every document draws the exponential key ``-ln(u) / quality``, u a hash of
its id and a seed: the documents of least keys are a weighted sample without
replacement. A source's target in words is met by whole epochs first; for
what is then left, documents are taken in the order of their keys until
their prefix sum reaches the budget, and the document at which it does so is
taken in part.

No source is sorted as a whole. Keys fall into ``BINS`` bins an octave: of
documents of any one quality weight a bin expects ln 2 / e / BINS at most,
0.05 %, whatever that weight is. Sums by bin, combined before their shuffle,
show the one bin in which a source's budget ends, and only that bin's
documents are sorted.

Targets: sources in the order of their names' code points (null last) weigh
``weights``, repeating, and share all words; none gets more than ``most``
times its own words, and what is over goes to the others by weight. This
has a closed form: target = min(most * size, level * weight) for one level.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own; with no words at all targets are 0; rows with
one doc_id are ordered by size, and equal rows are interchangeable; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD_BREAK, as_text, cut

BINS = 512
#: A table of so many sources at most is broadcast; a larger one is joined by its key.
MOST_BROADCAST = 100_000


def size_of(text: str = "text") -> F.Column:
    """Words: runs of anything but ASCII white space."""
    parts = F.split(as_text(F.col(text)), WORD_BREAK)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def quality_of(text: str = "text") -> F.Column:
    """A plain document quality weight in (0, 1]: texts shorter than 1,000 characters weigh less."""
    return F.least(F.lit(1.0), (F.length(as_text(F.col(text))) + 50) / 1050)


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row a source, few beside the documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sources.select("source", "source_size", w.alias("w")).withColumn("cap", most * F.col("source_size"))
    # In the order of cap / weight the capped sources come first; the level is that at which the others' shares use up the rest.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = weighed.withColumn("n", F.row_number().over(order)).withColumn("own", level)
    # The first source in this order whose share stays below its cap settles the level.
    first = F.min(F.when(F.col("own") * F.col("w") < F.col("cap"), F.struct("n", "own"))).over(Window.partitionBy())
    at = leveled.withColumn("level", first["own"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return at.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 1,
    quality: F.Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for every row, and, with ``keep``, these columns in the struct ``held``."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) + 0.5) / float(1 << 53)
    key = -F.log(u) / (quality if quality is not None else quality_of(text))
    held = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), key.alias("key"), held.alias("held"))
    if not keep:
        rows = cut(rows.drop("held"), "sizes").withColumn("held", F.lit(None).cast("string"))
    rows = rows.withColumn("bin", F.floor(BINS * F.log2(F.greatest(F.col("key"), F.lit(1e-300)))).cast("int"))
    bins = cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    named = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most).withColumnRenamed("source", "of")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    # Keys span some forty octaves, so the bins of a source are some twenty thousand rows at most.
    ends = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    cumulated = (
        bins.withColumn("bin_end", ends)
        .join(named, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("epochs", epochs)
        .withColumn("budget", budget)
        .withColumn("left", F.col("budget") - F.col("bin_end") + F.col("bin_size"))
    )
    # The bin in which the budget ends, and what is left for it; one row a source.
    edge = cumulated.groupBy(F.col("source").alias("of"), "source_size", "target", "epochs").agg(F.min(F.when(F.col("bin_end") > F.col("budget"), F.struct("bin", "left"))).alias("at"))
    edge = cut(edge.select("of", "source_size", "target", "epochs", F.coalesce("at.bin", F.lit(1 << 30)).alias("edge"), F.col("at.left").alias("left")), "targets")
    told = rows.join(F.broadcast(edge) if edge.count() <= MOST_BROADCAST else edge, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = told.where("bin != edge").withColumn("part", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    ranked = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.sum("size").over(ranked), F.lit(0))
    split = told.where("bin = edge").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - there)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return whole.unionByName(split).select("doc_id", "source", "size", "source_size", "target", "epochs", taken, *(["held"] if keep else []))


def mixed_documents(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of df: each document as often as whole epochs take it, and once more, cut behind its last word, where it is taken in part."""
    told = mix(df, keep=tuple(df.columns), text=text, **options)
    rest = F.col("taken") - F.col("epochs") * F.col("size")
    none = F.array().cast("array<bigint>")
    copies = F.concat(
        F.when((F.col("epochs") > 0) & (F.col("size") > 0), F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int"))).otherwise(none),
        F.when(rest > 0, F.array(rest)).otherwise(none),
    )
    each = told.select("held", "size", F.explode(copies).alias("words"))
    own = F.col("held")[text]
    first = F.array_join(F.slice(F.filter(F.split(own, WORD_BREAK), lambda w: w != ""), 1, F.greatest(F.lit(1), F.col("words").cast("int"))), " ")
    part = F.when((F.col("words") > 0) & (F.col("words") < F.col("size")), first).otherwise(own)
    return each.select(*[part.alias(c) if c == text else F.col("held")[c].alias(c) for c in df.columns])
