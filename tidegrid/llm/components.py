"""Connected components of an undirected graph, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014):
large-star links every larger neighbour of a node to the least node of its
neighbourhood, small-star every smaller one. Both keep the components and
shrink paths, so that a few rounds (logarithmic in the longest path, in
practice) leave one star for each component. Each round is a grouped
minimum, combined before its shuffle, and one join back; nothing meets in
one place but what shares a node, and Spark splits such a skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import cut, drop, so_far


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star of edges u > v, each undirected edge once."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("n")).select(F.col("u").alias("node"), F.least("u", "n").alias("m"))
    # An undirected edge u > v makes the larger end meet the least of the smaller's neighbourhood; v itself meets u's only if v > u.
    large = edges.join(least, edges.v == least.node).select("u", F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    own = low.select("u", F.col("m").alias("v"))
    rest = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that edges (u, v) name, root the least node of its component.

    Loops and repeated edges are allowed. Each round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        now = cut(_star(now), "edges")
        found = mark(now)
        drop(edges.sparkSession, so_far() - 2, 1)  # the round before, of which nothing more is read
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
