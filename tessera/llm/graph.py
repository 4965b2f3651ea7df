"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges(a, b)`` with the smallest node it reaches: rows ``(node, root)``.

    Alternating large-star and small-star steps. Each step is a min per node (combined before the shuffle) and
    an equi-join that Spark can split on a hot node; no neighbourhood is gathered in one place. Nodes without
    an edge get no row, self-loops and repeated or null-ended edges are ignored. Each round is written to the
    shared folder, and the one before deleted. The search ends when the edges are stars: no node points at two
    others, and none that is pointed at points elsewhere. Raises RuntimeError if max_rounds pass without that.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out + met > 1 and out > 0").isEmpty():
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        hop = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = hop.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(hop.select("a", F.col("m").alias("b")))
        last, e = e, materialize(small.distinct(), "cc")
        discard(last)
    raise RuntimeError("components did not settle")
