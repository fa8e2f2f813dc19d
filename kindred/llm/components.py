"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the least node of the component. Loops and repeats do no harm.

    Every step pre-aggregates by node, keeps the edge list no longer than it was, and cuts its
    lineage in the shared folder, so a lost executor costs one step.
    """
    e = _small_star(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        e = _small_star(_large_star(e))


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's greater neighbours are tied to the least of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of them. e: (a, b) with b < a."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    lesser = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return cut(lesser.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
