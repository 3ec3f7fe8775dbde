"""Connected components of a link table by alternating star contraction; every step is a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm._shared import settled


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``links`` (a, b long) with the least node it reaches.

    Each round points nodes at the least neighbour of their neighbourhood, first for larger, then for smaller neighbours;
    chains shrink by squaring, so the rounds grow with the logarithm of a chain's length. Rounds are written to shared
    storage. Links of a node with itself and nulls are ignored; an empty table gives an empty result.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settled(edges, "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = settled(small.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
