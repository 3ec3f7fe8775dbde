"""Random placements against brute force, and what they shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import enrichment as E, nearest as N
from strandloom.operators.placements import Genes


def tables(spark, seed, n=60):
    rng = np.random.default_rng(seed)
    spans = lambda m, longest: [(str(c), int(a), int(a + s)) for c, a, s in zip(rng.integers(0, 3, m), rng.integers(0, 900, m), rng.integers(1, longest, m), strict=True)]
    iv = spark.createDataFrame([*spans(n, 60), ("0", 5, 900), ("1", 7, 20), ("1", 7, 20), ("3", 10, 20)], "chrom string, start long, end long")
    sizes = spark.createDataFrame([(str(c), 1000) for c in range(4)], "chrom string, length long")
    ban = spark.createDataFrame(spans(25, 50), "chrom string, start long, end long")
    # some genes lie in several places, some share a place; one has no known set
    named = [(c, a, b, i % 30, None if i % 30 == 7 else i % 30 % 3 == 0) for i, (c, a, b) in enumerate([*spans(45, 40), *[("2", 50, 70)] * 3])]
    return iv, sizes, ban, spark.createDataFrame(named, "chrom string, start long, end long, gene long, in_set boolean")


def shuffled(spark, action):
    """Records that the shuffles of an action write."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_placements_are_not_shuffled(spark):
    iv, sizes, ban, genes = tables(spark, 1)
    few, many = (shuffled(spark, lambda n=n: E.shuffle_intervals(iv, sizes, n, 3, ban).count()) for n in (10, 640))
    assert many < 3 * few
    assert shuffled(spark, lambda: E.shuffle_intervals(iv, sizes, 640, 3, ban, genes).count()) < iv.count() * 640 / 5


def test_nearest_genes_of_placements_are_those_of_the_placed_rows(spark):
    for seed, replicates in ((1, 100), (2, 1), (3, 65)):
        iv, sizes, ban, genes = tables(spark, seed)
        placed = E.shuffle_intervals(iv, sizes, replicates, 5, ban).where("start is not null").select("chrom", "start", "end", "replicate")
        both = placed.unionByName(iv.withColumn("replicate", F.lit(-1)))
        hit = N.nearest(both, genes, "first").where("b_in_set is not null").select("replicate", "b_gene", "b_in_set").distinct()
        want = {r["replicate"]: (r["n"], r["k"]) for r in hit.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.count_if("b_in_set").alias("k")).collect()}
        got = {r["replicate"]: (r["n"], r["k"]) for r in E.shuffle_intervals(iv, sizes, replicates, 5, ban, genes).collect()}
        assert got == want and set(got) == {-1, *range(replicates)}


def test_first_gene_is_the_one_of_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        low = rng.integers(0, 100, 12)
        rows = sorted({(int(a), int(a + s)) for a, s in zip(low, rng.integers(1, 30, 12), strict=True)})
        genes = Genes(*np.array(rows).T)
        start = rng.integers(0, 130, 50)
        end = start + rng.integers(1, 10, 50)
        for s, e, at in zip(start.tolist(), end.tolist(), genes.first(start, end).tolist(), strict=True):
            gap = lambda g, s=s, e=e: 0 if g[0] < e and g[1] > s else max(g[0] - e, s - g[1]) + 1
            assert rows[at] == min(rows, key=lambda g: (gap(g), g))
