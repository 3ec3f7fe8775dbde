"""Local trees swept along the sites, against trees built anew at each site."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import genealogy as Y
from strandloom.plans import tree_queries

KEYS = "run long, region string, sample_idx long, "


def random_edges(r, leaves, inner, length, pieces):
    """Trees over stretches of [0, length): (left, right, parent, child); a node may miss, a node may have one child."""
    out, cuts = [], sorted({0, length, *r.integers(1, length, pieces).tolist()})
    for a, b in zip(cuts, cuts[1:], strict=False):
        nodes = sorted(r.choice(np.arange(leaves, leaves + inner), int(r.integers(1, inner + 1)), replace=False).tolist())
        open_ = r.permutation(leaves).tolist()[: int(r.integers(2, leaves + 1))]
        for n in nodes:
            kids = [open_.pop(int(r.integers(len(open_)))) for _ in range(min(len(open_), int(r.integers(1, 4))))]
            out += [(a, b, n, c) for c in kids]
            open_.append(n)
    return out


def plain(t, pairs, species):
    """(nonroot, few, splits, below) by node, straight from the definitions."""
    parent, children = {c: p for p, c in pairs}, {}
    for p, c in pairs:
        children.setdefault(p, []).append(c)

    def below(n):
        return set().union(*(below(c) for c in children[n])) if n in children else {species[n]} if n in species else set()

    def splits(n):
        while len(children.get(n, ())) == 1:
            n = children[n][0]
        kids = [below(c) for c in children.get(n, ())]
        return len(kids) == 2 and all(len(k) == 1 for k in kids) and kids[0] != kids[1]

    inside = set(parent) | set(children)
    few = lambda n: n in parent and sum(t[x] > (t[n] + t[parent[n]]) / 2 for x in inside) <= 2
    inner = sorted(children, key=lambda n: -t[n])
    return {n: (n in parent, few(n), splits(n)) for n in t}, len(inner) > 1 and splits(inner[1])


@pytest.mark.parametrize("seed", range(12))
def test_sweep_equals_trees_built_anew(seed):
    r = np.random.default_rng(seed)
    edges = random_edges(r, 7, 9, 100, 15)
    t = {n: 0.0 if n < 7 else float(n) for n in range(16)}
    species = {n: 1 << int(r.integers(3)) for n in range(7)} | ({10: 4} if seed % 2 else {})
    left, right, parent, child = (np.array(x) for x in zip(*r.permutation(edges).tolist(), strict=True))
    sweep = Y.Sweep(t, left, right, parent, child, species)
    for pos in sorted(r.integers(-5, 110, 40).tolist()):
        tree = sweep.at(pos)
        want, yellow = plain(t, [(p, c) for a, b, p, c in edges if a <= pos < b], species)
        assert {n: (tree.nonroot(n), tree.few_lineages(n), tree.splits_species(n)) for n in t} == want
        assert (len(tree.inner) > 1 and tree.splits_species(tree.inner[-2][1])) == yellow


def test_many_sites_and_edges_in_one_sample_are_not_a_quadratic_scan(spark):
    n, pieces = 40, 130
    r = np.random.default_rng(3)
    edges = []
    for k in range(pieces):
        open_ = r.permutation(n).tolist()
        for p in range(n, 2 * n - 1):
            a, b = open_.pop(0), open_.pop(0)
            edges += [(float(1000 * k), float(1000 * (k + 1)), p, a), (float(1000 * k), float(1000 * (k + 1)), p, b)]
            open_.append(p)
    nodes = spark.createDataFrame([(0, "r", 0, i, 0.0 if i < n else float(i)) for i in range(2 * n - 1)], KEYS + "node_id long, time double")
    edge = spark.createDataFrame([(0, "r", 0, *e) for e in edges], KEYS + "left double, right double, parent long, child long")
    muts = spark.range(100_000).select(F.lit(0).cast("long").alias("run"), F.lit("r").alias("region"), F.lit(0).cast("long").alias("sample_idx"), (F.col("id") * 1.0).alias("position"), (F.col("id") * 7 % (2 * n - 1)).alias("node"), F.lit("A").alias("derived_state"))
    sites = spark.range(100_000).select(F.lit("r").alias("region"), F.lit("1").alias("chrom"), F.col("id").alias("pos"))
    leaves = spark.createDataFrame([(i, i % 2) for i in range(n)], "node_id long, species int")
    began = time.time()
    assert len(edges) > 10_000 and Y.topology_metrics(nodes, edge, muts, sites, leaves).count() == 100_000
    assert time.time() - began < 90


def test_nodes_that_are_not_listed(spark):
    nodes = spark.createDataFrame([(0, "r", 0, i, t) for i, t in enumerate([0.0, 0.0, 3.0])], KEYS + "node_id long, time double")
    edges = spark.createDataFrame([(0, "r", 0, 0.0, 9.0, p, c) for p, c in [(2, 0), (2, 1), (7, 2)]], KEYS + "left double, right double, parent long, child long")
    muts = spark.createDataFrame([(0, "r", 0, 1.0, 7, "A"), (0, "r", 0, 2.0, 7, "A"), (0, "r", 0, 2.0, 2, "T")], KEYS + "position double, node long, derived_state string")
    sites = spark.createDataFrame([("r", "1", 1), ("r", "1", 2), ("r", "1", 3)], "region string, chrom string, pos long")
    got = Y.topology_metrics(nodes, edges, muts, sites, spark.createDataFrame([(0, 0), (1, 1)], "node_id long, species int")).collect()
    assert [(r["pos"], r["n_mut"], r["nonroot"], r["coalesce_ok"]) for r in got] == [(2, 1, False, True)]


def test_every_verdict_occurs_in_the_query(spark):
    got = tree_queries.topology_metrics(spark, "/root/testdata/sf0.01")
    row = got.agg(*[F.count_if(c).alias(c) for c in ("coalesce_ok", "nodes_ok", "nonroot", "first", "second", "yellow")], F.count(F.lit(1)).alias("n")).first()
    assert all(0 < row[c] < row["n"] for c in ("coalesce_ok", "nodes_ok", "nonroot", "first", "second", "yellow"))


@pytest.mark.parametrize("states", [("T", "A", "A"), ("A", "T", "A"), ("A", "A", "T"), (None, "A", "A")])
def test_mutations_of_one_node_and_site_go_by_state(spark, states):
    nodes = spark.createDataFrame([(0, "r", 0, i, t) for i, t in enumerate([0.0, 0.0, 3.0])], KEYS + "node_id long, time double")
    edges = spark.createDataFrame([(0, "r", 0, 0.0, 9.0, 2, c) for c in (0, 1)], KEYS + "left double, right double, parent long, child long")
    muts = spark.createDataFrame([(0, "r", 0, 1.0, 2, s) for s in states], KEYS + "position double, node long, derived_state string").coalesce(1)
    sites = spark.createDataFrame([("r", "1", 1)], "region string, chrom string, pos long")
    row = Y.topology_metrics(nodes, edges, muts, sites, spark.createDataFrame([(0, 0), (1, 1)], "node_id long, species int")).first()
    assert (row["n_mut"], row["n_fwd"], row["n_rev"]) == (3, 2, 1)


def test_times_of_many_and_of_large_genealogies_rise_without_a_call_each(spark):
    r = np.random.default_rng(5)
    rows = [(k % 2, "r" if k % 3 else None, k, i, float(r.integers(0, 4)) / 1e5) for k in range(30) for i in r.permutation(40).tolist()]
    nodes = spark.createDataFrame(rows, KEYS + "node_id long, time double")
    edges = spark.createDataFrame([], KEYS + "left double, right double, parent long, child long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out, _ = Y.clean_genealogy(nodes, edges)
        got = {(x["sample_idx"], x["node_id"]): x["time"] for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in range(30):
        mine = sorted((i, t) for *_, s, i, t in rows if s == k)
        assert [got[k, i] for i, _ in mine] == Y.strict_times(np.array([t for _, t in mine])).tolist()
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
