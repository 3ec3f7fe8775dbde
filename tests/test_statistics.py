"""Bins, ranks, tests, nulls and trees: worked figures, laws of the draws, and hand-made trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.tails import hypergeom_sf, kolmogorov_sf, norm_sf, student_sf
from strandloom.operators import bins as B, enrichment as E, genealogy as Y


def test_tails():
    total = sum(math.comb(7, k) * math.comb(13, 5 - k) for k in range(2, 6)) / math.comb(20, 5)
    assert hypergeom_sf(2, 20, 7, 5) == pytest.approx(total)
    assert hypergeom_sf(0, 20, 7, 5) == 1.0 and hypergeom_sf(6, 20, 7, 5) == 0.0
    assert norm_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert kolmogorov_sf(1.3581) == pytest.approx(0.05, abs=1e-4) and kolmogorov_sf(0.5) == pytest.approx(0.9639, abs=1e-3)
    assert student_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)


def test_bin_closures(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (None,)], "v double")
    edges = [0, 1, 2, 3]
    got = lambda how: [r[0] for r in df.select(B.assign_bin(F.col("v"), edges, how)).collect()]
    assert got("left") == [1, 2, 2, 3, 3, None]
    assert got("right") == [1, 1, 2, 2, 3, None]
    assert got("cut") == [1, 1, 2, 2, 3, None]
    assert got("digitize") == [0, 1, 2, 2, 3, None]


def test_survival_curve_against_definition(spark):
    ranges = [(0.0, 10.0), (5.0, 5.0), (10.0, 10.0), (3.0, 42.0), (12.0, 100.0)]
    df = spark.createDataFrame([([{"lower": a, "upper": b} for a, b in ranges],)], "samples array<struct<lower:double,upper:double>>")
    for row in B.survival_curve(df, 10.0, 50.0, 2).collect():
        t = row["age"]
        want = sum(min(1, max(0, (b - t) / (b - a))) if b > a else float(t < a) for a, b in ranges) / 2
        assert row["expected"] == pytest.approx(want), t


def test_adjustment_ranks_and_edges(spark):
    p = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("b", 0.9), ("a", None)], "g string, p double")
    got = {(r["g"], r["p"]): r["p_adjusted"] for r in B.bh_adjust(p, "p", ["g"]).collect()}
    assert got["a", 0.01] == pytest.approx(0.03) and got["a", 0.04] == pytest.approx(0.04) and got["a", 0.03] == pytest.approx(0.04) and got["a", None] is None
    v = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r["rank"] for r in B.avg_rank(v, "v").collect()) == [1.0, 2.5, 2.5, 4.0]
    w = spark.createDataFrame([(1.0, 1), (2.0, 1), (None, 2)], "v double, w int")
    assert B.weighted_edges(w, "v", F.col("w"), [0.5]).first()["edges"] == [1.0]
    assert B.weighted_edges(w, "v", F.col("w"), [0.5], drop_null_weight=False).first()["edges"] == [2.0]
    assert B.inverse_cumulative is not None and B.boundary_index(B.time_grid(5, 1.0, 8.0), 3.0) == 3


def test_interval_of_fractions(spark):
    den = spark.createDataFrame([(1, 0, 100), (1, 0, 100), (2, 0, 50)], "bin int, start long, end long")
    num = spark.createDataFrame([(1, 0, 50)], "bin int, start long, end long")
    got = {r["bin"]: (r["frac"], r["se"]) for r in B.bin_fractions(num, den, F.col("end") - F.col("start")).collect()}
    assert got[1] == (0.25, pytest.approx(math.sqrt(0.25 * 0.75 / 2))) and got[2][0] == 0


def test_rank_tests_match_direct_formulas(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 300), rng.integers(3, 43, 200)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")
    mw = E.mann_whitney(df, "g", "v", "a", "b").first()
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert mw["u"] == pytest.approx(u) and mw["p_greater"] == pytest.approx(u / 60000) and mw["p"] < 0.01
    ks = E.ks_2samp(df, "g", "v", "a", "b").first()
    grid = np.unique(np.concatenate([a, b]))
    assert ks["d"] == pytest.approx(max(abs((a <= x).mean() - (b <= x).mean()) for x in grid))
    xy = spark.createDataFrame([(float(i), float(-(i**3))) for i in range(20)], "x double, y double")
    assert E.spearman(xy, "x", "y").first()["rho"] == pytest.approx(-1)


def test_nulls_follow_their_laws(spark):
    row = E.subsample_null(spark, 6_435_348, 47_353, 66_622, 1020, 300, 5).first()
    assert row["mean"] == pytest.approx(66_622 * 47_353 / 6_435_348, rel=0.01) and row["fold"] == pytest.approx(2.08, abs=0.03) and row["p"] == pytest.approx(1 / 301)
    seg = spark.createDataFrame([(i, f"g{i % 20}") for i in range(200)], "seg long, gene string")
    sets = spark.createDataFrame([("l", "c", f"g{i}") for i in range(10)], "library string, category string, gene string")
    run = lambda bg: E.permutation_enrichment(seg.where("seg < 5"), bg, sets, 40, 9).collect()
    assert run(seg) == run(seg.repartition(5))
    sizes = spark.createDataFrame([("1", 1000)], "chrom string, length long")
    iv = spark.createDataFrame([("1", 0, 100), ("1", 5, 10)], "chrom string, start long, end long")
    ban = spark.createDataFrame([("1", 0, 300)], "chrom string, start long, end long")
    placed = E.shuffle_intervals(iv, sizes, 30, 3, ban).collect()
    assert len(placed) >= 58 and all(300 <= r["start"] and r["end"] <= 1000 for r in placed)


def test_matched_locus_null_and_anchors(spark):
    bg = spark.createDataFrame([(1 if i < 50 else 2, i * 10, i * 10 + 10, float(i % 4), f"g{i}", float(i % 7)) for i in range(100)], "run long, start long, end long, score double, gene string, distance double")
    loci = spark.createDataFrame([(1, 30, 1.0, 2.0), (2, 20, 0.0, 3.0)], "locus long, span long, low double, high double")
    got = E.matched_locus_null(loci, bg, 20, 4).collect()
    assert len(got) == 40 and all(1.0 <= r["mean_score"] <= 2.0 for r in got if r["locus"] == 1)
    pool = spark.createDataFrame([("1", i, float(i)) for i in range(500)], "chrom string, pos long, score double")
    picks = E.sample_null_loci(spark.createDataFrame([(1, 100.0, 2), (2, 5000.0, 2)], "locus long, score double, k int"), pool, 10, 3).collect()
    assert all(abs(r["score"] - 100) <= 20 for r in picks if r["locus"] == 1) and sum(r["locus"] == 2 for r in picks) == 10


def test_bootstrap_contains_the_ratio(spark):
    rng = np.random.default_rng(0)
    den = spark.createDataFrame([(1, f"c{i % 10}", float(x)) for i, x in enumerate(rng.integers(50, 150, 1000))], "bin int, chrom string, value double")
    num = spark.createDataFrame([(1, f"c{i % 10}", float(x)) for i, x in enumerate(rng.integers(10, 50, 300))], "bin int, chrom string, value double")
    ratio = num.agg(F.sum("value")).first()[0] / den.agg(F.sum("value")).first()[0]
    for method in ("segment", "chromosome"):
        r = E.bootstrap_ratio(num, den, 200, 1, method).first()
        assert r["low"] < ratio < r["high"] or method == "segment" and r["low"] <= ratio * 1.1


def test_redundant_categories_and_cover(spark):
    sets = spark.createDataFrame([(c, g) for c, gs in {"a": "xyz", "b": "xyz", "c": "yzq", "d": "m"}.items() for g in gs], "category string, gene string")
    got = {r["category"]: r["cluster"] for r in E.cluster_categories(sets, "jaccard", 0.5).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert [c for c, _ in E.greedy_cover(sets)] == ["a", "c", "d"]


def test_tiebreaks(spark):
    loci = spark.createDataFrame([(i, [f"g{i}"]) for i in range(6)], "locus long, genes array<string>")
    universe = spark.createDataFrame([(f"g{i}",) for i in range(100)], "gene string")
    sets = spark.createDataFrame([("l", "hit", f"g{i}") for i in range(6)] + [("l", "no", f"g{i}") for i in range(50, 60)], "library string, category string, gene string")
    got = {r["category"]: r["robust"] for r in E.tiebreak_enrichment(loci, sets, universe, 10, 1).collect()}
    assert got == {"hit": True}


def tree_tables(spark, muts):
    nodes = spark.createDataFrame([(0, "r", 0, i, t) for i, t in enumerate([0.0, 0.0, 0.0, 0.0, 5.0, 8.0, 20.0])], "run long, region string, sample_idx long, node_id long, time double")
    # leaves 0, 1 of one species and 2, 3 of the other: ((0,1),(2,3)) under the split 5+6
    edges = [(4, 0), (4, 1), (5, 2), (5, 3), (6, 4), (6, 5), (-1, 6)]
    edges = spark.createDataFrame([(0, "r", 0, 0.0, 100.0, p, c) for p, c in edges], "run long, region string, sample_idx long, left double, right double, parent long, child long")
    muts = spark.createDataFrame([(0, "r", 0, float(p), n, s) for p, n, s in muts], "run long, region string, sample_idx long, position double, node long, derived_state string")
    sites = spark.createDataFrame([("r", "1", p) for p in {int(m) for m in [10, 20, 30]}], "region string, chrom string, pos long")
    leaves = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node_id long, species int")
    return nodes, edges, muts, sites, leaves


def test_topology(spark):
    got = {r["pos"]: r for r in Y.topology_metrics(*tree_tables(spark, [(10, 6, "T"), (20, 4, "T"), (20, 4, "A"), (30, 6, "T"), (30, 5, "A")])).collect()}
    assert (got[10]["nonroot"], got[10]["first"], got[10]["second"]) == (False, False, False)  # alone on the root
    assert got[20]["n_mut"] == 2 and got[20]["n_fwd"] == 1 and got[20]["nonroot"] and not got[20]["first"]  # one species below
    assert not got[30]["nonroot"] and not got[30]["second"] and got[30]["node_age"] == 8.0 and got[30]["branch_midpoint"] == 14.0


def test_tree_verdicts():
    # a split into single species clades below a node that has an outgroup above it
    time = {0: 0, 1: 0, 2: 0, 3: 4.0, 4: 9.0}
    tree = Y.Tree(time, [(3, 0), (3, 1), (4, 3), (4, 2)], {0: 1, 1: 2, 2: 1})
    assert tree.splits_species(3) and tree.nonroot(3) and tree.few_lineages(3) and tree.passes(3)
    assert not tree.passes(4) and not tree.splits_species(0)
    assert Y.strict_times(np.array([0.0, 0.0, 5.0, 5.0, 4.0])).tolist() == pytest.approx([0, 0, 5.0, 5.0001, 5.0002])


def test_branch_ages(spark):
    nodes, edges, muts, _, _ = tree_tables(spark, [(10, 4, "T")])
    got = Y.branch_ages(nodes, edges, muts.withColumn("freq", F.lit(0.5)), 0.1).first()
    assert (got["lower"], got["upper"], got["mid_age"]) == (5.0, 20.0, 12.5)


def test_shuffled_intervals_use_every_gap_and_report_what_fits_nowhere(spark):
    sizes = spark.createDataFrame([("1", 100_000)], "chrom string, length long")
    iv = spark.createDataFrame([("1", 0, 100), ("1", 0, 5000)], "chrom string, start long, end long")
    ban = spark.createDataFrame([("1", 0, 40_000), ("1", 40_101, 99_900)], "chrom string, start long, end long")
    placed = E.shuffle_intervals(iv, sizes, 400, 3, ban).collect()
    assert len(placed) == 800 and len({(r["src_start"], r["replicate"]) for r in placed}) == 400
    starts = [r["start"] for r in placed if r["start"] is not None]
    assert len(starts) == 400 and set(starts) == {40_000, 40_001, 99_900} and all(r["end"] == r["start"] + 100 for r in placed if r["start"] is not None)
    assert all(starts.count(x) > 90 for x in set(starts))


def test_registered_nulls_have_1000_replicates(spark, monkeypatch):
    from strandloom.plans import catalog

    asked = []
    stop = lambda *args: asked.append(args) or (_ for _ in ()).throw(InterruptedError)
    monkeypatch.setattr(E, "permutation_enrichment", stop)
    monkeypatch.setattr(E, "shuffle_intervals", stop)
    for f in (catalog.permutation_enrichment, catalog.shuffled_placements):
        with pytest.raises(InterruptedError):
            f(spark, "/root/testdata/sf0.001")
    assert [asked[0][3], asked[1][2]] == [1000, 1000]


def test_anchors_are_drawn_with_replacement(spark):
    pool = spark.createDataFrame([("1", 1, 100.0), ("1", 2, 101.0), ("2", 3, 900.0)], "chrom string, pos long, score double")
    loci = spark.createDataFrame([(1, 100.0, 2), (2, 900.0, 1)], "locus long, score double, k int")
    picks = E.sample_null_loci(loci, pool, 50, 3).collect()
    assert sorted((r["replicate"], r["locus"]) for r in picks) == [(i, x) for i in range(50) for x in (1, 2)]
    assert {r["pos"] for r in picks if r["locus"] == 1} == {1, 2} and {r["pos"] for r in picks if r["locus"] == 2} == {3}


def test_long_chains_are_one_cluster_and_covers_are_whole(spark):
    order = np.random.default_rng(2).permutation(140)
    for names in (range(140), order.tolist()):
        chain = [(f"c{c:03d}", f"g{g:03d}") for i, c in enumerate(names) for g in (i, i + 1)]
        sets = spark.createDataFrame(chain, "category string, gene string")
        got = E.cluster_categories(sets, "jaccard", 0.3).collect()
        assert len(got) == 140 and {(r["cluster"], r["cluster_size"]) for r in got} == {("c000", 140)}
    with pytest.raises(RuntimeError):
        E.greedy_cover(sets.where("gene < 'g010'"), 2)
    few = sets.where("gene < 'g010'")
    assert sum(n for _, n in E.greedy_cover(few)) == few.select("gene").distinct().count()
