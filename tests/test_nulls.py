"""Repeatable draws and the nulls made of them, against plain loops."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import draws as D
from strandloom.operators import bins as B, carry, enrichment as E, genotypes as GT, locus_null as L, remap as R
from strandloom.operators.stretches import Least


def test_draws_are_the_same_in_all_engines(spark):
    got = spark.range(300).select("id", D.draw(F.col("id") + 3, 5, F.col("id") * F.lit(10**12), F.col("id")), D.permuted(F.col("id") % 17, 17, 9, F.floor(F.col("id") / 17))).collect()
    want = duckdb.sql(f"SELECT range, {D.sql_draw('range + 3', 5, 'range * 1000000000000', 'range')}, {D.sql_permuted('range % 17', '17', 9, 'range // 17')} FROM range(300)").fetchall()
    i = np.arange(300)
    assert [tuple(r) for r in got] == want == list(zip(i.tolist(), D.draw_array(i + 3, 5, i * 10**12, i).tolist(), D.permuted_array(i % 17, np.int64(17), 9, i // 17).tolist(), strict=True))


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 70_001])
def test_permutations_are_whole_and_even(n):
    assert sorted(D.permuted_array(np.arange(n), np.int64(n), 1, 2).tolist()) == list(range(n))
    first = np.bincount(D.permuted_array(np.zeros(20_000, int), np.int64(min(n, 20)), 1, np.arange(20_000)), minlength=min(n, 20))
    assert abs(first - 20_000 / min(n, 20)).max() < 5 * np.sqrt(20_000 / min(n, 20)) + 1


def test_numbers_over_the_whole_table(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a long, b long").repartition(6)
    got = sorted(carry.numbered(df, ["a", "b"]).collect(), key=lambda r: r["number"])
    assert [r["number"] for r in got] == list(range(500)) and [(r["a"], r["b"]) for r in got] == sorted((i % 7, i) for i in range(500))
    assert carry.numbered(df.where("a > 9"), ["a"]).count() == 0


def segments(n, seed):
    """Runs of unequal rows with null scores and null distances."""
    r, rows, at = np.random.default_rng(seed), [], 0
    run = 0
    for i in range(n):
        if r.random() < 0.05:
            run, at = run + 1, int(r.integers(1000))
        size = int(r.choice([1, 5, 10, 200]))
        rows.append((run, at, at + size, None if r.random() < 0.1 else float(r.integers(10)), f"g{i}", None if r.random() < 0.3 else float(r.integers(6))))
        at += size
    return sorted(rows)


def plain_null(loci, rows, n_perm, seed, tries, cap):
    out = []
    for locus, span, low, high in loci:
        for rep in range(n_perm):
            found = (rep, locus, None, None, None, None)
            for a in range(tries):
                i = int(D.draw_array(len(rows), seed, rep, locus, a))
                j = next((j for j in range(i, len(rows)) if rows[j][0] == rows[i][0] and rows[j][2] >= rows[i][1] + max(span, 1)), None)
                if j is None:
                    continue
                part = rows[i : j + 1]
                d = sum(e - s for _, s, e, v, _, _ in part if v is not None)
                mean = sum((e - s) * v for _, s, e, v, _, _ in part if v is not None) / d if d else None
                near = min(((x[5], k) for k, x in enumerate(part) if x[5] is not None), default=None)
                if mean is None or (low is not None and mean <= low) or (high is not None and mean > high) or near is None or (cap is not None and near[0] > cap):
                    continue
                found = (rep, locus, part[near[1]][4], near[0], mean, a)
                break
            out.append(found)
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("cap", [None, 1.0])
def test_matched_locus_null_equals_the_plain_loop(spark, cap):
    rows = segments(300, 3)
    loci = [(1, 30, None, 4.0), (2, 500, 3.0, None), (3, 0, 2.0, 6.0), (4, 10**6, None, None), (5, 90, 8.5, 9.0)]
    ask = spark.createDataFrame(loci, "locus long, span long, low double, high double")
    bg = spark.createDataFrame(rows, "run long, start long, end long, score double, gene string, distance double")
    want = plain_null(loci, rows, 12, 7, 20, cap)
    assert any(x[2] is None for x in want) and any(x[5] and x[5] > 7 for x in want)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((tuple(r) for r in L.matched_locus_null(ask, bg.repartition(parts), 12, 7, 20, cap, block=150).select("replicate", "locus", "gene", "distance", "mean_score", "attempt").collect()), key=lambda x: x[:2])
        assert [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in want]
        assert [x[4] for x in got] == [None if x[4] is None else pytest.approx(x[4]) for x in want]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["locus"], r["gene"]) for r in L.matched_locus_null(ask, bg.where("run < 0"), 2, 7).collect()} == {(x[0], None) for x in loci}


def test_null_loci_and_their_sites(spark):
    r = np.random.default_rng(1)
    pool = [(str(int(c)), int(p), float(s)) for c, p, s in zip(r.integers(1, 4, 400), r.integers(0, 900, 400), r.integers(0, 300, 400), strict=True)]
    loci = [(1, 150.0, 3, 10), (2, 900.0, 1, 5), (3, -500.0, 2, 60), (4, 0.0, 5, 1)]
    made, asked = spark.createDataFrame(pool, "chrom string, pos long, score double"), spark.createDataFrame(loci, "locus long, score double, k int, span long")
    got = L.sample_null_loci(asked, made, 6, 9, 20.0, 15)
    ranked = sorted((s, c, p) for c, p, s in pool)
    for row in got.collect():
        goal = next(x[1] for x in loci if x[0] == row["locus"])
        inside = [i for i, x in enumerate(ranked) if abs(x[0] - goal) <= 20]
        if not inside:
            c = sum(x[0] < goal for x in ranked)
            inside = sorted(sorted(range(len(ranked)), key=lambda i: (abs(ranked[i][0] - goal), abs(i - c + 0.5), i))[:15])
        s, c, p = ranked[inside[0] + int(D.draw_array(len(inside), 9, row["locus"], row["replicate"]))]
        assert (row["score"], row["chrom"], row["pos"]) == (s, c, p)
    sites = L.null_locus_sites(got, made).collect()
    assert len(sites) == 6 * sum(x[2] for x in loci)
    for anchor in got.collect():
        own = sorted(x["pos"] for x in sites if (x["replicate"], x["locus"]) == (anchor["replicate"], anchor["locus"]))
        near = sorted((abs(p - anchor["pos"]), p) for c, p, _ in pool if c == anchor["chrom"])[: anchor["k"]]
        assert own == sorted(p for _, p in near)
    out = L.check_matching(asked, L.null_locus_sites(got, made)).first()
    assert out["foreground"][3] == 75.0 and 0 < out["d"] <= 1 and out["span"] == 10.0 and 0 <= out["share_wide"] <= 1
    assert L.check_matching(asked.select("score"), made).first()["share_wide"] is None


def test_segment_draws_have_no_repeats(spark):
    seg = spark.createDataFrame([(i, f"g{i}") for i in range(50)], "seg long, gene string")
    sets = spark.createDataFrame([("l", "all", f"g{i}") for i in range(50)], "library string, category string, gene string")
    row = E.permutation_enrichment(seg.where("seg < 20"), seg, sets, 30, 5).first()
    assert (row["k"], row["null_mean"], row["p"]) == (20, 20.0, 1.0)


# -- linkage by planes of bits ---------------------------------------------------------------------------------------
def plain_r2(gt, pairs):
    out = {}
    for a, b in pairs:
        both = [(gt[a][s], gt[b][s]) for s in gt[a].keys() & gt[b].keys() if gt[a][s] is not None and gt[b][s] is not None]
        x, y = np.array(both, float).reshape(-1, 2).T
        flat = len(x) == 0 or x.std() == 0 or y.std() == 0
        out[a, b] = (len(x), None if flat else pytest.approx(np.corrcoef(x, y)[0, 1] ** 2))
    return out


@pytest.mark.parametrize("sites", [1, 3, 256])
def test_r2_by_blocks_of_bits(spark, sites):
    r = np.random.default_rng(sites)
    rows, gt = [], {}
    for region in ("a", "b"):
        for pos in r.choice(1000, 10, replace=False).tolist():
            for s in range(13):
                if r.random() < 0.9:
                    d = None if r.random() < 0.1 else int(r.integers(0, 3)) if pos % 5 else 1
                    rows.append((region, pos, f"s{s}", d))
                    gt.setdefault((region, pos), {})[f"s{s}"] = d
    rows += [x for x in rows[:9]]
    df = spark.createDataFrame(rows, "region string, pos long, sample string, dosage int").repartition(3)
    got = {((x["region"], x["pos_a"]), (x["region"], x["pos_b"])): (x["n"], x["r2"]) for x in GT.pairwise_r2(df, ("region",), sites).collect()}
    assert got == plain_r2(gt, [(a, b) for a in gt for b in gt if a[0] == b[0] and a[1] < b[1]])
    own = sorted(p for g, p in gt if g == "a")
    first, second = own[:4], own[2:]
    cut = lambda ps: spark.createDataFrame([(p,) for p in ps], "pos long")
    r2, summary = GT.cross_ld(df.where("region = 'a'"), cut(first), cut(second), ("region",))
    want = plain_r2(gt, [(("a", a), ("a", b)) for a in first for b in second])
    assert {(("a", x["pos_a"]), ("a", x["pos_b"])): (x["n"], x["r2"]) for x in r2.collect()} == want
    assert summary.first()["max_r2"] == pytest.approx(1.0)
    assert GT.pairwise_r2(df.where("pos < 0"), ("region",)).count() == 0


# -- slices of groups, bootstrap, covers, composed maps ----------------------------------------------------------------
def test_ranks_within_groups_equal_one_pass(spark):
    r = np.random.default_rng(2)
    rows = [(g, i, None if r.random() < 0.1 else float(r.integers(40)) / 40) for i, g in enumerate(r.choice(["big"] * 30 + ["b", "c", None], 600).tolist())]
    df = spark.createDataFrame(rows, "g string, i long, p double").repartition(5)
    adjusted = {x["i"]: x["p_adjusted"] for x in B.bh_adjust(df, "p", ["g"]).collect()}
    ranks = {x["i"]: x["rank"] for x in B.avg_rank(df, "p", ["g"]).collect()}
    shares = {(x["g"], x["p"]): x["share"] for x in B.ecdf(df, "g", "p").collect()}
    assert len(adjusted) == len(ranks) == len(rows)
    for g, i, p in rows:
        own = sorted(x[2] for x in rows if x[0] == g and x[2] is not None)
        if p is None:
            assert adjusted[i] is None and ranks[i] is None
            continue
        upto = lambda v, own=own: sum(x <= v for x in own)
        assert adjusted[i] == pytest.approx(min(1.0, min(x * len(own) / upto(x) for x in own if x >= p)))
        assert ranks[i] == upto(p) - (own.count(p) - 1) / 2 and shares[g, p] == pytest.approx(upto(p) / len(own))
    whole = {x["i"]: x["p_adjusted"] for x in B.bh_adjust(df, "p").collect()}
    own = sorted(x[2] for x in rows if x[2] is not None)
    assert all(whole[i] is None if p is None else whole[i] == pytest.approx(min(1.0, min(x * len(own) / sum(y <= x for y in own) for x in own if x >= p))) for _, i, p in rows)


@pytest.mark.parametrize("size", [1, 7, 1 << 14])
def test_bootstrap_draws_add_up(spark, size):
    rows = spark.createDataFrame([(b, t, float(i % 50)) for b in (1, 2) for t in (0, 1) for i in range(100 * b)], "bin int, t int, value double")
    ones = rows.withColumn("value", F.col("value") * 0 + 1 + F.col("value") * 0)
    assert {(r["bin"], r["total"]) for r in E.bootstrap_sums(ones, 20, 3, size).collect()} == {(1, 100.0), (2, 200.0)}
    got = E.bootstrap_sums(rows, 300, 3, size).where("bin = 2 and t = 0").agg(F.avg("total").alias("m"), F.stddev("total").alias("s"), F.count(F.lit(1)).alias("n")).first()
    values = np.array([i % 50 for i in range(200)], float)
    assert got["n"] == 300 and got["m"] == pytest.approx(values.sum(), rel=0.02) and got["s"] == pytest.approx(values.std() * 200**0.5, rel=0.2)


def test_cover_rounds_equal_the_greedy_steps(spark):
    r = np.random.default_rng(5)
    for trial in range(3):
        sets = {f"c{c:02d}": set(r.integers(0, 60, int(r.integers(1, 15))).tolist()) for c in range(30)}
        left, want = set().union(*sets.values()), []
        while left:
            name = min(sets, key=lambda c: (-len(sets[c] & left), c))
            want.append((name, len(sets[name] & left)))
            left -= sets[name]
        df = spark.createDataFrame([(c, f"g{g}") for c, gs in sets.items() for g in gs], "category string, gene string")
        assert E.greedy_cover(df) == want
    many = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"), F.explode(F.sequence(F.col("id") * 3, F.col("id") * 3 + F.col("id") % 4)).alias("gene"))
    assert E.cover_rounds(many).agg(F.count(F.lit(1)).alias("k"), F.max("round").alias("r")).first()["k"] > 10_000


def test_composed_blocks_equal_lifting_twice(spark):
    r = np.random.default_rng(8)
    schema = "chrom string, start long, end long, t_chrom string, t_start long, t_end long, strand string"

    def blocks(n):
        out = []
        for _ in range(n):
            s, t, size = (int(x) for x in r.integers(0, 300, 3))
            out.append((str(r.integers(2)), s, s + size % 60 + 1, str(r.integers(2)), t, t + size % 60 + 1, str(r.choice(["+", "-"]))))
        return out

    first, second = (spark.createDataFrame(blocks(n), schema) for n in (8, 9))
    sites = spark.createDataFrame([(str(c), p, f"{c}_{p}", "A", "C") for c in range(2) for p in range(1, 380)], "chrom string, pos long, id string, ref string, alt string")
    there, _ = R.lift_points(sites, first, width=50)
    back, _ = R.lift_points(there.drop("src_chrom", "src_pos"), second, width=50)
    once, _ = R.lift_points(sites, R.compose_blocks(first, second, 50, 40), width=50)
    rows = lambda df: sorted((x["id"], x["chrom"], x["pos"], x["ref"], x["alt"]) for x in df.collect())
    assert rows(once) == rows(back) and len(rows(once)) > 20
    kept = {x["id"] for x in R.roundtrip_consistent(sites, first, R.reverse_blocks(first), width=50, block=40).collect()}
    home, _ = R.lift_points(there.drop("src_chrom", "src_pos"), R.reverse_blocks(first), width=50)
    assert kept == {x["id"] for x in home.collect() if x["id"] == f"{x['chrom']}_{x['pos']}"} and kept


def test_draws_of_matched_loci_are_dealt_over_tasks(spark, monkeypatch):
    plans, kept = [], L.settled
    monkeypatch.setattr(L, "settled", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if label == "drawn" else None, kept(df, label))[1])
    bg = spark.range(400).select(F.floor(F.col("id") / 40).alias("run"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"), (F.col("id") % 9).alias("score"), F.lit("g").alias("gene"), (F.col("id") % 50).alias("distance"))
    loci = spark.range(6).select(F.col("id").alias("locus"), F.lit(20).alias("span"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    assert L.matched_locus_null(loci, bg, 3, 1).count() == 18
    assert plans and all(p.count("REPARTITION_BY_NUM") >= 2 for p in plans)


def test_a_gene_hit_in_many_replicates_is_a_row_a_word(spark):
    seg = spark.range(40).select(F.col("id").alias("seg"), (F.col("id") % 3).cast("string").alias("gene"))
    sets = spark.createDataFrame([("l", "c", "0"), ("l", "c", "1"), ("l", "d", "2")], "library string, category string, gene string")
    out = E.permutation_enrichment(seg.where("seg < 2"), seg, sets, 130, 7)
    place = D.permuted_array(np.tile(np.arange(2), 130), np.full(260, 40), 7, np.repeat(np.arange(130), 2)).reshape(130, 2) % 3
    k = np.array([len({g for g in row if g < 2}) for row in place.tolist()])
    row = out.first()
    assert (row["category"], row["k"]) == ("c", 2) and abs(row["null_mean"] - k.mean()) < 1e-12 and abs(row["p"] - ((k >= 2).sum() + 1) / 131) < 1e-12
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("rows_in_block", "share"), [(3, 1 << 16), (8, 20)])
def test_stretches_over_several_blocks_equal_the_plain_loop(spark, monkeypatch, rows_in_block, share):
    monkeypatch.setattr(L, "SHARE", share)
    monkeypatch.setattr(L, "ATTEMPTS", 2)
    rows = [(run, a, b, float("nan") if i % 37 == 0 else s, g, float("nan") if i % 41 == 0 else d) for i, (run, a, b, s, g, d) in enumerate(segments(300, 3))]
    loci = [(1, 30, None, 4.0), (2, 500, 3.0, None), (3, 0, 2.0, 6.0), (4, 10**6, None, None), (5, 900, None, None)]
    bg = spark.createDataFrame(rows, "run long, start long, end long, score double, gene string, distance double").repartition(3)
    known = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row) for row in rows]
    for cap in (None, 1.0):
        want = plain_null(loci, known, 12, 7, 20, cap)
        assert sum(x[2] is not None for x in want if x[1] in (2, 5)) > 10
        got = sorted((tuple(r) for r in L.matched_locus_null(spark.createDataFrame(loci, "locus int, span long, low double, high double"), bg, 12, 7, 20, cap, 150, rows_in_block).select("replicate", "locus", "gene", "distance", "mean_score", "attempt").collect()), key=lambda x: x[:2])
        assert [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in want]
        assert [x[4] for x in got] == [None if x[4] is None else pytest.approx(x[4]) for x in want]


def test_matched_loci_send_no_table_through_the_driver(spark, monkeypatch):
    plans, kept = {}, L.settled
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "settled", lambda df, label: (plans.setdefault(label, []).append(plan(df)), kept(df, label))[1])
    bg = spark.range(400).select(F.floor(F.col("id") / 40).alias("run"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"), (F.col("id") % 9).alias("score"), F.lit("g").alias("gene"), (F.col("id") % 50).alias("distance"))
    loci = spark.range(6).select(F.col("id").alias("locus"), F.lit(20).alias("span"), F.lit(7.0).alias("low"), F.lit(None).cast("double").alias("high"))
    out = L.matched_locus_null(loci, bg, 3, 1)
    assert len(plans["drawn"]) > 1 and not any("Broadcast" in p for p in [*plans["drawn"], plan(out)])


def test_carries_are_merged(spark):
    df = spark.range(100).select((F.col("id") % 9).alias("g"), F.col("id").alias("pos"))
    for out in (carry.running(df, ["g"], "pos", ["pos"], {"n": ("count", F.col("pos"))}, block=10), carry.previous(df, ["g"], "pos", ["pos"], {"last": "pos"}, block=10)):
        assert out.count() == 100 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_least_of_a_stretch_is_that_of_a_plain_search():
    r = np.random.default_rng(3)
    for n in (1, 2, 33, 200):
        values = r.integers(0, 9, n).astype(float)
        values[r.random(n) < 0.4] = np.nan
        low = r.integers(0, n, 300)
        high = np.minimum(low + r.integers(0, n, 300), n - 1)
        want = [min(((values[k], k) for k in range(a, b + 1) if not np.isnan(values[k])), default=(0, -1))[1] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        assert Least(values).place(low, high).tolist() == want


def test_anchors_and_their_sites_send_no_pool_through_the_driver(spark, monkeypatch):
    plans, kept = {}, L.settled
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "settled", lambda df, label: (plans.setdefault(label, []).append(plan(df)), kept(df, label))[1])
    pool = spark.range(200).select((F.col("id") % 2).cast("string").alias("chrom"), F.col("id").alias("pos"), (F.col("id") % 90).cast("double").alias("score"))
    loci = spark.createDataFrame([(1, 40.0, 2), (2, 5000.0, 1)], "locus long, score double, k int")
    anchors = L.sample_null_loci(loci, pool, 4, 3, 5.0, 10)
    own = kept(anchors, "anchors")
    sites = L.null_locus_sites(own, pool)
    assert sites.count() == 12 and not any("Broadcast" in p for p in (*plans["loci"], plan(anchors), plan(sites)))
