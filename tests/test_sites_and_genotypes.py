"""Filters, joins, genotype counts, coordinates and readers on small hand-made frames."""

import json
import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.operators import genes as G, genotypes as GT, remap as R, sites as J
from strandloom.sources import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_hard_filters_at_their_limits(spark):
    base = dict(qual=30.0, dp=950, n_geno=50, mq=40.0, mq_rank_sum=6.0, read_pos_rank_sum=-6.0, fs=60.0, base_q_rank_sum=None, qd=2.0, excess_het=28.69, af=0.5)
    rows = [base, base | {"dp": 949}, base | {"fs": 60.1, "mq": 39.9}, base | {"af": 1.0}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "qual double, dp int, n_geno int, mq double, mq_rank_sum double, read_pos_rank_sum double, fs double, base_q_rank_sum double, qd double, excess_het double, af double")
    good, bad = J.hard_filter(df)
    assert good.count() == 1
    assert sorted(r["reasons"] for r in bad.collect()) == [["depth"], ["mapping_quality", "strand"], ["monomorphic"]]


def test_site_set_operations(spark):
    a = spark.createDataFrame([("1", 5, "A", "G"), ("1", 5, "A", "G"), ("1", 9, "C", "T"), ("2", 5, "A", "G")], "chrom string, pos long, ref string, alt string")
    b = spark.createDataFrame([("1", 5, "A", "G"), ("1", 9, "C", "A")], "chrom string, pos long, ref string, alt string")
    both, _ = J.intersect_sites(a, b)
    assert both.count() == 2  # copies survive
    assert J.drop_sites(a, b).count() == 1
    assert J.exclude_region(a, "1", 5, 5).count() == 2
    assert J.min_ac(spark.createDataFrame([(3,), (4,)], "ac int"), 3).count() == 1
    reps = [spark.createDataFrame(x, "k long, v double") for x in ([(1, 1.0), (2, 2.0)], [(1, 3.0)])]
    assert [(r["k"], r["mean"]) for r in J.join_replicates(reps, ["k"], "v").collect()] == [(1, 2.0)]
    assert J.complete_groups(reps, "k").count() == 1


def test_merge_cohorts_renumbers_and_fills(spark):
    s = "chrom string, pos long, ref string, alts array<string>, genotypes array<struct<sample:string,a0:int,a1:int>>"
    a = spark.createDataFrame([("1", 5, "A", ["G"], [("x", 0, 1)])], s)
    b = spark.createDataFrame([("1", 5, "A", ["T", "G"], [("y", 1, 2)]), ("1", 7, "C", ["T"], [("y", 1, None)])], s)
    got = {r["pos"]: (r["alts"], [(g["sample"], g["a0"], g["a1"]) for g in r["genotypes"]]) for r in J.merge_cohorts(a, b, ["x"], ["y"]).collect()}
    assert got == {5: (["G", "T"], [("x", 0, 1), ("y", 2, 1)]), 7: (["T"], [("x", 0, 0), ("y", 1, None)])}


def test_counts_trios_and_missingness(spark):
    g = "pos long, genotypes array<struct<sample:string,a0:int,a1:int>>"
    df = spark.createDataFrame([(1, [("c", 0, 1), ("f", 0, 0), ("m", 0, 1)]), (2, [("c", 1, 1), ("f", 0, 0), ("m", 0, 1)]), (3, [("c", 1, 1), ("f", None, 0), ("m", 0, 1)])], g)
    tags = {r["pos"]: (r["ac"], r["an"], r["n_missing"]) for r in GT.fill_tags(df).collect()}
    assert tags == {1: (2, 6, 0), 2: (3, 6, 0), 3: (3, 5, 1)}
    assert sorted(r["pos"] for r in GT.drop_mendel_errors(df, [("c", "f", "m")]).collect()) == [1, 3]
    long = spark.createDataFrame([("1", p, s, None if (p, s) in ((1, "bad"), (2, "bad"), (3, "ok1")) else 0, 0) for p in (1, 2, 3) for s in ("ok1", "ok2", "bad")], "chrom string, pos long, sample string, a0 int, a1 int")
    kept = GT.missingness_filter(long, geno=0.3, mind=0.4)
    assert {(r["pos"], r["sample"]) for r in kept.collect()} == {(1, "ok1"), (1, "ok2"), (2, "ok1"), (2, "ok2")}


def test_r2_pca_prune_and_downsample(spark):
    x = {1: [0, 1, 2, 0, 1, 2], 2: [0, 1, 2, 0, 1, 2], 3: [2, 1, 0, 1, 0, 2]}
    long = spark.createDataFrame([("r", "all", p, f"s{i}", v) for p, d in x.items() for i, v in enumerate(d)], "region string, set string, pos long, sample string, dosage int")
    r2 = {(r["pos_a"], r["pos_b"]): r["r2"] for r in GT.pairwise_r2(long).collect()}
    assert abs(r2[1, 2] - 1) < 1e-12 and r2[1, 3] < 0.3
    wide = spark.createDataFrame([("1", p, [float(v) for v in d]) for p, d in x.items()], "chrom string, pos long, dosages array<double>")
    assert sorted(r["pos"] for r in GT.ld_prune(wide, r2=0.5).collect()) == [1, 3]
    values, vectors = GT.genotype_pca(wide, 2)
    assert values[0] >= values[1] and vectors.shape == (6, 2)
    samples = spark.createDataFrame([(f"s{i}", i % 3) for i in range(30)], "sample string, dosage int")
    chosen = GT.stratified_downsample(samples, 10, 1)
    assert chosen.count() == 10 and {r["sample"] for r in chosen.collect()} == {r["sample"] for r in GT.stratified_downsample(samples.repartition(7), 10, 1).collect()}


def test_haplotype_recoding(spark):
    haps = spark.createDataFrame([("1", 1, "G", "A", [0, 1]), ("1", 2, "A", "A", [1, 1]), ("1", 3, "A", "G", [0, 1])], "chrom string, pos long, ref string, alt string, alleles array<tinyint>")
    sites = spark.createDataFrame([("1", p, "A", "G") for p in (1, 2)], "chrom string, pos long, ref string, alt string")
    got = {r["pos"]: (r["ref"], r["alt"], r["alleles"]) for r in GT.fix_haplotype_coding(haps, sites).collect()}
    assert got == {1: ("A", "G", [1, 0]), 2: ("A", "G", [1, 1]), 3: ("A", "G", [0, 1])}


def test_lift_points_intervals_and_roundtrip(spark):
    blocks = spark.createDataFrame([("1", 0, 100, "x", 1000, 1100, "+"), ("1", 100, 200, "x", 5000, 5100, "-"), ("1", 150, 160, "y", 0, 10, "+")], "chrom string, start long, end long, t_chrom string, t_start long, t_end long, strand string")
    sites = spark.createDataFrame([("1", p, "A", "G", f"1_{p}") for p in (1, 101, 155, 500)], "chrom string, pos long, ref string, alt string, id string")
    lifted, lost = R.lift_points(sites, blocks)
    assert {(r["src_pos"], r["chrom"], r["pos"], r["ref"]) for r in lifted.collect()} == {(1, "x", 1001, "A"), (101, "x", 5100, "T")}
    assert {(r["pos"], r["reason"]) for r in lost.collect()} == {(155, "several blocks"), (500, "no block")}
    bases = spark.createDataFrame([("x", 1001, "g"), ("x", 5100, "G")], "chrom string, pos long, base string")
    swapped, rejected = R.lift_points(sites, blocks, bases)
    assert [(r["ref"], r["alt"], r["swapped"]) for r in swapped.collect()] == [("G", "A", True)]
    assert {r["reason"] for r in rejected.collect()} == {"several blocks", "no block", "base mismatch"}
    plain = blocks.where("t_chrom = 'x'")
    assert sorted(r["pos"] for r in R.roundtrip_consistent(sites, plain, R.reverse_blocks(plain)).collect()) == [1, 101, 155]
    iv = spark.createDataFrame([("1", 10, 50), ("1", 90, 110), ("1", 500, 600), ("1", 60, 140)], "chrom string, start long, end long")
    good, bad = R.lift_intervals(iv, plain)
    assert [(r["start"], r["end"]) for r in good.collect()] == [(1010, 1050)]
    assert {(r["start"], r["reason"]) for r in bad.collect()} == {(90, "split"), (500, "deleted"), (60, "split")}


def test_interpolation_clamps(spark):
    gmap = spark.createDataFrame([("1", 100, 1.0), ("1", 200, 3.0)], "chrom string, pos long, cm double")
    asks = spark.createDataFrame([("1", p) for p in (50, 100, 150, 900)], "chrom string, pos long")
    assert {r["pos"]: r["cm"] for r in R.interpolate(asks, gmap, block=60).collect()} == {50: 1.0, 100: 1.0, 150: 2.0, 900: 3.0}
    region = spark.createDataFrame([("r", "1", 100, 200), ("z", "1", 150, 150)], "region string, chrom string, start long, end long")
    got = {r["region"]: (r["span_cm_a"], r["rate_a"]) for r in R.genetic_span(region, {"a": gmap}).collect()}
    assert got == {"r": (2.0, 20000.0), "z": (0.0, None)}


def test_scalars(spark):
    assert one(spark, S.ancestral_allele(F.col("a")), a="c|||") == "C"
    assert one(spark, S.ancestral_allele(F.col("a"), False), a="c|||") is None
    assert one(spark, S.worst_effect(F.col("a")), a="intron_variant,missense_variant") == "missense"
    assert one(spark, S.distinct_subfield(F.col("a"), 1), a="x|p|;y|q|;z|p|") == ["p", "q"]
    assert one(spark, S.to_number(F.col("a")), a=".") is None
    assert one(spark, S.dosage(F.col("a")), a="0|1") == 1
    assert one(spark, S.dosage(F.col("a")), a="./1") is None
    assert one(spark, S.parse_region(F.col("a")), a="chr4:1,200-3,400").asDict() == {"chrom": "4", "start": 1200, "end": 3400}
    assert one(spark, S.cpg_flag(F.col("c"), F.col("x"), F.col("r"), F.col("a")), c="ACG", x="C", r="C", a="T") is True
    assert one(spark, S.cpg_flag(F.col("c"), F.col("x"), F.col("r"), F.col("a")), c="CGA", x="G", r="G", a="A") is True
    assert one(spark, S.cpg_flag(F.col("c"), F.col("x"), F.col("r"), F.col("a")), c="ACA", x="C", r="C", a="T") is False
    assert one(spark, S.midpoint_age(F.col("l"), F.col("u")), l=100.0, u=300.0) == 200 * 29
    one_bound = spark.createDataFrame([(100.0, None)], "l double, u double")
    assert one_bound.select(S.midpoint_age(F.col("l"), F.col("u"))).first()[0] == 2900 and one_bound.select(S.midpoint_age(F.col("l"), F.col("u"), require_both=True)).first()[0] is None


def test_gene_tiers(spark):
    variants = spark.createDataFrame([("r1", "v1", "1", 9, 10), ("r2", "v2", "1", 99, 100), ("r3", "v3", "1", 999, 1000)], "region string, id string, chrom string, start long, end long")
    gwas = spark.createDataFrame([("v1", "s", "c", "L", 0.6), ("v2", "s", "c", "M", 0.4)], "id string, study string, confidence string, gene string, l2g double")
    qtl = spark.createDataFrame([("v1", "Q", "eqtl", "t1", None), ("v2", "Q", "eqtl", "t1", 0.1), ("v2", "Q", "sqtl", "t2", 0.9), ("v2", "P", "eqtl", "t1", 0.9)], "id string, gene string, kind string, tissue string, pip double")
    genes = spark.createDataFrame([("1", 50, 60, "N"), ("1", 2000, 2100, "F")], "chrom string, start long, end long, gene string")
    regions, _ = G.assign_genes(variants, qtl, gwas, genes)
    assert {r["region"]: (r["assigned_gene"], r["tier"]) for r in regions.collect()} == {"r1": ("L", "l2g"), "r2": ("Q", "molqtl"), "r3": ("N", "nearest")}
    assert {(r["id"], r["gene"]): r["pip"] for r in G.best_evidence(qtl, gwas).collect()}["v1", "Q"] == -1.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\n1\t100\t.\tA\tG,T\t50\tPASS\tDP=10;DB\tGT:DP:PL\t0|1:7:1,2,3\t./.:.:.\n")
    row = T.read_vcf(spark, str(tmp_path / "a.vcf"), {"DP": "int", "DB": "boolean"}, ["s1", "s2"]).first()
    assert (row["id"], row["alts"], row["DP"], row["DB"], row["genotypes"][0]["a1"], row["genotypes"][0]["phased"], row["genotypes"][1]["a0"], row["genotypes"][0]["pl"]) == (None, ["G", "T"], 10, True, 1, True, None, [1, 2, 3])
    (tmp_path / "c.chain").write_text("chain 100 1 500 + 0 30 x 900 - 10 45 7\n10 5 10\n15\n\n")
    got = [(r["start"], r["end"], r["t_start"], r["t_end"], r["strand"]) for r in T.read_chain(spark, str(tmp_path / "c.chain")).collect()]
    assert got == [(0, 10, 880, 890, "-"), (15, 30, 855, 870, "-")]
    (tmp_path / "gmt").mkdir()
    (tmp_path / "gmt" / "lib.gmt").write_text("setA\tdesc\tg1,1.0\tG2\n")
    assert {(r["library"], r["gene"]) for r in T.read_gmt(spark, str(tmp_path / "gmt")).collect()} == {("lib", "G1"), ("lib", "G2")}
    (tmp_path / "w.txt").write_text("#h\n1000000\n500000\n250000\n")
    w = T.read_window_scores(spark, str(tmp_path / "w.txt"), {"1": 2, "2": 1})
    assert sorted((r["chrom"], r["start"], r["value"]) for r in w.collect()) == [("1", 0, 1.0), ("1", 1000, 0.5), ("2", 0, 0.25)]
    (tmp_path / "g.gtf").write_text('1\tx\ttranscript\t11\t20\t.\t+\t.\tgene_type "protein_coding"; gene_name "AB"; tag "Ensembl_canonical";\n')
    assert T.read_gtf_transcripts(spark, str(tmp_path / "g.gtf")).first().asDict() == {"chrom": "1", "start": 10, "end": 20, "gene": "AB", "canon": True}


def test_pruning_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((330, 12), int)
    x[0] = rng.integers(0, 3, 12)
    for i in range(1, 330):  # neighbours are linked
        x[i] = np.where(rng.random(12) < 0.12, rng.integers(0, 3, 12), x[i - 1])
    df = spark.createDataFrame([("1", 10 * i, [float(v) for v in d]) for i, d in enumerate(x)], "chrom string, pos long, dosages array<double>")
    uncut = sorted(r["pos"] for r in GT.ld_prune(df, 20, 5, 0.3, 1000).collect())
    assert 0 < len(uncut) < 330
    assert sorted(r["pos"] for r in GT.ld_prune(df, 20, 5, 0.3, 60).collect()) == uncut
    assert sorted(r["pos"] for r in GT.ld_prune(df, 20, 5, 0.3, 60, "out").collect()) == sorted(set(range(0, 3300, 10)) - set(uncut))


def test_nested_evidence(spark, tmp_path):
    from strandloom.sources import text as T

    row = {"studyType": "eQTL", "qtlGeneId": "ENSG1", "confidence": "high", "study": {"id": "s1", "target": {"id": "ENSG1", "approvedSymbol": "AB"}, "biosample": {"biosampleName": "blood"}}, "locus": {"rows": [{"posteriorProbability": 0.2}, {"posteriorProbability": 0.9}]}}
    bare = {"studyType": "pqtl", "qtlGeneId": "ENSG9", "study": {"id": "s2", "target": None, "biosample": None}, "locus": None}
    gwas = {"studyType": "gwas", "confidence": "low", "study": {"id": "s3"}, "l2GPredictions": {"rows": [{"score": 0.7, "target": {"id": "ENSG2", "approvedSymbol": "CD"}}]}}
    other = {"studyType": "unknownqtl", "qtlGeneId": "ENSG5"}
    (tmp_path / "e.json").write_text(json.dumps({"id": "v1", "credibleSets": {"count": 4, "rows": [row, bare, gwas, other]}}) + "\n" + json.dumps({"id": "v2", "credibleSets": None}) + "\n")
    qtl, found = G.flatten_evidence(T.read_evidence(spark, str(tmp_path / "e.json")))
    assert sorted(map(tuple, qtl.collect())) == [("v1", "AB", "eqtl", "blood", 0.2), ("v1", "ENSG9", "pqtl", "?", None)]
    assert [tuple(r) for r in found.collect()] == [("v1", "s3", "low", "CD", 0.7)]


def test_a_long_gene_set_is_read_in_one_pass(spark, tmp_path):
    import time

    from strandloom.sources import text as T

    (tmp_path / "long.gmt").write_text("A\t\t" + "\t".join(f" g{i % 15000},1.0" for i in range(20_000)) + "\nB\nC\t\t\n\t\tg1\n")
    began = time.time()
    got = T.read_gmt(spark, str(tmp_path / "long.gmt")).groupBy("library", "category").count().collect()
    assert {tuple(r) for r in got} == {("long", "A", 15_000), ("long", "", 1)} and time.time() - began < 20


def test_evidence_is_written_compressed(spark, tmp_path, monkeypatch):
    from strandloom.plans import decision_queries as Q

    monkeypatch.setattr(Q, "fresh_path", lambda spark, label: str(tmp_path / label))
    assert Q.read_evidence(spark, "/root/testdata/sf0.001").count() > 0
    parts = list((tmp_path / "evidence").glob("part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
