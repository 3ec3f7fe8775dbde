"""Evidence, gene decisions and the per-region tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.scalars import format_top, midpoint_age, normalise_trait
from strandloom.operators.islands import first_per_key
from strandloom.operators.nearest import nearest
from strandloom.operators.sites import exclude_region


#: Study types that count as molecular evidence. Fixed values.
MOLECULAR = ("eqtl", "pqtl", "sqtl", "tuqtl", "edqtl", "sceqtl", "scsqtl")


def flatten_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(molecular rows: id, gene, kind, tissue, pip; association rows: id, study, confidence, gene, l2g) of nested records
    (id, credibleSets.rows[...]). A gene goes by its symbol, a molecular one without symbol by its id; the probability is
    the first locus row's, null if it has none; other study types give no rows."""
    rows = evidence.select("id", F.explode_outer("credibleSets.rows").alias("r")).where("r is not null").withColumn("kind", F.lower("r.studyType"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    pip = F.get("r.locus.rows", F.lit(0))["posteriorProbability"]
    tissue = F.coalesce(some("r.study.biosample.biosampleName"), F.lit("?"))
    gene = F.coalesce(some("r.study.target.approvedSymbol"), some("r.qtlGeneId"))
    qtl = rows.where(F.col("kind").isin(*MOLECULAR)).select("id", gene.alias("gene"), "kind", tissue.alias("tissue"), pip.alias("pip"))
    gwas = rows.where("kind = 'gwas'").select("id", F.col("r.study.id").alias("study"), F.col("r.confidence").alias("confidence"), F.explode_outer("r.l2GPredictions.rows").alias("p"))
    return qtl, gwas.select("id", "study", "confidence", some("p.target.approvedSymbol").alias("gene"), F.col("p.score").alias("l2g"))


def best_evidence(qtl: DataFrame, gwas: DataFrame) -> DataFrame:
    """Per variant and gene the greatest pip (null counts as -1), its row, and the greatest l2g."""
    q = qtl.where("gene is not null").withColumn("pip", F.coalesce("pip", F.lit(-1.0)))
    best = q.groupBy("id", "gene").agg(F.max("pip").alias("pip"), F.max_by(F.struct("kind", "tissue"), F.struct("pip", "kind", "tissue")).alias("b"), F.countDistinct("tissue").alias("n_tissues"), F.countDistinct("kind").alias("n_kinds"), F.count(F.lit(1)).alias("n_sets"))
    l2g = gwas.where("gene is not null").groupBy("id", "gene").agg(F.max("l2g").alias("l2g"))
    return best.join(l2g, ["id", "gene"], "full").select("id", "gene", "pip", F.col("b.kind").alias("kind"), F.col("b.tissue").alias("tissue"), "n_tissues", "n_kinds", "n_sets", "l2g")


def majority_nearest(nearest_rows: DataFrame, by: str = "region") -> DataFrame:
    """The gene nearest to most variants of a region; ties go to the least distance, then the name."""
    counts = nearest_rows.groupBy(by, "gene").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance"))
    return first_per_key(counts, [by], [F.desc("n"), "distance", "gene"])


def assign_genes(variants: DataFrame, qtl: DataFrame, gwas: DataFrame, genes: DataFrame, l2g_min: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(regions, variants) with one gene a region: the highest l2g of at least ``l2g_min``; else the gene with molecular
    evidence in most tissues, kinds and sets, then by name; else the nearest gene of most variants.

    ``variants``: region, id, chrom, start, end; ``genes``: chrom, start, end, gene."""
    regions = variants.select("region").distinct()
    own = variants.select("region", "id")
    score = gwas.where("gene is not null and l2g is not null").join(own, "id").groupBy("region", "gene").agg(F.max("l2g").alias("l2g"))
    one = first_per_key(score.where(F.col("l2g") >= l2g_min), ["region"], [F.desc("l2g"), "gene"])
    mol = qtl.where("gene is not null").join(own, "id").groupBy("region", "gene").agg(F.countDistinct("tissue").alias("tissues"), F.countDistinct("kind").alias("kinds"), F.count(F.lit(1)).alias("sets"))
    two = first_per_key(mol, ["region"], [F.desc("tissues"), F.desc("kinds"), F.desc("sets"), "gene"])
    near = nearest(variants.select("chrom", "start", "end", "region", "id"), genes.select("chrom", "start", "end", "gene"), ties="first").withColumnRenamed("b_gene", "gene")
    three = majority_nearest(near)
    n_mol = mol.groupBy("region").agg(F.countDistinct("gene").alias("n_molqtl_genes"))
    out = (
        regions.join(one.select("region", F.col("gene").alias("g1"), "l2g"), "region", "left")
        .join(two.select("region", F.col("gene").alias("g2")), "region", "left")
        .join(three.select("region", F.col("gene").alias("nearest_gene"), F.col("distance").alias("nearest_distance")), "region", "left")
        .join(n_mol, "region", "left")
    )
    tier = F.when(F.col("g1").isNotNull(), "l2g").when(F.col("g2").isNotNull(), "molqtl").when(F.col("nearest_gene").isNotNull(), "nearest")
    decided = out.select("region", F.coalesce("g1", "g2", "nearest_gene").alias("assigned_gene"), tier.alias("tier"), "l2g", "nearest_gene", "nearest_distance", F.coalesce("n_molqtl_genes", F.lit(0)).alias("n_molqtl_genes"))
    return decided, variants.join(decided.select("region", "assigned_gene", "tier"), "region", "left")


def gwas_hits(gwas: DataFrame, studies: DataFrame) -> DataFrame:
    """Distinct (id, trait) of association rows whose study has a known trait."""
    return gwas.join(studies.select("study", "trait").where("trait is not null"), "study").select("id", normalise_trait(F.col("trait")).alias("trait")).distinct()


def collapse_genes(df: DataFrame, key: str, first: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """One row a gene: of ``first`` columns the least non-null value, of ``listed`` the distinct values joined by ``;``."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in first], *[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(c) for c in listed])


# -- candidates ----------------------------------------------------------------------------------------------------
def select_candidates(shared: DataFrame, min_age: float, excluded: tuple[str, int, int]) -> DataFrame:
    """Shared variants of at least ``min_age`` years by the mean of the bounds there are, outside one region, sorted."""
    aged = shared.withColumn("mid_age", midpoint_age(F.col("lower_age"), F.col("upper_age")))
    return exclude_region(aged.where(F.col("mid_age") >= min_age), *excluded).orderBy("chrom", "pos")


def candidate_presence(sites: DataFrame, candidates: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per region (region, chrom, status): ``ok`` if a candidate of its own is called, ``cross`` if only the position matches, on
    another chromosome, ``lost`` if none does; the recovered candidates; and the exclusions with newly lost regions.

    ``sites``: region, chrom, pos called; ``candidates``: region, chrom, pos."""
    called = sites.select("region", "chrom", "pos").distinct()
    exact = candidates.join(called, ["region", "chrom", "pos"], "left_semi")
    loose = candidates.join(called.select("region", "pos").distinct(), ["region", "pos"], "left_semi")
    mark = lambda df, name: df.groupBy("region").agg(F.count(F.lit(1)).alias(name))
    base = candidates.groupBy("region").agg(F.first("chrom").alias("chrom"), F.count(F.lit(1)).alias("n_candidates"))
    out = base.join(mark(exact, "n_exact"), "region", "left").join(mark(loose, "n_loose"), "region", "left").na.fill(0)
    status = F.when(F.col("n_exact") > 0, "ok").when(F.col("n_loose") > 0, "cross").otherwise("lost")
    out = out.withColumn("status", status)
    return out, exact, excluded.select("region").unionByName(out.where("status <> 'ok'").select("region")).distinct()


def candidate_status(candidates: DataFrame, regions: DataFrame, excluded: DataFrame, tested: DataFrame, finished: DataFrame) -> DataFrame:
    """Five-way status of each candidate: tested, untested site, unfinished region, excluded region, no region."""
    from strandloom.operators.intervals import assign_region

    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = assign_region(candidates, regions).join(flag(excluded, ["region"], "_x"), "region", "left").join(flag(finished, ["region"], "_f"), "region", "left").join(flag(tested, ["chrom", "pos"], "_t"), ["chrom", "pos"], "left")
    status = F.when(F.col("region").isNull(), "no_region").when(F.col("_t"), "tested").when(F.col("_x"), "excluded_region").when(F.col("_f"), "site_absent").otherwise("region_unfinished")
    return out.withColumn("status", status).drop("_x", "_f", "_t")


def loss_reason(lost: DataFrame, passed: DataFrame, failed: DataFrame, files: DataFrame) -> DataFrame:
    """Why a lost region's candidate (region, chrom, pos or null) is missing: no candidate, no file, passed, failed or never called."""
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = lost.join(flag(passed, ["chrom", "pos"], "_p"), ["chrom", "pos"], "left").join(flag(failed, ["chrom", "pos"], "_f"), ["chrom", "pos"], "left").join(flag(files, ["chrom"], "_d"), "chrom", "left")
    reason = F.when(F.col("pos").isNull(), "no_candidate").when(F.col("_d").isNull(), "no_file").when(F.col("_p"), "passed").when(F.col("_f"), "failed").otherwise("never_called")
    return out.withColumn("reason", reason).drop("_p", "_f", "_d")


# -- tables ---------------------------------------------------------------------------------------------------------
def region_summary(snps: DataFrame, traits: DataFrame | None = None, by: str = "region", value: str = "value", kind: str = "kind", k: int = 2) -> DataFrame:
    """Per region: sites, mean value, the distinct kinds sorted, and the ``k`` most frequent traits with how many more."""
    out = snps.groupBy(by).agg(F.count(F.lit(1)).alias("n_snps"), F.avg(value).alias("mean_value"), F.array_join(F.array_sort(F.collect_set(kind)), "; ").alias("kinds"))
    if traits is None:
        return out
    counts = traits.groupBy(by, "trait").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.lower("trait").alias("l"), F.col("trait").alias("t")))), lambda x: x["t"])
    return out.join(counts.groupBy(by).agg(format_top(ranked, k).alias("traits")), by, "left")


def region_tables(regions: DataFrame, snps: DataFrame, genes: DataFrame, spans: DataFrame, published: DataFrame, traits: DataFrame, decile_edges: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(all regions, those of several sites): summary, gene, genetic span, published overlaps, traits and decile of the mean."""
    from strandloom.operators.bins import assign_bin
    from strandloom.operators.intervals import tag_overlaps

    tagged = tag_overlaps(regions.select("region", "chrom", "start", "end"), published)
    out = tagged.join(region_summary(snps, traits), "region", "left").join(genes.select("region", "assigned_gene", "tier"), "region", "left").join(spans.drop("chrom", "start", "end"), "region", "left")
    out = out.withColumn("decile", assign_bin(F.col("mean_value"), decile_edges, "cut"))
    return out, out.where("n_snps > 1")


def support_by_site(metrics: DataFrame, keys: Sequence[str] = ("run", "region", "chrom", "pos")) -> DataFrame:
    """Per site over genealogies: mean counts, median age, how often each flag is true, and the sum of first and second."""
    out = metrics.groupBy(*keys).agg(
        F.avg("n_mut").alias("mean_n_mut"), F.avg("n_fwd").alias("mean_n_fwd"), F.avg("n_rev").alias("mean_n_rev"), F.percentile("oldest_age", 0.5).alias("median_oldest_age"),
        *[F.count_if(F.col(c)).alias(f"{c}_count") for c in ("coalesce_ok", "nodes_ok", "nonroot", "first", "second")], F.count(F.lit(1)).alias("n_samples"),
    )
    return out.withColumn("first_or_second_count", F.col("first_count") + F.col("second_count"))


def pool_support(df: DataFrame, chains: int, threshold: float, inclusive: bool = True, keys: Sequence[str] = ("chrom", "pos"), value: str = "support") -> DataFrame:
    """Support over chains: mean, its half-even rounding, and the verdicts any, majority, strict (all) and pooled (mean)."""
    over = F.col(value) >= threshold if inclusive else F.col(value) > threshold
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean_support"), F.count_if(over).alias("n_pass"), F.count(value).alias("n_chains"))
    mean = F.col("mean_support") >= threshold if inclusive else F.col("mean_support") > threshold
    return out.withColumn("rounded", F.bround("mean_support").cast("long")).withColumn("any", F.col("n_pass") > 0).withColumn("majority", F.col("n_pass") * 2 > chains).withColumn("strict", F.col("n_pass") == chains).withColumn("pooled", mean)


def support_track(chains: Sequence[DataFrame], alleles: DataFrame, chrom: str, start: int, end: int, candidates: DataFrame | None = None) -> DataFrame:
    """Mean support of the sites of one window (null-skipping over chains), with alleles, sorted by position."""
    from strandloom.operators.sites import join_replicates

    cut = [c.where((F.col("chrom") == chrom) & F.col("pos").between(start, end)) for c in chains]
    out = join_replicates(cut, ["chrom", "pos"], "support", "outer")
    if candidates is not None:
        out = out.join(candidates.select("chrom", "pos"), ["chrom", "pos"], "left_semi")
    return out.join(first_per_key(alleles, ["chrom", "pos"], ["ref", "alt"]), ["chrom", "pos"], "left").select("chrom", "pos", "ref", "alt", "mean").orderBy("pos")


def background_universe(foreground: DataFrame, nulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all genes of foreground and nulls, each replicate's gene set joined by commas)."""
    genes = foreground.select("gene").unionByName(nulls.select("gene")).distinct()
    w = nulls.where("gene is not null").groupBy("replicate").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))
    return genes, w


def tier_shares(df: DataFrame, tier: str = "tier") -> DataFrame:
    n = df.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a tier


def reassign_null(null_variants: DataFrame, qtl: DataFrame, gwas: DataFrame, genes: DataFrame) -> DataFrame:
    """The gene rule applied to null loci (replicate, locus, id, chrom, start, end): one gene each, then sets by replicate."""
    keyed = null_variants.withColumn("region", F.concat_ws(":", "replicate", "locus"))
    decided, _ = assign_genes(keyed, qtl, gwas, genes)
    return decided.select(F.split("region", ":")[0].cast("int").alias("replicate"), F.col("assigned_gene").alias("gene"), "tier")
