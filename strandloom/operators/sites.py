"""Filters, set operations and lookups on site tables: equi-joins on (chrom, pos[, ref, alt]) that Catalyst plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.scalars import site_id

#: Limits of the hard filters. Fixed values.
HARD_LIMITS = {
    "depth_low": 950, "depth_high": 2850, "min_genotyped": 50, "min_mq": 40.0, "max_rank_sum": 6.0,
    "max_strand": 60.0, "min_qual": 30.0, "min_qd": 2.0, "max_excess_het": 28.69,
}


def biallelic_snps(df: DataFrame) -> DataFrame:
    """Sites with one alternative, both alleles of one base (``alts`` array, ``ref``)."""
    return df.where((F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(F.get("alts", F.lit(0))) == 1))


def mask_uncalled(df: DataFrame, genotypes: str = "genotypes") -> DataFrame:
    """Genotypes without depth or without likelihood become null in the array of (sample, a0, a1, dp, pl) structs."""
    empty = lambda g: F.coalesce((g["dp"] == 0) | (F.array_max(g["pl"]) == 0), F.lit(False))
    blank = lambda g: g.withField("a0", F.lit(None).cast("int")).withField("a1", F.lit(None).cast("int"))
    return df.withColumn(genotypes, F.transform(genotypes, lambda g: F.when(empty(g), blank(g)).otherwise(g)))


def filter_reasons(limits: Mapping[str, float] = HARD_LIMITS) -> Column:
    """Names of the hard filters that a site fails; a null metric does not fail its filter."""
    c = F.col
    rules = {
        "depth": (c("dp") < limits["depth_low"]) | (c("dp") > limits["depth_high"]),
        "genotyped": c("n_geno") < limits["min_genotyped"],
        "mapping_quality": c("mq") < limits["min_mq"],
        "mq_rank_sum": F.abs("mq_rank_sum") > limits["max_rank_sum"],
        "read_pos_rank_sum": F.abs("read_pos_rank_sum") > limits["max_rank_sum"],
        "base_q_rank_sum": F.abs("base_q_rank_sum") > limits["max_rank_sum"],
        "strand": c("fs") > limits["max_strand"],
        "qual": c("qual") < limits["min_qual"],
        "quality_by_depth": c("qd") < limits["min_qd"],
        "excess_het": c("excess_het") > limits["max_excess_het"],
        "monomorphic": (c("af") == 0) | (c("af") == 1),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def hard_filter(df: DataFrame, limits: Mapping[str, float] = HARD_LIMITS) -> tuple[DataFrame, DataFrame]:
    """(sites that pass, sites that fail with their ``reasons``)."""
    marked = df.withColumn("reasons", filter_reasons(limits))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def variable_only(df: DataFrame, af: str = "af") -> DataFrame:
    return df.where((F.col(af) != 0) & (F.col(af) != 1))


def maf_filter(df: DataFrame, min_maf: float, af: str = "af") -> DataFrame:
    return df.where(F.least(F.col(af), 1 - F.col(af)) >= min_maf)


def min_ac(df: DataFrame, ac: int, strict: bool = True, col: str = "ac") -> DataFrame:
    """Allele count above ``ac`` (or at least it)."""
    return df.where(F.col(col) > ac if strict else F.col(col) >= ac)


def rename_chroms(df: DataFrame, mapping: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Names replaced by the ``old, new`` table (one row a chromosome); unknown names stay."""
    names = F.broadcast(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")))
    return df.join(names, F.col(chrom) == F.col("_old"), "left").withColumn(chrom, F.coalesce("_new", chrom)).drop("_old", "_new")


def set_ids(df: DataFrame, parts: Sequence[str], only_missing: bool = False, name: str = "id") -> DataFrame:
    made = site_id(*[F.col(p) for p in parts])
    missing = F.col(name).isNull() | (F.col(name) == ".") if only_missing else F.lit(True)
    return df.withColumn(name, F.when(missing, made).otherwise(F.col(name)) if only_missing else made)


def keep_chroms(df: DataFrame, names: Sequence[str] | None = None, chrom: str = "chrom") -> DataFrame:
    """Listed chromosomes, or the autosomes."""
    return df.where(F.col(chrom).isin(*names) if names else F.col(chrom).rlike("^(chr)?[0-9]+$"))


def exclude_region(df: DataFrame, chrom: str, start: int, end: int, kind: str = "point", pos: str = "pos") -> DataFrame:
    """Drop rows in a region: points with start <= pos <= end, or intervals that overlap [start, end)."""
    inside = F.col(pos).between(start, end) if kind == "point" else (F.col("start") < end) & (F.col("end") > start)
    return df.where(~F.coalesce((F.col("chrom") == chrom) & inside, F.lit(False)))


def resolved_duplications(df: DataFrame, pair: str, order: Sequence[str]) -> DataFrame:
    """Both ends of the duplications of one assembly pair, distinct, without ``chr``, in the listed chromosome order."""
    own = df.where(F.col("assemblies") == pair)
    ends = [own.select(F.regexp_replace(f"chrom_{i}", "^chr", "").alias("chrom"), F.col(f"start_{i}").alias("start"), F.col(f"end_{i}").alias("end")) for i in (1, 2)]
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("chrom"))
    return ends[0].unionByName(ends[1]).distinct().where(rank > 0).withColumn("_r", rank).orderBy("_r", "start", "end").drop("_r")


def length_band(df: DataFrame, low: int, high: int) -> DataFrame:
    """Intervals strictly longer than ``low`` and shorter than ``high``."""
    size = F.col("end") - F.col("start")
    return df.where((size > low) & (size < high))


def passes(col: str, threshold: float, inclusive: bool) -> Column:
    return F.col(col) >= threshold if inclusive else F.col(col) > threshold


def classify_samples(df: DataFrame, prefixes: Mapping[str, Sequence[str]], other: str, sample: str = "sample") -> DataFrame:
    """Add ``species`` by the prefix of the sample's name."""
    out = F.lit(other)
    for name, starts in prefixes.items():
        out = F.when(reduce(lambda a, b: a | b, [F.startswith(F.col(sample), F.lit(s)) for s in starts]), name).otherwise(out)
    return df.withColumn("species", out)


def sample_sets(panel: DataFrame, level: str = "super_pop") -> DataFrame:
    """(set, sample) of each population or super-population, and of all samples."""
    own = panel.select(F.col(level).alias("set"), "sample")
    return own.unionByName(panel.select(F.lit("ALL").alias("set"), "sample"))


def label_by_pc_sign(df: DataFrame, labels: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """Cluster by component signs: PC1 > 0; PC1 < 0 and PC2 < 0; PC1 < 0 and PC2 > 0; else null."""
    one, two = F.col("pc1"), F.col("pc2")
    return df.withColumn("label", F.when(one > 0, labels[0]).when((one < 0) & (two < 0), labels[1]).when((one < 0) & (two > 0), labels[2]))


# -- joins ---------------------------------------------------------------------------------------------------------
KEY = ("chrom", "pos", "ref", "alt")


def intersect_sites(a: DataFrame, b: DataFrame, on: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Each side's records that are in both."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi"), b.join(a.select(*on).distinct(), list(on), "left_semi")


def annotate_sites(df: DataFrame, ann: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join by position or full key; unmatched stay null. The planner broadcasts ``ann`` if its size allows."""
    return df.join(ann.select(*keys, *cols), list(keys), "left")


def keep_sites(df: DataFrame, sites: DataFrame, keys: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    return df.join(sites.select(*keys), list(keys), "left_semi")


def drop_sites(df: DataFrame, sites: DataFrame, keys: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    return df.join(sites.select(*keys), list(keys), "left_anti")


def keep_samples(gt: DataFrame, ids: Sequence[str], genotypes: str | None = None) -> DataFrame:
    """Listed samples of a long genotype table, or of its array column; unknown names are ignored."""
    if genotypes:
        return gt.withColumn(genotypes, F.filter(genotypes, lambda g: g["sample"].isin(*ids)))
    return gt.where(F.col("sample").isin(*ids))


def merge_cohorts(a: DataFrame, b: DataFrame, samples_a: Sequence[str], samples_b: Sequence[str], fill: str = "reference") -> DataFrame:
    """Full outer merge of two genotype tables (chrom, pos, ref, alts, genotypes array of sample, a0, a1) per site.

    Alleles are united, genotypes of ``b`` renumbered to the united list, and calls of an absent cohort filled as homozygous
    reference (``reference``) or left missing."""
    left = a.select("chrom", "pos", "ref", F.col("alts").alias("alts_a"), F.col("genotypes").alias("g_a"))
    right = b.select("chrom", "pos", "ref", F.col("alts").alias("alts_b"), F.col("genotypes").alias("g_b"))
    both = left.join(right, ["chrom", "pos", "ref"], "full")
    none = F.array().cast("array<string>")
    joined = both.withColumn("alts", F.array_union(F.coalesce("alts_a", none), F.coalesce("alts_b", none)))
    old = lambda alts, i: F.when(i == 0, 0).otherwise(F.array_position(F.col("alts"), F.get(alts, i - 1)).cast("int"))
    default = 0 if fill == "reference" else None

    def calls(col: str, alts: str, names: Sequence[str]) -> Column:
        blank = F.array(*[F.struct(F.lit(n).alias("sample"), F.lit(default).cast("int").alias("a0"), F.lit(default).cast("int").alias("a1")) for n in names])
        return F.coalesce(F.transform(col, lambda g: F.struct(g["sample"].alias("sample"), old(F.col(alts), g["a0"]).alias("a0"), old(F.col(alts), g["a1"]).alias("a1"))), blank)

    return joined.select("chrom", "pos", "ref", "alts", F.concat(calls("g_a", "alts_a", samples_a), calls("g_b", "alts_b", samples_b)).alias("genotypes"))


def transfer_annotations(dst: DataFrame, src: DataFrame, exclude: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Columns of ``src`` but the excluded ones replace or extend those of ``dst``."""
    moved = [c for c in src.columns if c not in exclude and c not in keys]
    out = dst.drop(*moved).join(src.select(*keys, *moved), list(keys), "left")
    return out.select(*dst.columns, *[c for c in moved if c not in dst.columns])


def attach_annotation(candidates: DataFrame, ann: DataFrame, keys: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """Every candidate, with annotation where there is some."""
    return ann.join(candidates, list(keys), "right")


def join_replicates(dfs: Sequence[DataFrame], keys: Sequence[str], value: str, how: str = "inner") -> DataFrame:
    """Values of k replicates side by side (``v1`` ...), keys in all or in any, with their null-skipping mean."""
    stacked = reduce(DataFrame.unionByName, [d.select(*keys, F.lit(i).alias("_rep"), F.col(value).alias("_v")) for i, d in enumerate(dfs, 1)])
    cols = [F.max(F.when(F.col("_rep") == i, F.col("_v"))).alias(f"v{i}") for i in range(1, len(dfs) + 1)]
    out = stacked.groupBy(*keys).agg(*cols, F.avg("_v").alias("mean"), F.countDistinct("_rep").alias("_n"))
    return (out.where(F.col("_n") == len(dfs)) if how == "inner" else out).drop("_n")


def complete_groups(dfs: Sequence[DataFrame], key: str, exclude: DataFrame | None = None) -> DataFrame:
    """Keys present in every replicate, minus excluded ones."""
    stacked = reduce(DataFrame.unionByName, [d.select(key).withColumn("_rep", F.lit(i)) for i, d in enumerate(dfs)])
    out = stacked.groupBy(key).agg(F.countDistinct("_rep").alias("_n")).where(F.col("_n") == len(dfs)).select(key)
    return out if exclude is None else out.join(exclude.select(key), key, "left_anti")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; raises inside the job if a key occurs twice."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    message = F.concat(F.lit("repeated key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def build_master_table(snps: DataFrame, genes: DataFrame, scores: DataFrame, gene_keys: Sequence[str], score_keys: Sequence[str]) -> DataFrame:
    """One row a site: gene evidence (deduplicated) and scores joined by their own keys, each one-to-one."""
    genes = check_unique(genes.distinct(), gene_keys)
    scores = check_unique(scores, score_keys)
    return snps.join(genes, list(gene_keys), "left").join(scores, list(score_keys), "left")


def lookup_subset(subset: DataFrame, scored: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(subset with the superset's columns, one row with the number unmatched)."""
    out = subset.join(scored.select(*keys, *cols, F.lit(True).alias("_found")), list(keys), "left")
    return out.drop("_found"), out.agg(F.count_if(F.col("_found").isNull()).alias("n_unmatched"))


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is listed, listed ids without a row)."""
    return df.join(ids.select(key), key, "left_semi"), ids.select(key).distinct().join(df.select(key), key, "left_anti")


def reorder_by(df: DataFrame, order: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Rows in another table's order; ids it lacks drop out."""
    return df.join(order.select(key, F.col(rank).alias("_rank")), key).orderBy("_rank").drop("_rank")


def set_operations(a: DataFrame, b: DataFrame, key: str) -> dict[str, DataFrame]:
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return {"both": x.intersect(y), "only_a": x.join(y, key, "left_anti"), "only_b": y.join(x, key, "left_anti"), "any": x.union(y).distinct()}
