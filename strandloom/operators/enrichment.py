"""Enrichment against resampled nulls. Replicates are a column, never a driver loop; draws follow a hash of seed and replicate,
so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from strandloom.functions.draws import draw, permuted, text_draw
from strandloom.functions.tails import hypergeom_cdf, hypergeom_sf, kolmogorov_sf, norm_sf, student_sf
from strandloom.operators.bins import bh_adjust, cumulate
from strandloom.operators.carry import numbered
from strandloom.operators.locus_null import check_matching, matched_locus_null, null_locus_sites, sample_null_loci  # noqa: F401  also named here
from strandloom.operators.placements import free_gaps, shuffle_intervals  # noqa: F401  also named here
from strandloom.storage import discard, settled


def _rng(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([seed, *[k & 0xFFFFFFFF for k in key]])


# -- set overlap -----------------------------------------------------------------------------------------------------
def set_overlap(genes: DataFrame, sets: DataFrame, universe: DataFrame, min_k: int = 1) -> DataFrame:
    """For each (library, category): genes hit (k), category size in the universe (set_size), sorted members; with the
    numbers drawn and in the universe."""
    fg = genes.select("gene").distinct().join(universe.select("gene"), "gene", "left_semi").withColumn("_hit", F.lit(1))
    inside = sets.select("library", "category", "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    out = inside.join(fg, "gene", "left").groupBy("library", "category").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("k"), F.count(F.lit(1)).alias("set_size"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_hit") == 1, F.col("gene")))), ";").alias("members"))
    sizes = fg.agg(F.count(F.lit(1)).alias("drawn")).crossJoin(universe.select("gene").distinct().agg(F.count(F.lit(1)).alias("universe")))  # one row
    return out.where(F.col("k") >= min_k).crossJoin(F.broadcast(sizes))


@pandas_udf(DoubleType())
def hypergeom_p(k: pd.Series, N: pd.Series, K: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([hypergeom_sf(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, N, K, n, strict=True)])


def hypergeom_enrichment(df: DataFrame) -> DataFrame:
    """Add ``p`` = P(X >= k) and ``fold`` = (k / drawn) / (set_size / universe). An empty set: p 1 and fold infinite."""
    empty = F.col("set_size") == 0
    fold = F.when(empty, F.lit(float("inf"))).otherwise(F.try_divide(F.col("k") * F.col("universe"), F.col("drawn") * F.col("set_size")))
    p = F.when(empty, F.lit(1.0)).otherwise(hypergeom_p("k", "universe", "set_size", "drawn"))
    return df.withColumn("p", p).withColumn("fold", fold)


def verdict(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """By two adjusted p-values and folds: both, fraction only, count only, none (depleted folds never pass)."""
    a = (F.col("p_frac_adjusted") < alpha) & (F.col("fold_frac") > 1)
    b = (F.col("p_count_adjusted") < alpha) & (F.col("fold_count") > 1)
    return df.withColumn("verdict", F.when(a & b, "both").when(a, "fraction").when(b, "count").otherwise("none"))


# -- null draws -----------------------------------------------------------------------------------------------------
def permutation_enrichment(test: DataFrame, background: DataFrame, sets: DataFrame, n_perm: int, seed: int, keep: Sequence[str] = ("library", "category")) -> DataFrame:
    """Segments (seg, gene) against as many background segments drawn without replacement: distinct genes in each category,
    p = (1 + #null >= observed) / (1 + n_perm).

    The background's segments are numbered in their order. The i-th draw of a replicate is the place of i under a permutation
    that seed and replicate choose, so a draw is one row of a range and no task holds the numbers of a replicate."""
    spark = test.sparkSession
    segments = settled(numbered(background.select("seg").distinct(), ["seg"], label="segments"), "segments")
    total = segments.count()
    size = min(test.select("seg").distinct().count(), total)
    genes = background.select("seg", "gene").distinct().join(segments, "seg").select("number", "gene")
    ids = spark.range(n_perm * size)
    draws = ids.select(F.floor(F.col("id") / size).alias("replicate"), (F.col("id") % size).alias("_i")).withColumn("number", permuted(F.col("_i"), total, seed, F.col("replicate")))
    # a gene's replicates are bits of words, so that its hits are a row a word and not one a replicate; a category adds up its genes' bits
    bit = F.expr("shiftleft(1L, int(replicate % 64))")
    hits = draws.select("replicate", "number").join(genes, "number").groupBy("gene", F.floor(F.col("replicate") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    sums = hits.join(sets.select(*keep, "gene").distinct(), "gene").groupBy(*keep, "_word").agg(*[F.sum(F.shiftrightunsigned("_bits", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"_{i}") for i in range(64)])
    null = sums.select(*keep, "_word", F.posexplode(F.array(*[f"_{i}" for i in range(64)])).alias("_at", "null_k")).where("null_k > 0").select(*keep, (F.col("_word") * 64 + F.col("_at")).alias("replicate"), "null_k")
    observed = test.select("gene").distinct().join(sets.select(*keep, "gene").distinct(), "gene").groupBy(*keep).agg(F.count(F.lit(1)).alias("k"))
    joined = observed.join(null, list(keep), "left").groupBy(*keep, "k").agg(F.count_if(F.col("null_k") >= F.col("k")).alias("ge"), F.coalesce(F.sum("null_k"), F.lit(0)).alias("s"))
    return joined.select(*keep, "k", (F.col("s") / n_perm).alias("null_mean"), ((F.col("ge") + 1) / (n_perm + 1)).alias("p"))


def subsample_null(spark, pool_size: int, pool_hits: int, n: int, observed: int, n_perm: int, seed: int) -> DataFrame:
    """Overlap count of ``n`` sites drawn without replacement from a pool of which ``pool_hits`` overlap: the count has the
    hypergeometric law, so a replicate is the law's quantile at one even draw. Mean, deviation (ddof 0), fold and
    p = (1 + #>=) / (1 + n_perm)."""

    def quantile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, upto = hypergeom_cdf(pool_size, pool_hits, n)
        for pdf in frames:
            yield pd.DataFrame({"null": low + np.minimum(np.searchsorted(upto, pdf["u"].to_numpy() / (1 << 40), "right"), len(upto) - 1)})

    null = spark.range(n_perm).select(draw(1 << 40, seed, F.col("id")).alias("u")).mapInPandas(quantile, "null long")
    out = null.agg(F.avg("null").alias("mean"), F.stddev_pop("null").alias("sd"), F.count_if(F.col("null") >= observed).alias("ge"))
    return out.select(F.lit(observed).alias("observed"), "mean", "sd", F.try_divide(F.lit(float(observed)), F.col("mean")).alias("fold"), ((F.col("ge") + 1) / (n_perm + 1)).alias("p"))


def random_draw_null(spark, universe: int, in_set: int, n: int, observed: int, n_draws: int, seed: int) -> DataFrame:
    """Share of random gene draws that hold at least ``observed`` set members (plain mean, no smoothing)."""
    out = subsample_null(spark, universe, in_set, n, observed, n_draws, seed)
    return out.withColumn("p", F.round((F.col("p") * (n_draws + 1) - 1) / n_draws, 12))


def matched_enrichment(fg: DataFrame, nulls: DataFrame, sets: DataFrame, min_k: int = 1) -> DataFrame:
    """Foreground genes against null gene sets (replicate, gene): per category the count and the fraction of genes in it, each
    with the mean over replicates (absent ones count 0), fold and p = (1 + #>=) / (1 + replicates)."""
    own = fg.select("gene").distinct()
    n = own.agg(F.count(F.lit(1)).alias("n"))
    genes = nulls.select("replicate", "gene").distinct()
    sizes = genes.groupBy("replicate").agg(F.count(F.lit(1)).alias("size"))
    reps = sizes.agg(F.count(F.lit(1)).alias("reps"))
    member = sets.select("library", "category", "gene").distinct()
    observed = own.join(member, "gene").groupBy("library", "category").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("genes")).where(F.col("k") >= min_k).crossJoin(F.broadcast(n))
    null = genes.join(member, "gene").groupBy("library", "category", "replicate").agg(F.count(F.lit(1)).alias("nk")).join(sizes, "replicate")
    joined = observed.join(null, ["library", "category"], "left").withColumn("nf", F.col("nk") / F.col("size")).withColumn("f", F.col("k") / F.col("n"))
    sums = joined.groupBy("library", "category", "k", "n", "f", "genes").agg(F.coalesce(F.sum("nk"), F.lit(0)).alias("sk"), F.coalesce(F.sum("nf"), F.lit(0.0)).alias("sf"), F.count_if(F.col("nk") >= F.col("k")).alias("gk"), F.count_if(F.col("nf") >= F.col("f")).alias("gf")).crossJoin(F.broadcast(reps))
    return sums.select(
        "library", "category", "k", "genes", (F.col("sk") / F.col("reps")).alias("null_count"), (F.col("sf") / F.col("reps")).alias("null_frac"),
        F.try_divide(F.col("k") * F.col("reps"), F.col("sk")).alias("fold_count"), F.try_divide(F.col("f") * F.col("reps"), F.col("sf")).alias("fold_frac"),
        ((F.col("gk") + 1) / (F.col("reps") + 1)).alias("p_count"), ((F.col("gf") + 1) / (F.col("reps") + 1)).alias("p_frac"),
    )


def shuffle_null(observed: float, fractions: DataFrame) -> DataFrame:
    """p = mean(null >= observed) over replicates (replicate, fraction)."""
    return fractions.agg(F.avg((F.col("fraction") >= observed).cast("double")).alias("p"), F.avg("fraction").alias("null_mean"), F.count(F.lit(1)).alias("n"))


def bootstrap_ratio(num: DataFrame, den: DataFrame, replicates: int, seed: int, method: str = "segment") -> DataFrame:
    """2.5 and 97.5 percentiles of sum(num) / sum(den) for each bin.

    ``segment``: rows (bin, value) of both tables are resampled independently, as multinomial counts over the histogram of
    distinct values; ``chromosome``: chromosomes (bin, chrom, value) are resampled, the same for both."""
    if method == "chromosome":
        a = num.groupBy("bin", "chrom").agg(F.sum("value").alias("v"))
        b = den.groupBy("bin", "chrom").agg(F.sum("value").alias("w"))
        table = b.join(a, ["bin", "chrom"], "full").na.fill(0, ["v", "w"])
        chroms = sorted(r["chrom"] for r in table.select("chrom").distinct().collect())  # one row a chromosome

        def resample(pdf: pd.DataFrame) -> pd.DataFrame:
            at = pdf["chrom"].map({c: i for i, c in enumerate(chroms)}).to_numpy()
            counts = np.array([_rng(seed, r).multinomial(len(chroms), [1 / len(chroms)] * len(chroms)) for r in range(replicates)])
            top, low = counts[:, at] @ pdf["v"].to_numpy(float), counts[:, at] @ pdf["w"].to_numpy(float)
            q = np.nanpercentile(np.where(low > 0, top / np.where(low > 0, low, 1), np.nan), [2.5, 97.5])
            return pd.DataFrame({"bin": pdf["bin"].iloc[:1], "low": q[:1], "high": q[1:]})

        return table.groupBy("bin").applyInPandas(resample, "bin int, low double, high double")
    sums = bootstrap_sums(num.select("bin", "value", F.lit(0).alias("t")).unionByName(den.select("bin", "value", F.lit(1).alias("t"))), replicates, seed)
    both = sums.groupBy("bin", "replicate").agg(F.coalesce(F.sum(F.when(F.col("t") == 0, F.col("total"))), F.lit(0.0)).alias("top"), F.sum(F.when(F.col("t") == 1, F.col("total"))).alias("low"))
    ratio = both.where("low > 0").groupBy("bin").agg(F.percentile(F.col("top") / F.col("low"), [0.025, 0.975]).alias("q"))
    return den.select("bin").distinct().join(ratio, "bin", "left").select(F.col("bin").cast("int"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_sums(rows: DataFrame, replicates: int, seed: int, slice_size: int = 1 << 14) -> DataFrame:
    """(bin, t, replicate, total): the sum of as many values (bin, t, value) as the bin has, drawn with replacement.

    A bin's histogram of distinct values is cut into slices of about ``slice_size`` by a hash. How many draws fall to each slice is
    drawn first, over one row a slice; each slice then deals its own draws over its values, so that the numbers of a replicate add
    up to the bin's exactly, whatever the slices. Sums travel as one array a slice and are added by replicate."""
    hist = settled(rows.where("value is not null").groupBy("bin", "t", "value").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = hist.groupBy("bin", "t").agg(F.ceil(F.count(F.lit(1)) / slice_size).alias("_slices"))
    sliced = hist.join(F.broadcast(sizes), ["bin", "t"]).withColumn("slice", F.pmod(F.xxhash64("value"), "_slices")).drop("_slices")  # one row a bin
    totals = sliced.groupBy("bin", "t", "slice").agg(F.sum("n").alias("n"))
    kind = hist.schema["bin"].dataType.simpleString()

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        n = pdf["n"].to_numpy()
        key = (int(pdf["bin"].iloc[0]), int(pdf["t"].iloc[0]))
        counts = np.array([_rng(seed, r, *key).multinomial(int(n.sum()), n / n.sum()) for r in range(replicates)])
        return pdf[["bin", "t", "slice"]].assign(counts=list(counts.T))

    def draw_values(pdf: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        n, v = pdf["n"].to_numpy(), pdf["value"].to_numpy(float)
        key = tuple(int(pdf[c].iloc[0]) for c in ("bin", "t", "slice"))
        sums = [float(_rng(seed, r, *key).multinomial(int(c), n / n.sum()) @ v) for r, c in enumerate(dealt["counts"].iloc[0])]
        return pdf[["bin", "t"]].iloc[:1].assign(sums=[sums])

    dealt = totals.groupBy("bin", "t").applyInPandas(deal, f"bin {kind}, t int, slice long, counts array<long>")  # one row a slice
    keys = ["bin", "t", "slice"]
    sums = sliced.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(draw_values, f"bin {kind}, t int, sums array<double>")
    return sums.select("bin", "t", F.posexplode("sums").alias("replicate", "s")).groupBy("bin", "t", "replicate").agg(F.sum("s").alias("total"))


def tiebreak_enrichment(loci: DataFrame, sets: DataFrame, universe: DataFrame, resolutions: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One random candidate gene for each locus (locus, genes array) in every resolution; enrichment of each; per category the
    medians, the share of resolutions tested and passing after adjustment, and robust = both at least 0.95."""
    picks = loci.withColumn("resolution", F.explode(F.sequence(F.lit(0), F.lit(resolutions - 1)))).where(F.size("genes") > 0)
    picked = picks.select("resolution", F.element_at("genes", (text_draw(F.size("genes"), seed, F.col("resolution"), F.col("locus")) + 1).cast("int")).alias("gene")).distinct()
    inside = sets.select("library", "category", "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    sizes = inside.groupBy("library", "category").agg(F.count(F.lit(1)).alias("set_size"))
    n = picked.join(universe.select("gene").distinct(), "gene", "left_semi").groupBy("resolution").agg(F.count(F.lit(1)).alias("drawn"))
    k = picked.join(inside, "gene").groupBy("resolution", "library", "category").agg(F.count(F.lit(1)).alias("k"))
    total = universe.select("gene").distinct().agg(F.count(F.lit(1)).alias("universe"))
    tested = hypergeom_enrichment(k.join(n, "resolution").join(sizes, ["library", "category"]).crossJoin(F.broadcast(total)))
    adjusted = bh_adjust(tested, "p", ["resolution", "library"])
    out = adjusted.groupBy("library", "category").agg(
        F.percentile("fold", 0.5).alias("median_fold"), F.percentile("p", 0.5).alias("median_p"), (F.count(F.lit(1)) / resolutions).alias("tested"), (F.count_if(F.col("p_adjusted") < alpha) / resolutions).alias("passing")
    )
    return out.withColumn("robust", (F.col("tested") >= 0.95) & (F.col("passing") >= 0.95))


def driver_genes(picks: DataFrame, resolutions: int, share: float = 0.5) -> DataFrame:
    """Genes chosen in at least ``share`` of the resolutions (category, resolution, gene), with the percentage."""
    n = picks.distinct().groupBy("category", "gene").agg((F.count(F.lit(1)) / resolutions).alias("s")).where(F.col("s") >= share)
    return n.select("category", "gene", F.format_string("%s(%d%%)", "gene", F.bround(100 * F.col("s")).cast("int")).alias("label"))


# -- redundancy ------------------------------------------------------------------------------------------------------
def cluster_categories(sets: DataFrame, how: str = "jaccard", threshold: float = 0.5) -> DataFrame:
    """Single-linkage clusters of categories (category, gene) by Jaccard, overlap coefficient or either (``combined``)."""
    rows = sets.select("category", "gene").distinct()
    size = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.alias("a").join(rows.select(F.col("category").alias("other"), "gene"), "gene").where("category < other").groupBy("category", "other").agg(F.count(F.lit(1)).alias("both"))
    pairs = pairs.join(size, "category").join(size.select(F.col("category").alias("other"), F.col("n").alias("m")), "other")
    jaccard, overlap = F.col("both") / (F.col("n") + F.col("m") - F.col("both")), F.col("both") / F.least("n", "m")
    near = {"jaccard": jaccard >= threshold, "overlap": overlap >= threshold, "combined": (jaccard >= threshold) | (overlap >= threshold)}[how]
    edges = pairs.where(near).select("category", "other")
    label = min_label(size.select("category"), edges)
    return label.withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("cluster")))


def min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(category, cluster): the least name reachable over the edges. Every round hands the least label of the neighbours to a node
    and to the node that its label names, then follows labels one step, so a chain's labels move by doubling; rounds are written
    to shared storage and go on until no label moves."""
    both = settled(edges.unionByName(edges.select(F.col("other").alias("category"), F.col("category").alias("other"))).distinct(), "edges")
    label = settled(nodes.select("category", F.col("category").alias("cluster")), "labels")
    while True:
        least = both.join(label.select(F.col("category").alias("other"), "cluster"), "other").groupBy("category").agg(F.min("cluster").alias("m"))
        roots = label.join(least, "category").select(F.col("cluster").alias("category"), "m")
        step = least.unionByName(roots).groupBy("category").agg(F.min("m").alias("m"))
        hooked = settled(label.join(step, "category", "left").select("category", F.least("cluster", "m").alias("cluster"), F.col("cluster").alias("was")), "labels")
        if not hooked.where("cluster < was").take(1):
            return hooked.select("category", "cluster")
        ahead = hooked.select(F.col("category").alias("cluster"), F.col("cluster").alias("next"))
        label = settled(hooked.select("category", "cluster").join(ahead, "cluster").select("category", F.col("next").alias("cluster")), "labels")


def cluster_table(clusters: DataFrame, results: DataFrame, sets: DataFrame) -> DataFrame:
    """Per cluster: its categories, best adjusted p, range of folds, the union of genes and categories with equal gene sets."""
    genes = sets.groupBy("category").agg(F.array_sort(F.collect_set("gene")).alias("g"))
    joined = clusters.join(results.select("category", "p_adjusted", "fold"), "category", "left").join(genes, "category", "left")
    return joined.groupBy("cluster").agg(
        F.array_join(F.array_sort(F.collect_set("category")), "; ").alias("categories"), F.min_by("category", F.struct("p_adjusted", "category")).alias("best"), F.min("p_adjusted").alias("p_adjusted"),
        F.min("fold").alias("fold_low"), F.max("fold").alias("fold_high"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))), ";").alias("genes"), (F.count("g") - F.countDistinct("g")).alias("duplicates"),
    )


def cover_rounds(sets: DataFrame) -> DataFrame:
    """(category, n, round): the categories that a greedy cover of all genes takes, each with the genes it adds.

    Each step takes the category with most genes not yet covered, ties by name. A category that beats every other one that shares
    a gene left with it is taken whatever happens elsewhere, so a round takes all of those at once: a gene names the best of its
    categories, and whoever is named by all its genes is taken. What a round covers leaves the table; only the rest is read again.
    Greedy steps are in order of falling n and, of equals, rising name."""
    left, taken, number = settled(sets.select("category", "gene").where("category is not null and gene is not null").distinct(), "cover"), None, 0
    while left.take(1):
        counts = left.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        sized = left.join(counts, "category")
        best = sized.groupBy("gene").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("b")).select("gene", F.col("b.category").alias("category"))
        named = best.groupBy("category").agg(F.count(F.lit(1)).alias("named"))
        picked = settled(counts.join(named, "category").where("n = named").select("category", "n", F.lit(number).alias("round")), "taken")
        covered = left.join(picked.select("category"), "category", "left_semi").select("gene")
        rest = settled(left.join(covered, "gene", "left_anti").select("category", "gene"), "cover")
        discard(left)
        left, number = rest, number + 1
        taken = picked if taken is None else taken.unionByName(picked)
    return taken if taken is not None else left.select("category", F.lit(0).cast("long").alias("n"), F.lit(0).alias("round"))


def greedy_cover(sets: DataFrame, limit: int | None = None) -> list[tuple[str, int]]:
    """The categories of :func:`cover_rounds` in greedy order. With a ``limit`` it raises if that many leave genes uncovered."""
    out = [(r["category"], r["n"]) for r in cover_rounds(sets).orderBy(F.desc("n"), "category").select("category", "n").collect()]
    if limit is not None and len(out) > limit:
        raise RuntimeError(f"{limit} categories leave genes uncovered")
    return out


# -- rank tests ------------------------------------------------------------------------------------------------------
def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Two-sided test with tie correction (normal approximation): U, z, p, P(a > b) + ties/2, Cliff's delta."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    is_a = F.col(group) == a
    counts = rows.groupBy(value).agg(F.count_if(is_a).alias("x"), F.count_if(~is_a).alias("y"))
    t = F.col("x") + F.col("y")
    run = cumulate(counts, value, {"_upto": t})  # a row a distinct value; ranks never go back to the rows
    wide = t.cast("double")
    rank = F.col("_upto") - (t - 1) / 2
    sums = run.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum(F.col("x") * rank).alias("r1"), F.sum(wide * wide * wide - wide).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2) / sd
    corrected = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    return sums.select("n1", "n2", u.alias("u"), z.alias("z"), two_sided(corrected).alias("p"), (u / (n1 * n2)).alias("p_greater"), (2 * u / (n1 * n2) - 1).alias("cliff_delta"))


@pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or np.isnan(x) else min(1.0, 2 * norm_sf(abs(x))))


def ks_2samp(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Largest difference of the two cumulative distributions, and its asymptotic p-value."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    counts = rows.groupBy(value).agg(F.count_if(F.col(group) == a).alias("x"), F.count_if(F.col(group) == b).alias("y"))
    run = cumulate(counts, value, {"cx": F.col("x"), "cy": F.col("y")}).crossJoin(F.broadcast(counts.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"))))
    out = run.agg(F.max(F.abs(F.col("cx") / F.col("n1") - F.col("cy") / F.col("n2"))).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return out.withColumn("p", ks_p("d", "n1", "n2"))


@pandas_udf(DoubleType())
def ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or np.isnan(x) else kolmogorov_sf(float(x) * (a * b / (a + b)) ** 0.5) for x, a, b in zip(d, n1, n2, strict=True)], dtype=float)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, and its two-sided p-value (t approximation)."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    ranked = pairs
    for column, name in ((x, "rx"), (y, "ry")):  # ranks by distinct value, weighted by the rows that a pair of values has
        counts = pairs.groupBy(column).agg(F.sum("_w").alias("_n"))
        ranks = cumulate(counts, column, {"_upto": F.col("_n")}).select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
        ranked = ranked.join(ranks, column)
    w, rx, ry = F.col("_w").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.agg(F.sum("_w").alias("n"), F.sum(w * rx).alias("a"), F.sum(w * ry).alias("b"), F.sum(w * rx * ry).alias("ab"), F.sum(w * rx * rx).alias("aa"), F.sum(w * ry * ry).alias("bb"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * F.col("aa") - F.col("a") * F.col("a")) * F.sqrt(n * F.col("bb") - F.col("b") * F.col("b"))
    out = sums.select(F.try_divide(n * F.col("ab") - F.col("a") * F.col("b"), spread).alias("rho"), "n")
    return out.withColumn("p", t_two_sided("rho", "n"))


@pandas_udf(DoubleType())
def t_two_sided(rho: pd.Series, n: pd.Series) -> pd.Series:
    def p(r: float, m: int) -> float | None:
        if r is None or np.isnan(r) or m < 3:
            return None
        return 0.0 if abs(r) >= 1 else min(1.0, 2 * student_sf(abs(r) * ((m - 2) / (1 - r * r)) ** 0.5, m - 2))

    return pd.Series([p(r, m) for r, m in zip(rho, n, strict=True)], dtype=float)


def summary_table(first: DataFrame, second: DataFrame, keys: Sequence[str], condition: str) -> DataFrame:
    """Two tests' results side by side, each adjusted inside its condition."""
    a = bh_adjust(first, "p", [condition], "p_adjusted_1").withColumnsRenamed({"p": "p_1", "fold": "fold_1"})
    b = bh_adjust(second, "p", [condition], "p_adjusted_2").withColumnsRenamed({"p": "p_2", "fold": "fold_2"})
    return a.join(b.select(*keys, condition, "p_2", "fold_2", "p_adjusted_2"), [*keys, condition], "left")
