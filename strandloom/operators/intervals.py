"""Range joins of half-open intervals: binned equi-joins that Catalyst plans like any other join.

Both sides are exploded to the bins of ``width`` they touch and joined on (chrom, bin); a pair is kept in its first common
bin only, so no distinct is needed. A long interval touches many bins; pick ``width`` near the long end of the usual length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Default bin width in positions.
WIDTH = 16_384


def binned(df: DataFrame, start: str = "start", end: str = "end", width: int = WIDTH, name: str = "bin") -> DataFrame:
    """One row for each bin an interval touches; empty or reversed intervals keep the bin of their start."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))))


def _pairs(a: DataFrame, b: DataFrame, width: int, closed: bool = False) -> DataFrame:
    """All overlapping pairs; columns of ``a`` as they are, of ``b`` with the prefix ``b_`` (chrom once)."""
    right = b.select("chrom", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "chrom"])
    shift = 1 if closed else 0
    left = binned(a.withColumn("_e", F.col("end") + shift), "start", "_e", width, "_bin")
    right = binned(right.withColumn("_be", F.col("b_end") + shift), "b_start", "_be", width, "_bin")
    first = F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("b_start") / width))
    meets = (F.col("start") < F.col("_be")) & (F.col("b_start") < F.col("_e"))
    return left.join(right, ["chrom", "_bin"]).where(first & meets).drop("_bin", "_e", "_be")


def overlap_join(a: DataFrame, b: DataFrame, how: str = "pairs", min_frac: float | None = None, reciprocal: bool = False, width: int = WIDTH) -> DataFrame:
    """Overlaps of ``a`` and ``b``.

    ``pairs``: both sides' columns and ``overlap`` (length); ``intersection``: the shared stretch with a's other columns;
    ``left``: every row of ``a``, with zero-filled coordinates and overlap 0 where nothing meets. ``min_frac``: least share of
    a's length (and of b's, if ``reciprocal``) that the overlap covers.
    """
    if how == "left":
        return left_overlap(a, b, min_frac, reciprocal, width)
    pairs = _pairs(a, b, width).withColumn("overlap", F.least("end", "b_end") - F.greatest("start", "b_start"))
    if min_frac is not None:
        pairs = pairs.where(F.col("overlap") >= F.lit(min_frac) * (F.col("end") - F.col("start")))
        if reciprocal:
            pairs = pairs.where(F.col("overlap") >= F.lit(min_frac) * (F.col("b_end") - F.col("b_start")))
    if how == "intersection":
        rest = [c for c in a.columns if c not in ("chrom", "start", "end")]
        return pairs.select("chrom", F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"), *rest)
    return pairs


def left_overlap(a: DataFrame, b: DataFrame, min_frac: float | None = None, reciprocal: bool = False, width: int = WIDTH) -> DataFrame:
    """Every row of ``a`` with its overlaps; rows without one once, b's coordinates and the overlap zero.

    Equal rows of ``a`` are told apart by their whole content, counted, so no generated row number has to survive a retry."""
    names = list(a.columns)
    counted = a.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    pairs = overlap_join(counted, b, "pairs", min_frac, reciprocal, width)
    others = [f"b_{c}" for c in b.columns if c != "chrom"]
    keyed = pairs.select(*[F.col(c).alias(f"_k_{c}") for c in names], *others, "overlap")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    out = counted.join(keyed, condition, "left").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in ("b_start", "b_end") else F.col(c) for c in others]
    return out.select(*names, *zero, F.coalesce("overlap", F.lit(0)).alias("overlap"))


def _overlapping_keys(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    spans = a.select("chrom", "start", "end").distinct()
    return _pairs(spans, b.select("chrom", "start", "end"), width).select("chrom", "start", "end").distinct()


def overlap_semi(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``a`` that overlap any of ``b``, each once for each of its own copies."""
    return a.join(_overlapping_keys(a, b, width), ["chrom", "start", "end"], "left_semi")


def overlap_anti(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``a`` that overlap none of ``b``."""
    return a.join(_overlapping_keys(a, b, width), ["chrom", "start", "end"], "left_anti")


def count_overlapping(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row: ``n`` rows of ``a`` and ``n_overlapping`` of them that overlap ``b``."""
    total = a.agg(F.count(F.lit(1)).alias("n"))
    return total.crossJoin(overlap_semi(a, b, width).agg(F.count(F.lit(1)).alias("n_overlapping")))  # two single rows


def as_intervals(sites: DataFrame, pos: str = "pos") -> DataFrame:
    """1-based points as half-open intervals of length one."""
    return sites.withColumn("start", F.col(pos) - 1).withColumn("end", F.col(pos))


def sites_in(sites: DataFrame, intervals: DataFrame, inside: bool = True, width: int = WIDTH) -> DataFrame:
    """Sites whose base lies in (or, with ``inside=False``, outside) the half-open intervals."""
    return (overlap_semi if inside else overlap_anti)(as_intervals(sites), intervals, width).drop("start", "end")


def annotate_from_intervals(sites: DataFrame, intervals: DataFrame, cols: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Add ``cols`` of the intervals that hold a site (of several, the one that starts first); null where none does."""
    pairs = _pairs(as_intervals(sites.select("chrom", "pos").distinct()), intervals.select("chrom", "start", "end", *cols), width)
    best = pairs.groupBy("chrom", "pos").agg(F.min_by(F.struct(*[F.col(f"b_{c}").alias(c) for c in cols]), F.struct("b_start", "b_end", *[f"b_{c}" for c in cols])).alias("_hit"))
    return sites.join(best, ["chrom", "pos"], "left").select(*sites.columns, *[F.col("_hit")[c].alias(c) for c in cols])


def snap_lookup(df: DataFrame, grid: DataFrame, width: int = 1000, value: str = "value") -> DataFrame:
    """Value of the grid window at ``width * round(start / width)``, halves to even; null where the grid has none."""
    cells = grid.select("chrom", F.col("start").alias("_cell"), value)
    return df.withColumn("_cell", (F.bround(F.col("start") / width) * width).cast("long")).join(cells, ["chrom", "_cell"], "left").drop("_cell")


def assign_region(points: DataFrame, regions: DataFrame, order: str = "start", pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Add ``region`` of the first (by ``order``) closed region with start <= pos <= end; null if none."""
    spans = points.select("chrom", F.col(pos).alias("_p")).distinct().withColumn("start", F.col("_p")).withColumn("end", F.col("_p"))
    pairs = _pairs(spans, regions.select("chrom", "start", "end", "region", F.col(order).alias("_o")), width, closed=True)
    best = pairs.groupBy("chrom", "_p").agg(F.min_by("b_region", F.struct("b__o", "b_region")).alias("region"))
    return points.join(best.withColumnRenamed("_p", pos), ["chrom", pos], "left")


def tag_overlaps(regions: DataFrame, sets: DataFrame, label: str = "set", name: str = "name", width: int = WIDTH) -> DataFrame:
    """For closed regions: the labels and names of the closed intervals they touch, each sorted and joined by ``; ``."""
    pairs = _pairs(regions.select("chrom", "start", "end").distinct(), sets.select("chrom", "start", "end", F.col(label).alias("l"), F.col(name).alias("n")), width, closed=True)
    tags = pairs.groupBy("chrom", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("b_l")), "; ").alias("sets"), F.array_join(F.array_sort(F.collect_set("b_n")), "; ").alias("names"))
    return regions.join(tags, ["chrom", "start", "end"], "left")


def tag_gene_containment(snps: DataFrame, spans: DataFrame, listed: DataFrame, overrides: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Sites inside the span of a listed gene, with the gene and whether it differs from the site's own ``gene``;
    ``overrides`` (chrom, pos, gene) adds curated rows."""
    named = spans.join(listed.select("gene").distinct(), "gene", "left_semi")
    pairs = _pairs(as_intervals(snps), named.select("chrom", "start", "end", "gene"), width)
    out = pairs.select("chrom", "pos", "gene", F.col("b_gene").alias("in_gene"))
    if overrides is not None:
        curated = overrides.select("chrom", "pos", F.col("gene").alias("in_gene")).join(snps.select("chrom", "pos", "gene"), ["chrom", "pos"])
        out = out.unionByName(curated.select("chrom", "pos", "gene", "in_gene"))
    return out.distinct().withColumn("differs", ~F.col("gene").eqNullSafe(F.col("in_gene")))


def clean_gene_spans(transcripts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Gene spans from transcripts (chrom, start, end, gene, canon) without those that trespass on another gene's canonical
    transcript; of a gene that loses all, its canonical ones, else all."""
    canon = transcripts.where("canon").select("chrom", "start", "end", "gene")
    hits = _pairs(transcripts, canon, width).where(F.col("gene") != F.col("b_gene"))
    clean = transcripts.join(hits.select("chrom", "start", "end", "gene").distinct(), ["chrom", "start", "end", "gene"], "left_anti")

    def span(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("chrom", "gene").agg(F.min("start").alias(f"s_{tag}"), F.max("end").alias(f"e_{tag}"))

    out = span(transcripts, "all").join(span(canon, "canon"), ["chrom", "gene"], "left").join(span(clean, "clean"), ["chrom", "gene"], "left")
    pick = lambda p: F.coalesce(f"{p}_clean", f"{p}_canon", f"{p}_all")
    return out.select("chrom", pick("s").alias("start"), pick("e").alias("end"), "gene")


def slop(df: DataFrame, sizes: DataFrame, b: int) -> DataFrame:
    """Intervals widened by ``b`` on both sides, clipped to [0, chromosome length]; ``sizes`` has one row a chromosome."""
    out = df.join(F.broadcast(sizes.select("chrom", F.col("length").alias("_len"))), "chrom")  # one row a chromosome
    return out.withColumn("start", F.greatest(F.lit(0), F.col("start") - b)).withColumn("end", F.least("_len", F.col("end") + b)).drop("_len")


def interval_mean(df: DataFrame, track: DataFrame, value: str = "value", width: int = WIDTH) -> DataFrame:
    """Length-weighted mean of a piecewise track over the covered bases of each interval; 0 where none is covered."""
    keys = df.select("chrom", "start", "end").distinct()
    pairs = overlap_join(keys, track.select("chrom", "start", "end", value), "pairs", width=width)
    mean = pairs.groupBy("chrom", "start", "end").agg((F.sum(F.col(f"b_{value}") * F.col("overlap")) / F.sum("overlap")).alias("mean"))
    return df.join(mean, ["chrom", "start", "end"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def covered_bp(df: DataFrame) -> Column:
    """Aggregate: total length."""
    return F.sum(F.col("end") - F.col("start"))
