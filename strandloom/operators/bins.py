"""Bins, quantiles, ranks, cumulative curves and their summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.storage import settled


# -- windows of posterior probability ------------------------------------------------------------------------------
def inverse_cumulative(posterior: Column, index: int) -> Column:
    """P(T >= boundary ``index``): the sum of the array from that place on."""
    return F.aggregate(F.slice(posterior, index + 1, F.greatest(F.size(posterior) - index, F.lit(0))), F.lit(0.0), lambda s, x: s + x)


def time_grid(n: int, first: float, last: float) -> list[float]:
    """``n`` time boundaries, 0 and then growing by equal factors from ``first`` to ``last``."""
    return [0.0] + [first * (last / first) ** (i / (n - 2)) for i in range(n - 1)]


def boundary_index(grid: Sequence[float], age: float) -> int:
    """The first boundary above ``age``."""
    return next(i for i, t in enumerate(grid) if t > age)


def sum_windows(dfs: Sequence[DataFrame], threshold: float, value: str = "posterior", scale: int | None = None) -> DataFrame:
    """Sum of a value over individuals for each window, kept if above ``threshold`` (strict). With ``scale`` the values
    are summed as scaled integers, which does not depend on the order of addition."""
    union = dfs[0]
    for d in dfs[1:]:
        union = union.unionByName(d)
    if scale:
        total = union.groupBy("chrom", "start", "end").agg((F.sum(F.round(F.col(value) * scale).cast("long"))).alias("_t"))
        return total.where(F.col("_t") > threshold * scale).select("chrom", "start", "end", (F.col("_t") / scale).alias("total"))
    return union.groupBy("chrom", "start", "end").agg(F.sum(value).alias("total")).where(F.col("total") > threshold)


def below_cutoffs(df: DataFrame, col: str, cutoffs: Sequence[float]) -> DataFrame:
    """One copy of each row for every cutoff it lies below (strict), with the ``cutoff``."""
    return df.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))).where(F.col(col) < F.col("cutoff"))


# -- edges and bins --------------------------------------------------------------------------------------------------
def quantile_edges(df: DataFrame, col: str, n: int, frequency: str | None = None) -> DataFrame:
    """One row: ``edges``, n + 1 linearly interpolated quantiles of the values (each counted ``frequency`` times)."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg((F.sum(frequency) if frequency else F.count(F.lit(1))).cast("long").alias("_f"))
    return counted.agg(F.percentile(F.col(col), [i / n for i in range(n + 1)], F.col("_f")).alias("edges"))


def weighted_edges(df: DataFrame, value: str, weight: Column, qs: Sequence[float], drop_null_weight: bool = True) -> DataFrame:
    """One row: ``edges``, for each q the first value whose share of the total weight, cumulated, reaches q. With
    ``drop_null_weight=False`` the weight of null values stays in the total."""
    rows = df.select(F.col(value).alias("v"), weight.alias("w"))
    total = rows.where("v is not null") if drop_null_weight else rows
    by_value = rows.where("v is not null").groupBy("v").agg(F.sum("w").alias("w"))
    cumulated = cumulate(by_value, "v", {"below": F.col("w")}).crossJoin(total.agg(F.sum("w").alias("total")))
    return cumulated.agg(F.array(*[F.min(F.when(F.col("below") >= F.lit(q) * F.col("total"), F.col("v"))) for q in qs]).alias("edges"))


def cumulate(df: DataFrame, order: str, values: dict[str, Column], slices: int = 64) -> DataFrame:
    """Running sums over a global order without one task for all: rows are dealt into ``slices`` ranges of the value by
    approximate quantiles, summed inside each, and the ranges' totals (one row each) are carried forward."""
    edges = df.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 1000).alias("e"))
    ranged = df.crossJoin(F.broadcast(edges)).withColumn("_r", F.aggregate("e", F.lit(0), lambda n, e: n + F.when(F.col(order) > e, 1).otherwise(0))).drop("e")
    for name, column in values.items():
        ranged = ranged.withColumn(f"_v_{name}", column)
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``slices`` rows
    totals = ranged.groupBy("_r").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values])
    carried = totals.select("_r", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in values])
    out = ranged.select("*", *[F.sum(f"_v_{name}").over(w).alias(f"_l_{name}") for name in values]).join(F.broadcast(carried), "_r")
    for name in values:
        out = out.withColumn(name, F.col(f"_l_{name}") + F.col(f"_c_{name}"))
    return out.drop("_r", *[f"_{p}_{name}" for name in values for p in "vlc"])


def assign_bin(value: Column, edges: Column | Sequence[float], closed: str = "left") -> Column:
    """Bin number from 1 among ``edges`` (n + 1 for n bins).

    ``left``: a value on an inner edge goes up (v < edge decides), the last edge belongs to the last bin; ``right``: it goes
    down (v <= edge decides); ``cut``: like right, but null outside the edges, the lowest edge included; ``digitize``: the
    number of edges below the value, no clamping."""
    e = edges if isinstance(edges, Column) else F.array(*[F.lit(float(x)) for x in edges])
    below = F.aggregate(e, F.lit(0), lambda n, x: n + F.when(x < value, 1).otherwise(0))
    at_or_below = F.aggregate(e, F.lit(0), lambda n, x: n + F.when(x <= value, 1).otherwise(0))
    n = F.size(e) - 1
    if closed == "digitize":
        out = below
    elif closed == "cut":
        out = F.when((value >= F.element_at(e, 1)) & (value <= F.element_at(e, -1)), F.greatest(below, F.lit(1)))
    else:
        out = F.least(F.greatest(at_or_below if closed == "left" else below, F.lit(1)), n)
    return F.when(value.isNotNull(), out)


# -- sums over bins -----------------------------------------------------------------------------------------------
def weighted_fraction_by_bin(df: DataFrame, bins: DataFrame, value: str = "value", weight: str = "overlap", by: str = "bin") -> DataFrame:
    """Sum of value * weight over sum of weight for each of ``bins``; bins without rows have zero and null."""
    sums = df.groupBy(by).agg(F.sum(F.col(value) * F.col(weight)).alias("numerator"), F.sum(weight).alias("denominator"))
    out = bins.select(by).distinct().join(sums, by, "left")
    return out.select(by, F.coalesce("numerator", F.lit(0)).alias("numerator"), F.coalesce("denominator", F.lit(0)).alias("denominator"), F.try_divide("numerator", "denominator").alias("fraction"))


def bin_fractions(num: DataFrame, den: DataFrame, length: Column, by: str = "bin") -> DataFrame:
    """Share of summed lengths for each bin, with its binomial standard error over the number of denominator rows."""
    a = num.groupBy(by).agg(F.sum(length).alias("num_len"))
    b = den.groupBy(by).agg(F.sum(length).alias("den_len"), F.count(F.lit(1)).alias("den_n"))
    out = b.join(a, by, "full").select(by, F.coalesce("num_len", F.lit(0)).alias("num_len"), F.coalesce("den_len", F.lit(0)).alias("den_len"), F.coalesce("den_n", F.lit(0)).alias("den_n"))
    frac = F.try_divide("num_len", "den_len")
    return out.withColumn("frac", frac).withColumn("se", F.sqrt(F.try_divide(F.col("frac") * (1 - F.col("frac")), F.col("den_n"))))


def obs_vs_exp(a: DataFrame, b: DataFrame, inter: DataFrame, lengths: DataFrame, by: str = "bin") -> DataFrame:
    """Observed share of the intersection against the product of the two shares; each input has (bin, bp)."""
    total = lambda df, name: df.groupBy(by).agg(F.sum("bp").alias(name))
    out = total(lengths, "len").join(total(a, "a"), by, "left").join(total(b, "b"), by, "left").join(total(inter, "o"), by, "left").na.fill(0)
    out = out.select(by, (F.col("o") / F.col("len")).alias("observed"), ((F.col("a") / F.col("len")) * (F.col("b") / F.col("len"))).alias("expected"))
    return out.withColumn("enrichment", F.try_divide("observed", "expected"))


def category_percentages(df: DataFrame, category: str, order: Sequence[str], merge: dict[str, str] | None = None) -> DataFrame:
    """Counts, percentages and binomial errors of categories, renamed by ``merge``; categories of ``order`` without rows are 0."""
    name = F.col(category)
    if merge:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in merge.items() for x in kv])[name], name)
    counts = df.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    listed = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "category string, rank int")
    out = listed.join(counts, "category", "left").crossJoin(F.broadcast(total)).na.fill(0, ["n"])
    p = F.col("n") / F.col("total")
    return out.select("rank", "category", "n", (100 * p).alias("percent"), (100 * F.sqrt(p * (1 - p) / F.col("total"))).alias("se"))


def points_per_bin(points: DataFrame, bins: DataFrame, name: str = "name", mb: str | None = None) -> DataFrame:
    """Distinct points in each bin's intervals (each point once), and per megabase of the bin's summed length."""
    from strandloom.operators.intervals import overlap_join

    spans = bins.select("chrom", "start", "end", "bin")
    hits = overlap_join(points, spans).select(F.col("b_bin").alias("bin"), name).dropDuplicates([name])
    counts = hits.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    sizes = bins.groupBy("bin").agg(((F.sum(mb) if mb else F.sum(F.col("end") - F.col("start"))) / 1e6).alias("mb"))
    return sizes.join(counts, "bin", "left").na.fill(0, ["n"]).withColumn("per_mb", F.try_divide("n", "mb"))


def classes_hit(sites: DataFrame, features: DataFrame, kind: str = "kind", key: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    """Number of distinct sites that meet each class of features."""
    from strandloom.operators.intervals import overlap_join

    return overlap_join(sites, features).select(*key, F.col(f"b_{kind}").alias(kind)).distinct().groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def genes_by_bin(df: DataFrame, by: str = "bin", gene: str = "gene") -> DataFrame:
    """For each bin its genes with counts, most frequent first, ties by name, as ``gene(n)`` text."""
    counts = df.groupBy(by, gene).agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(gene).alias("g"))))
    return counts.groupBy(by).agg(F.count(F.lit(1)).alias("n_genes"), F.array_join(F.transform(ranked, lambda x: F.format_string("%s(%d)", x["g"], -x["k"])), "; ").alias("genes"))


def mean_above(df: DataFrame, value: str, age: str, mins: Sequence[float]) -> DataFrame:
    """Mean of ``value`` over rows of at least each age, with a 95 % interval over the root of *all* such rows, null values
    included, and the sample deviation."""
    rows = df.withColumn("min_age", F.explode(F.array(*[F.lit(float(m)) for m in mins]))).where(F.col(age) >= F.col("min_age"))
    out = rows.groupBy("min_age").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def normalise_curve(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``share``: y over its value at the least x, for each curve."""
    first = df.groupBy(*by).agg(F.min_by(y, x).alias("_first"))
    joined = df.join(F.broadcast(first), list(by)) if by else df.crossJoin(first)
    return joined.withColumn("share", F.try_divide(F.col(y), F.col("_first"))).drop("_first")


def read_curve(df: DataFrame, x: str, y: str, cutoff: float, by: Sequence[str] = ()) -> DataFrame:
    """The curve's value at the first grid point at or past ``cutoff``."""
    return df.where(F.col(x) >= cutoff).groupBy(*by).agg(F.min(x).alias(x), F.min_by(y, x).alias(y))


def stratify(df: DataFrame, col: str, edges: Sequence[float], value: str, name: str = "stratum") -> DataFrame:
    """n, median and mean of ``value`` in fixed left-closed bins; rows outside the edges drop out."""
    inside = df.where((F.col(col) >= float(edges[0])) & (F.col(col) < float(edges[-1])))
    return inside.withColumn(name, assign_bin(F.col(col), edges)).groupBy(name).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"))


def pivot_median(df: DataFrame, row: str, column: str, value: str, columns: Sequence | None = None) -> DataFrame:
    """Median of ``value`` by two strata, the second across."""
    return df.groupBy(row).pivot(column, list(columns) if columns else None).agg(F.percentile(value, 0.5))


def describe_tracks(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median, quartiles and share above zero of each set."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    out = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q.alias("q"), (100 * F.avg((F.col(value) > 0).cast("int"))).alias("percent_positive"))
    return out.select(by, "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "percent_positive")


def log_bin_summary(df: DataFrame, x: str, y: str, n_bins: int, min_n: int = 10) -> DataFrame:
    """Mean, median and quartiles of y in equal bins of log10 x; the top edge's value is outside, thin bins drop out."""
    rows = df.where((F.col(x) > 0) & F.col(y).isNotNull())
    ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ranged = rows.crossJoin(F.broadcast(ends))
    width = (F.log10("hi") - F.log10("lo")) / n_bins
    number = F.floor(F.try_divide(F.log10(x) - F.log10("lo"), width)).cast("int") + 1
    binned = ranged.withColumn("bin", number).where((F.col("bin") >= 1) & (F.col("bin") <= n_bins))
    q = F.percentile(y, [0.25, 0.5, 0.75])
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("mean"), q.alias("q")).where(F.col("n") >= min_n)
    return out.select("bin", "n", "x_mean", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("mean") / F.col("x_mean")).alias("ratio"))


def mean_depth(df: DataFrame, depth: str = "depth") -> DataFrame:
    return df.agg(F.avg(depth).alias("mean_depth"), F.count(depth).alias("n"))


def status_breakdown(df: DataFrame, status: str, region: str | None = None) -> DataFrame:
    """Counts and percentages by status, with the number of distinct regions."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), *([F.countDistinct(region).alias("n_regions")] if region else []))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("percent", 100 * F.col("n") / F.col("_all")).drop("_all")


def row_min(*columns: Column) -> Column:
    """Least of the columns that are not null."""
    return F.least(*columns)


def cpg_error_rates(df: DataFrame, corrected: str, naive: str) -> DataFrame:
    """Share of CpG calls by the uncorrected rule that ancestral correction removes, and of the others that it adds."""
    rate = lambda top, of: F.try_divide(F.count_if(top), F.count_if(of))
    c, n = F.col(corrected), F.col(naive)
    return df.agg(rate(n & ~c, n).alias("type1"), rate(~n & c, ~n).alias("type2"), (100 * F.avg(c.cast("int"))).alias("percent_cpg"))


def variance_share(df: DataFrame, value: str = "eigenvalue") -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("_all")))).withColumn("percent", 100 * F.col(value) / F.col("_all")).drop("_all")


# -- curves, ranks, adjustment --------------------------------------------------------------------------------------
def survival_curve(df: DataFrame, grid_step: float, grid_max: float, n: int, samples: str = "samples") -> DataFrame:
    """Expected number of sites older than each grid age: the sum over sites and posterior ranges (lower, upper) of
    clip((upper - t) / (upper - lower), 0, 1) / n. A range of no length is a point mass and counts for t below it (strict).

    Each range adds one row at both ends of its bins; grid rows are then cumulated, so no site meets every grid age."""
    ranges = df.select(F.explode(samples).alias("s")).select(F.col("s.lower").alias("a"), F.col("s.upper").alias("b")).where("a is not null and b is not null")
    last = math.floor(grid_max / grid_step)
    # for t <= a: 1; a < t < b: (b - t) / (b - a). As sums over grid index i (t = i * step): constant and slope parts.
    w = F.when(F.col("b") > F.col("a"), 1 / (F.col("b") - F.col("a")))
    first_inside = (F.floor(F.col("a") / grid_step) + 1).cast("long")  # first grid point beyond a
    first_past = F.when(F.col("b") > F.col("a"), F.ceil(F.col("b") / grid_step)).otherwise(F.ceil(F.col("a") / grid_step)).cast("long")  # first grid point at or beyond b
    events = ranges.select(
        F.explode(
            F.array(
                F.struct(F.least(F.when(w.isNull(), first_past).otherwise(first_inside), F.lit(last + 1)).alias("i"), F.lit(-1.0).alias("ones"), F.coalesce(F.col("b") * w, F.lit(0.0)).alias("c"), F.coalesce(w, F.lit(0.0)).alias("w")),
                F.struct(F.least(first_past, F.lit(last + 1)).alias("i"), F.lit(0.0).alias("ones"), F.coalesce(-F.col("b") * w, F.lit(0.0)).alias("c"), F.coalesce(-w, F.lit(0.0)).alias("w")),
            )
        ).alias("e")
    ).select("e.*")
    sums = events.groupBy("i").agg(F.sum("ones").alias("ones"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    grid = df.sparkSession.range(last + 1).select(F.col("id").alias("i")).join(sums, "i", "left").na.fill(0.0)
    total = ranges.agg(F.count(F.lit(1)).alias("total"))
    run = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # over the grid's rows only
    return grid.select("i", *[F.sum(x).over(run).alias(x) for x in ("ones", "c", "w")]).crossJoin(total).select(
        (F.col("i") * grid_step).alias("age"), ((F.col("total") + F.col("ones") + F.col("c") - F.col("w") * F.col("i") * grid_step) / n).alias("expected")
    )


def _ranges(counts: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """Rows, one for each (by, value), dealt by Spark's own ranges of (by, value) and written with the range's number: a large group
    is many ranges, and small groups share one."""
    return settled(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), label)


def _along(ranged: DataFrame, by: Sequence[str], value: str, name: str, how: str, column: Column, up: bool = True, whole: str | None = None) -> DataFrame:
    """Add the fold (sum, min) of ``column`` over the group's rows up to this one in order of ``value`` (down from the top if not
    ``up``): inside each range, and carried over one row a group and range; with ``whole`` also the fold over the whole group."""
    fold = {"sum": F.sum, "min": F.min}[how]
    turn = (lambda c: F.col(c).asc()) if up else (lambda c: F.col(c).desc())
    valued = ranged.withColumn("_v", column)
    inside = Window.partitionBy(*by, "_range").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = valued.groupBy(*by, "_range").agg(fold("_v").alias("_t"))
    carried = carried.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_range"])], fold("_t").over(before).alias("_c"), fold("_t").over(Window.partitionBy(*by)).alias("_w"))
    same = F.lit(True)
    for i, c in enumerate([*by, "_range"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    local, carry = F.col("_l"), F.col("_c")
    both = F.least(local, carry) if how == "min" else local + F.coalesce(carry, F.lit(0))
    out = valued.withColumn("_l", fold("_v").over(inside)).join(carried, same).withColumn(name, both)
    return out.select(*ranged.columns, name, *([F.col("_w").alias(whole)] if whole else []))


def _back(df: DataFrame, found: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``names`` of ``found`` (one row a key); null keys meet null keys."""
    right = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *names)
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & df[c].eqNullSafe(right[f"_k{i}"])
    return df.join(right, same, "left").select(*df.columns, *names)


def bh_adjust(df: DataFrame, p: str = "p", partition: Sequence[str] = (), name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg within each partition: the least p * m / rank over this and higher ranks, at most 1. Ranks of ties count all
    of them; null p-values stay null and do not count."""
    by = list(partition)
    counts = _ranges(df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n")), by, p, "p-values")
    sized = _along(counts, by, p, "_r", "sum", F.col("_n"), whole="_m")
    least = _along(sized, by, p, "_least", "min", F.col(p) * F.col("_m") / F.col("_r"), up=False)
    return _back(df, least.withColumn(name, F.least(F.lit(1.0), F.col("_least"))), [*by, p], [name])


def avg_rank(df: DataFrame, col: str, partition: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Average ranks with ties, from counts of distinct values."""
    by = list(partition)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        ranks = cumulate(counts, col, {"_below": F.col("_n")}).withColumn(name, F.col("_below") - (F.col("_n") - 1) / 2).drop("_n", "_below")
        return df.join(ranks, [col], "left")
    ranks = _along(_ranges(counts, by, col, "ranks"), by, col, "_below", "sum", F.col("_n"))
    return _back(df, ranks.withColumn(name, F.col("_below") - (F.col("_n") - 1) / 2), [*by, col], [name])


def ecdf(df: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values of each set with the share of rows at or below them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    run = _along(_ranges(counts, [by], value, "values"), [by], value, "_below", "sum", F.col("n"), whole="_m")
    return run.select(by, value, (F.col("_below") / F.col("_m")).alias("share"))


def natural_order(df: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    from strandloom.functions.scalars import chrom_rank

    return df.orderBy(chrom_rank(F.col(chrom)), chrom, pos)


def step_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Rows after each named step, and how many the step removed."""
    counts = None
    for i, (name, df) in enumerate(named.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.withColumn("removed", F.lag("n").over(Window.orderBy("step")) - F.col("n"))  # one row a step
