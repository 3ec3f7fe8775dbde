"""Null loci that match observed ones: contiguous stretches of a background by length and score, and anchors by score.

All draws repeat (``functions/draws.py``) and meet the background where its rows are; results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.draws import draw, draw_array
from strandloom.operators.bins import cumulate
from strandloom.operators.carry import BLOCK, numbered, running, work_parts
from strandloom.operators.stretches import FOUND, Blocks, begin, finish, met
from strandloom.storage import settled

#: Rows of a block of the background: one row a block goes through the driver. A shorter run is never cut, so a block has fewer than twice as many.
ROWS = 1 << 14
#: Attempts of the first round; later rounds make about as many draws in all, for the loci that are left.
ATTEMPTS = 5
#: Draws that meet one copy of a block's rows.
SHARE = 1 << 16


# -- stretches of a background ---------------------------------------------------------------------------------------
def run_index(background: DataFrame, block: int = BLOCK, rows_in_block: int = ROWS) -> DataFrame:
    """The rows of ``background`` (run, start, end, score, gene, distance; a run's rows follow each other without gaps) numbered by
    (run, start), with length and score * length of the scored rows summed up to this row's start (d0, w0) and end (d1, w1), the number
    of the run's last row (``close``) and a ``block``: stretches of numbers that cut only runs of ``rows_in_block`` rows or more."""
    rows = numbered(background.select("run", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("score").cast("double").alias("score"), "gene", F.col("distance").cast("double").alias("distance")), ["run", "start", "end"], label="background").where("start is not null")
    length = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.col("end") - F.col("start"))
    weight = length * F.col("score")
    summed = running(rows, ["run"], "start", ["start", "number"], {"d1": ("sum", length), "w1": ("sum", weight)}, block=block)
    inner = {"d1": F.coalesce("d1", F.lit(0)), "w1": F.coalesce("w1", F.lit(0.0))}
    before = [(inner["d1"] - F.coalesce(length, F.lit(0))).alias("d0"), (inner["w1"] - F.coalesce(weight, F.lit(0.0))).alias("w0")]
    runs = rows.groupBy("run").agg(F.min("number").alias("_open"), F.max("number").alias("close"))
    home = F.when(F.col("close") - F.col("_open") < rows_in_block, F.col("_open")).otherwise(F.col("number"))
    out = summed.join(runs.hint("merge"), "run")
    return settled(out.select("number", "start", F.coalesce("end", "start").alias("end"), "gene", "distance", "close", F.floor(home / rows_in_block).cast("int").alias("block"), *[c.alias(n) for n, c in inner.items()], *before), "runs")


def _blocks(index: DataFrame) -> tuple[int, bool, Blocks]:
    """How many rows the background has, whether a run goes on in another block, and the blocks."""
    nearest = F.min(F.when(F.col("distance").isNotNull() & ~F.isnan("distance"), F.struct("distance", "number")))
    rows = index.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"), F.max_by("end", "number").alias("end"), (F.max("close") > F.max("number")).alias("cut"), nearest.alias("best")).orderBy("block").collect()
    best = [r["best"] or (None, None) for r in rows]
    return sum(r["n"] for r in rows), any(r["cut"] for r in rows), Blocks([r["block"] for r in rows], [r["first"] for r in rows], [r["end"] for r in rows], [x[0] for x in best], [x[1] for x in best])


def _stream(index: DataFrame, draws: DataFrame, parts: int) -> DataFrame:
    """Partitions of (block, part) with a block's rows and then its draws (block, part, draw)."""
    row = F.struct("number", "start", "end", "close", "d0", "d1", "w0", "w1", "distance")
    both = index.select("block", "part", F.lit(False).alias("drawn"), row.alias("row")).unionByName(draws.select("block", "part", F.lit(True).alias("drawn"), "draw"), allowMissingColumns=True)
    return both.repartition(parts, "block", "part").sortWithinPartitions("block", "part", "drawn")


def _begun(left: DataFrame, index: DataFrame, n: int, blocks: Blocks, seed: int, attempts: range, draws: int, cap: float | None) -> DataFrame:
    """Attempts at a stretch for every (replicate, locus, span, low, high) that is left, as far as they fit (FOUND)."""
    spark = left.sparkSession
    shares, parts = max(1, draws // (len(blocks.block) * SHARE)), work_parts(spark, draws)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replicate, locus = (batch[c].to_numpy().astype(np.int64) for c in ("replicate", "locus"))
            for attempt in attempts:
                first = draw_array(n, seed, replicate, locus, attempt)
                part = ((replicate + locus + attempt) % shares).astype(np.int32)
                values = [batch["locus"], batch["replicate"], pa.array(np.full(len(first), attempt, np.int32)), pa.array(first), batch["span"], batch["low"], batch["high"]]
                made = pa.StructArray.from_arrays(values, names=["locus", "replicate", "attempt", "first", "span", "low", "high"])
                yield pa.RecordBatch.from_arrays([pa.array(blocks.block[blocks.of(first)]), pa.array(part), made], names=["block", "part", "draw"])

    dealt = left.where("locus is not null").repartition(parts, "replicate", "locus")
    drawn = dealt.mapInArrow(make, "block int, part int, draw struct<locus long, replicate int, attempt int, first long, span long, low double, high double>")
    rows = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return _stream(rows, drawn, parts).mapInArrow(lambda batches: met(batches, lambda held, asked: begin(held, asked, blocks, cap)), FOUND)


def _finished(begun: DataFrame, index: DataFrame, cap: float | None) -> DataFrame:
    """FOUND with the stretches that end in another block than they begin in: they meet the rows of that block."""
    begun = settled(begun, "begun")
    far = begun.where("block is not null")
    asked = far.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).select("block", (F.floor(F.col("_n") / SHARE) + 1).cast("int").alias("_shares"))  # one row a block
    draws = far.join(F.broadcast(asked), "block").select("block", F.pmod(F.col("replicate") + F.col("locus") + F.col("attempt"), "_shares").cast("int").alias("part"), F.struct(*far.columns).alias("draw"))
    rows = index.join(F.broadcast(asked), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    ended = _stream(rows, draws, work_parts(begun.sparkSession, far.count())).mapInArrow(lambda batches: met(batches, lambda held, sent: finish(held, sent, cap)), FOUND)
    return begun.where("block is null").unionByName(ended)


def matched_locus_null(loci: DataFrame, background: DataFrame, n_perm: int, seed: int, tries: int = 80, cap: float | None = None, block: int = BLOCK, rows_in_block: int = ROWS) -> DataFrame:
    """For every locus (locus, span, low, high) and replicate a contiguous stretch of background rows (run, start, end, score, gene,
    distance): from a row drawn at random to the first row of its run that ends ``span`` or more after it starts, if the stretch's
    weighted mean score lies in (low, high] (null: open), and its closest gene is no farther than ``cap``. What fails is drawn
    again, up to ``tries`` times, never dropped: dropping would leave the null with fewer genes than the observed loci.

    Returns replicate, locus, gene, distance, mean_score, attempt: one row for each locus and replicate, with nulls where no attempt
    succeeded. ``locus`` is a whole number; a span below 1 counts as 1. A stretch without any distance has no gene and is drawn
    again; equal distances go to the earlier row; scores that are null carry no weight. A draw is sent once, to the block of
    background rows that it falls in; only in a run of ``rows_in_block`` rows or more may its stretch end in another block, and then
    it is sent there. The first rounds of attempts do most, later ones hold the failures alone. Joins are merges of sorted rows: the
    tables are small on disk and many times that in memory, where Spark would send them to all tasks by way of the driver."""
    index = run_index(background, block, rows_in_block)
    asked = settled(loci.select("locus", F.greatest(F.col("span").cast("long"), F.lit(1)).alias("span"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")), "asked")
    replicates = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("replicate")
    nothing = asked.select(replicates, "locus", *[F.lit(None).cast(t).alias(c) for c, t in (("gene", index.schema["gene"].dataType), ("distance", "double"), ("mean_score", "double"), ("attempt", "int"))])
    n, cut, blocks = _blocks(index)
    if not n:
        return nothing
    left, kind = asked.select(F.col("locus").cast("long").alias("locus"), "span", "low", "high", replicates), asked.schema["locus"].dataType
    total, missing = asked.count() * n_perm, asked.where("locus is not null").select("locus").distinct().count() * n_perm
    draws, found, attempt = ATTEMPTS * total, None, 0
    while attempt < tries:
        many = min(max(ATTEMPTS, draws // max(1, missing)), tries - attempt)
        near = _begun(left, index, n, blocks, seed, range(attempt, attempt + many), missing * many, cap)
        if cut:
            near = _finished(near, index, cap)
        picked = near.groupBy("replicate", "locus").agg(F.min_by(F.struct("attempt", "mean_score", "distance", "number"), "attempt").alias("p"))
        done = settled(picked.select("replicate", "locus", "p.attempt", "p.mean_score", "p.distance", "p.number"), "drawn")
        found = done if found is None else found.unionByName(done)
        left = left.join(done.select("replicate", "locus").hint("merge"), ["replicate", "locus"], "left_anti")
        attempt, missing = attempt + many, missing - done.count()
        if not missing:
            break
    genes = found.join(index.select("number", "gene").hint("merge"), "number").select("replicate", F.col("locus").cast(kind).alias("locus"), "gene", "distance", "mean_score", "attempt")
    return genes.unionByName(nothing.join(found.select("replicate", "locus").hint("merge"), ["replicate", "locus"], "left_anti").select(*genes.columns))


# -- anchors by score ------------------------------------------------------------------------------------------------
def _ranks_below(pool: DataFrame, values: DataFrame) -> DataFrame:
    """(v, below, upto): for each distinct ``v`` how many scores of the pool are less, and how many are not greater."""
    counted = pool.groupBy(F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("n")).unionByName(values.select("v", F.lit(0).cast("long").alias("n")))
    return cumulate(counted.groupBy("v").agg(F.sum("n").alias("n")), "v", {"upto": F.col("n")}).select("v", (F.col("upto") - F.col("n")).alias("below"), "upto")


def sample_null_loci(loci: DataFrame, pool: DataFrame, n_rep: int, seed: int, tolerance: float = 20.0, fallback: int = 100_000) -> DataFrame:
    """For each locus (locus, score, k) and replicate an anchor of the pool (chrom, pos, score) within ``tolerance`` of its
    score, drawn with replacement, so that every replicate holds every locus; loci without one draw among the ``fallback``
    closest (of equals those next to it in rank, which keeps them an interval). ``locus`` is a unique whole number; null scores of the pool are in no draw. Returns replicate, locus, chrom, pos, k, score.

    The pool is ranked once by (score, chrom, pos). A locus is an interval of ranks, found by adding its bounds to the running
    count of scores; a draw is a rank, and meets its row by an equi-join. Only a locus without an anchor looks at rows, twice
    ``fallback`` ranks around its score. The joins are merges, as in ``matched_locus_null``."""
    ranked = settled(numbered(pool.where("score is not null").select("chrom", "pos", F.col("score").cast("double").alias("score")), ["score", "chrom", "pos"], "rank", "pool"), "pool")
    goal = F.col("score").cast("double")
    asked = loci.select("locus", "k", goal.alias("_goal"), (goal - tolerance).alias("_lo"), (goal + tolerance).alias("_hi"))
    edges = asked.select(F.explode(F.array("_lo", "_hi", "_goal")).alias("v")).distinct()
    ranks = settled(_ranks_below(ranked, edges).join(edges.hint("merge"), "v"), "ranks")
    part = lambda c, keep, name: ranks.select(F.col("v").alias(c), F.col(keep).alias(name)).hint("merge")
    bounded = settled(asked.join(part("_lo", "below", "_a"), "_lo").join(part("_hi", "upto", "_b"), "_hi").join(part("_goal", "below", "_c"), "_goal"), "loci")
    spans = bounded.where("_a < _b").select("locus", "k", "_a", "_b")
    lost = bounded.where("_a >= _b")
    if lost.take(1):
        near = lost.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("_c") / fallback) + d for d in (-1, 0, 1)])))
        rows = near.join(ranked.withColumn("_bin", F.floor(F.col("rank") / fallback)).hint("merge"), "_bin").where((F.col("rank") >= F.col("_c") - fallback) & (F.col("rank") < F.col("_c") + fallback))
        nearest = Window.partitionBy("locus").orderBy(F.abs(F.col("score") - F.col("_goal")), F.abs(F.col("rank") - F.col("_c") + 0.5), "rank")
        close = rows.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= fallback)
        spans = spans.unionByName(close.groupBy("locus", "k").agg(F.min("rank").alias("_a"), (F.max("rank") + 1).alias("_b")))
    drawn = spans.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))).withColumn("rank", F.col("_a") + draw(F.col("_b") - F.col("_a"), seed, F.col("locus"), F.col("replicate")))
    return drawn.join(ranked.hint("merge"), "rank").select("replicate", "locus", "chrom", "pos", "k", "score")


def null_locus_sites(anchors: DataFrame, pool: DataFrame) -> DataFrame:
    """The ``k`` sites of the pool (chrom, pos, score) closest to each anchor on its chromosome, itself among them; equal distances
    go to the lower position. The k closest lie within k places of the anchor, so its neighbours are met by their number.

    Returns replicate, locus, chrom, anchor, pos, score."""
    sites = settled(numbered(pool.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score")), ["chrom", "pos", "score"], label="sites"), "sites")
    place = sites.groupBy("chrom", "pos").agg(F.min("number").alias("_at"))
    around = anchors.select("replicate", "locus", "chrom", F.col("pos").cast("long").alias("anchor"), F.col("k").cast("long").alias("k")).join(place.withColumnRenamed("pos", "anchor").hint("merge"), ["chrom", "anchor"])
    near = around.withColumn("number", F.explode(F.sequence(F.col("_at") - F.col("k"), F.col("_at") + F.col("k")))).withColumnRenamed("chrom", "_chrom").join(sites.hint("merge"), "number").where(F.col("_chrom") == F.col("chrom"))
    order = Window.partitionBy("replicate", "locus").orderBy(F.abs(F.col("pos") - F.col("anchor")), "pos", "number")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("k")).select("replicate", "locus", "chrom", "anchor", "pos", "score")


def check_matching(loci: DataFrame, null: DataFrame, value: str = "score") -> DataFrame:
    """One row on how well null sites (``value``; also replicate, locus, pos where they are grouped) match the foreground's (``value``):
    percentiles 0, 10, 25, 50, 75, 90, 100 and means of both, the Kolmogorov-Smirnov distance and its p-value; and, if ``loci`` has
    locus, k and span, for loci of two sites or more the median of the wanted and of the realised span, and the share of null loci
    over twice as wide as wanted (else null). Null values are left out."""
    from strandloom.operators.enrichment import ks_2samp

    q = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    side = lambda df, name: df.agg(F.percentile(F.col(value).cast("double"), q).alias(name), F.avg(value).alias(f"{name}_mean"))
    both = loci.select(F.lit("f").alias("side"), F.col(value).alias("v")).unionByName(null.select(F.lit("n").alias("side"), F.col(value).alias("v")))
    out = side(loci, "foreground").crossJoin(side(null, "null")).crossJoin(ks_2samp(both, "side", "v", "f", "n").select("d", "p"))  # one row each
    if not {"locus", "k", "span"} <= set(loci.columns):
        return out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("span", "realised", "share_wide")])
    made = null.groupBy("replicate", "locus").agg((F.max("pos") - F.min("pos")).alias("got"))
    wide = made.join(loci.where("k > 1").select("locus", "span").distinct(), "locus")
    return out.crossJoin(wide.agg(F.percentile(F.col("span").cast("double"), 0.5).alias("span"), F.percentile(F.col("got").cast("double"), 0.5).alias("realised"), F.avg((F.col("got") > 2 * F.col("span")).cast("int")).alias("share_wide")))

