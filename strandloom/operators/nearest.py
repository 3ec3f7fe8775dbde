"""Nearest interval with distance, by a carry over blocks of positions: no window over a whole chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.carry import BLOCK, running
from strandloom.operators.intervals import WIDTH, _pairs


def nearest(a: DataFrame, b: DataFrame, ties: str = "all", max_distance: int | None = None, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """For every row of ``a``: the nearest rows of ``b`` (columns prefixed ``b_``) and ``distance``.

    Distance is 0 for an overlap, 1 for intervals that touch, else the gap plus one. ``ties``: ``all`` keeps every equal, ``first``
    the one that starts first (then ends first). Rows without any row of ``b`` on their chromosome drop out, as do those
    beyond ``max_distance``.
    """
    if ties == "first":
        return _nearest_first(a, b, max_distance, block)
    right = b.select("chrom", "start", "end").distinct()
    others = [c for c in b.columns if c not in ("chrom", "start", "end")]
    columns = [*a.columns, "b_start", "b_end", *[f"b_{c}" for c in others], "distance"]
    # pairs that overlap leave the range join as they are: they may be far more than the rows, and nothing shuffles them again
    over = _pairs(a, b, width).withColumn("distance", F.lit(0).cast("long")).select(*columns)

    # an ask overlaps a row exactly if the greatest end of the rows that start before it ends lies behind its start
    nothing = F.lit(None).cast("long")
    asks = a.select("chrom", "start", "end").distinct().select("chrom", F.col("end").alias("at"), F.lit(0).alias("kind"), "start", "end", nothing.alias("hit"))
    begun = right.select("chrom", F.col("start").alias("at"), F.lit(1).alias("kind"), nothing.alias("start"), nothing.alias("end"), F.col("end").alias("hit"))
    reached = running(asks.unionByName(begun), ["chrom"], "at", ["at", "kind"], {"reach": ("max", F.col("hit"))}, block=block).where("kind = 0")
    keys = reached.where("reach is null or reach <= start").select("chrom", "start", "end")

    # the greatest end at or before each start, and the least start at or after each end
    asks = keys.select("chrom", F.col("start").alias("at"), F.lit(1).alias("kind"), "start", "end", nothing.alias("hit"))
    ends = right.select("chrom", F.col("end").alias("at"), F.lit(0).alias("kind"), nothing.alias("start"), nothing.alias("end"), F.col("end").alias("hit"))
    below = running(asks.unionByName(ends), ["chrom"], "at", ["at", "kind"], {"near": ("max", F.col("hit"))}, block=block).where("kind = 1 and near is not null")
    before = below.select("chrom", "start", "end", F.col("near").alias("b_key"), (F.col("start") - F.col("near") + 1).alias("distance"))
    asks = keys.select("chrom", (-F.col("end")).alias("at"), F.lit(1).alias("kind"), "start", "end", nothing.alias("hit"))
    starts = right.select("chrom", (-F.col("start")).alias("at"), F.lit(0).alias("kind"), nothing.alias("start"), nothing.alias("end"), (-F.col("start")).alias("hit"))
    above = running(asks.unionByName(starts), ["chrom"], "at", ["at", "kind"], {"near": ("max", F.col("hit"))}, block=block).where("kind = 1 and near is not null")
    after = above.select("chrom", "start", "end", (-F.col("near")).alias("b_key"), (-F.col("near") - F.col("end") + 1).alias("distance"))

    # asks that overlap nothing take the closer side; a side's key names all rows of b that end (or start) there
    sides = before.withColumn("side", F.lit("end")).unionByName(after.withColumn("side", F.lit("start")))
    free = sides.join(sides.groupBy("chrom", "start", "end").agg(F.min("distance").alias("distance")), ["chrom", "start", "end", "distance"])
    by_end = free.where("side = 'end'").join(right.select("chrom", F.col("end").alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end")), ["chrom", "b_key"])
    by_start = free.where("side = 'start'").join(right.select("chrom", F.col("start").alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end")), ["chrom", "b_key"])
    pair = ["chrom", "start", "end", "b_start", "b_end", "distance"]
    found = by_end.select(*pair).unionByName(by_start.select(*pair)).distinct()
    named = b.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), *[F.col(c).alias(f"b_{c}") for c in others])
    full = a.join(found.join(named, ["chrom", "b_start", "b_end"]), ["chrom", "start", "end"]).select(*columns).unionByName(over)
    return full if max_distance is None else full.where(F.col("distance") <= max_distance)


def _nearest_first(a: DataFrame, b: DataFrame, max_distance: int | None, block: int) -> DataFrame:
    """One row of ``b`` for each row of ``a``, however many overlap it: three carries over distinct intervals, no pairs.

    In order of start and end, the first row of ``b`` that ends behind an ask's start is the first to raise the greatest end
    so far above it; such rows have growing ends, and the ask meets one exactly if it starts before the ask ends."""
    others = [c for c in b.columns if c not in ("chrom", "start", "end")]
    keys = a.select("chrom", "start", "end").distinct()
    rows = b.select("chrom", F.struct("start", "end", *others).alias("row"))
    right = rows.groupBy("chrom", F.col("row.start").alias("start"), F.col("row.end").alias("end")).agg(F.min("row").alias("row"))
    ahead = running(right, ["chrom"], "start", ["start", "end"], {"top": ("max", F.col("end"))}, inclusive=False, block=block)
    raising = ahead.where("top is null or end > top").select("chrom", (-F.col("end")).alias("at"), "row")
    by_end = right.groupBy("chrom", F.col("end").alias("at")).agg(F.min("row").alias("row"))
    by_start = right.groupBy("chrom", (-F.col("start")).alias("at")).agg(F.min("row").alias("row"))

    def last(found: DataFrame, at, inclusive: bool) -> DataFrame:
        """For each ask the row of ``found`` with the greatest ``at`` up to (or, unless ``inclusive``, before) its own."""
        asks = keys.select("chrom", at.alias("at"), F.lit(1 if inclusive else 0).alias("kind"), F.struct("start", "end").alias("ask"))
        held = found.select("chrom", "at", F.lit(0 if inclusive else 1).alias("kind"), F.struct("at", "row").alias("hit"))
        both = asks.unionByName(held, allowMissingColumns=True)
        near = running(both, ["chrom"], "at", ["at", "kind"], {"near": ("max", F.col("hit"))}, block=block)
        return near.where("ask is not null and near is not null").select("chrom", "ask.start", "ask.end", "near.row")

    over = last(raising, -F.col("start"), False).where("row.start < end").select("*", F.lit(0).cast("long").alias("distance"))
    before = last(by_end, F.col("start"), True).select("*", (F.col("start") - F.col("row.end") + 1).alias("distance"))
    after = last(by_start, -F.col("end"), True).select("*", (F.col("row.start") - F.col("end") + 1).alias("distance"))
    best = over.unionByName(before).unionByName(after).groupBy("chrom", "start", "end").agg(F.min(F.struct("distance", "row")).alias("best"))
    if max_distance is not None:
        best = best.where(F.col("best.distance") <= max_distance)
    taken = [F.col(f"best.row.{c}").alias(f"b_{c}") for c in ("start", "end", *others)]
    return a.join(best, ["chrom", "start", "end"]).select(*a.columns, *taken, "best.distance")


def nearest_k(anchors: DataFrame, pool: DataFrame, k: str = "k", key: str = "anchor", block: int = BLOCK) -> DataFrame:
    """The ``k`` positions of ``pool`` closest to each anchor (a column of ``anchors``: key, chrom, pos, k); fewer if the
    chromosome holds fewer. Ties go to the lower position.

    Pool positions are numbered along the chromosome; an anchor's neighbours are the k numbers on both sides of its own
    place, so the join is on (chrom, number) and no window of positions has to be guessed or widened."""
    numbered = running(pool.select("chrom", "pos"), ["chrom"], "pos", ["pos"], {"number": ("count", F.lit(1))}, block=block)
    asks = anchors.select("chrom", "pos").distinct().select("chrom", "pos", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_one"))
    both = asks.unionByName(pool.select("chrom", "pos", F.lit(0).alias("_kind"), F.lit(1).alias("_one")))
    places = running(both, ["chrom"], "pos", ["pos", "_kind"], {"below": ("count", F.col("_one"))}, block=block).where("_kind = 1").select("chrom", "pos", F.coalesce("below", F.lit(0)).alias("below"))
    near = anchors.join(places, ["chrom", "pos"]).withColumn("number", F.explode(F.sequence(F.col("below") - F.col(k) + 1, F.col("below") + F.col(k))))
    hits = near.join(numbered.select("chrom", "number", F.col("pos").alias("near_pos")), ["chrom", "number"])
    distance = F.abs(F.col("near_pos") - F.col("pos"))
    w = Window.partitionBy(key).orderBy(distance, "near_pos")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col(k)).select(key, "chrom", "pos", k, "near_pos", distance.alias("distance"), "rank")
