"""Merging, runs and clusters (gaps and islands). The adjacency rules differ on purpose; each has its own function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.carry import BLOCK, previous, running
from strandloom.storage import settled

_ORDER = ["start", "end"]


def _islands(df: DataFrame, fresh: Column, by: Sequence[str], order: Sequence[str], block: int) -> DataFrame:
    """Add ``island``: the start of the latest row at or before this one where ``fresh`` holds."""
    return running(df, by, order[0], order, {"island": ("max", F.when(fresh, F.col(order[0])))}, block=block)


def merge(df: DataFrame, max_gap: int = 0, by: Sequence[str] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """Union of intervals whose start is at most ``max_gap`` past the running end: 0 joins touching ones, -1 only those that
    share a base. Returns by, start, end, n."""
    with_end = running(df, by, "start", _ORDER, {"_reach": ("max", F.col("end"))}, inclusive=False, block=block)
    fresh = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + max_gap)
    return _islands(with_end, fresh, by, _ORDER, block).groupBy(*by, "island").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).select(*by, F.col("island").alias("start"), "end", "n")


def merge_bookended_weighted(df: DataFrame, score_cols: Sequence[str], by: Sequence[str] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """Merge rows whose start equals the end of the row before; scores become length-weighted means of their non-null values."""
    lagged = previous(df, by, "start", _ORDER, {"_before": "end"}, block)
    rows = running(lagged, by, "start", _ORDER, {"island": ("count", F.when(F.col("_before").isNull() | (F.col("_before") != F.col("start")), 1))}, block=block)
    size = F.col("end") - F.col("start")
    means = [F.try_divide(F.sum(F.col(c) * size), F.sum(F.when(F.col(c).isNotNull(), size))).alias(c) for c in score_cols]
    return rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *means).drop("island")


def windows_around(points: DataFrame, pad: int, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Closed regions: points widened by ``pad`` on both sides (not below 1) and merged where they overlap."""
    spans = points.select("chrom", F.greatest(F.lit(1), F.col(pos) - pad).cast("long").alias("start"), (F.col(pos) + pad).cast("long").alias("end"))
    return merge(spans, 0, block=block)


def cluster_positions(df: DataFrame, gap: int, value: str = "support", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Single-linkage clusters of positions; a gap above ``gap`` begins a new one. Adds the region id ``chrom_min_max``."""
    lagged = previous(df, ["chrom"], pos, [pos], {"_before": pos}, block)
    fresh = F.col("_before").isNull() | (F.col(pos) - F.col("_before") > gap)
    rows = _islands(lagged, fresh, ["chrom"], [pos], block)
    out = rows.groupBy("chrom", "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return out.withColumn("span", F.col("end") - F.col("start")).withColumn("region", F.concat_ws("_", "chrom", "start", "end")).drop("island")


def merge_loci(regions: DataFrame, distances: Sequence[int], block: int = BLOCK) -> DataFrame:
    """Loci at each distance D: a new one begins where the gap to the *previous row's* end exceeds D. Returns D, chrom, start,
    end, n, length-weighted ``score`` and the union of candidate ``genes`` (array column of the input)."""
    swept = regions.withColumn("D", F.explode(F.array(*[F.lit(int(d)) for d in distances])))
    lagged = previous(swept, ["D", "chrom"], "start", _ORDER, {"_before": "end"}, block)
    fresh = F.col("_before").isNull() | (F.col("start") - F.col("_before") > F.col("D"))
    rows = running(lagged, ["D", "chrom"], "start", _ORDER, {"island": ("count", F.when(fresh, 1))}, block=block)
    size = F.col("end") - F.col("start")
    return rows.groupBy("D", "chrom", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.col("score") * size), F.sum(F.when(F.col("score").isNotNull(), size))).alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("genes")))).alias("genes"),
    ).drop("island")


def adjacency_runs(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``run``, ``run_start`` and ``run_end`` of contiguous rows (start equals the previous end)."""
    lagged = previous(df, ["chrom"], "start", _ORDER, {"_before": "end"}, block)
    rows = running(lagged, ["chrom"], "start", _ORDER, {"run": ("count", F.when(F.col("_before").isNull() | (F.col("_before") != F.col("start")), 1))}, block=block)
    ends = rows.groupBy("chrom", "run").agg(F.min("start").alias("run_start"), F.max("end").alias("run_end"))
    return rows.drop("_before").join(ends, ["chrom", "run"])


def mask_runs(df: DataFrame, digits: Sequence[str] = ("2", "3"), block: int = BLOCK) -> DataFrame:
    """Intervals of callable digits from mask chunks (chrom, offset, mask text); runs go on across chunk borders."""
    inside = "".join(digits)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        found = re.compile(f"[{re.escape(inside)}]+")
        for pdf in frames:
            rows = [(c, o + m.start(), o + m.end()) for c, o, t in zip(pdf["chrom"], pdf["offset"], pdf["mask"], strict=True) if t for m in found.finditer(t)]
            yield pd.DataFrame(rows, columns=["chrom", "start", "end"])

    return merge(df.select("chrom", "offset", "mask").mapInPandas(cut, "chrom string, start long, end long"), 0, block=block).select("chrom", "start", "end")


def callable_between(sites: DataFrame, masks: Sequence[DataFrame], block: int = BLOCK) -> DataFrame:
    """For each site (1-based pos) inside all masks: callable bases since the site before, up to and with its own base."""
    from strandloom.operators.intervals import overlap_join, sites_in

    mask = masks[0].select("chrom", "start", "end")
    for m in masks[1:]:
        mask = overlap_join(mask, m.select("chrom", "start", "end"), "intersection")
    mask = merge(mask, 0, block=block)
    inside = sites_in(sites, mask)
    events = mask.select("chrom", F.col("end").alias("at"), (F.col("end") - F.col("start")).alias("bp"), F.col("start").alias("from"), F.lit(0).alias("kind"))
    before = running(events, ["chrom"], "at", ["at"], {"total": ("sum", F.col("bp"))}, inclusive=False, block=block).select("chrom", "from", F.col("at").alias("to"), F.coalesce("total", F.lit(0)).alias("total"))
    keyed = overlap_join(inside.select("chrom", "pos").withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos")), before.select("chrom", F.col("from").alias("start"), F.col("to").alias("end"), "total"))
    ranked = keyed.select("chrom", "pos", (F.col("b_total") + F.col("pos") - F.col("b_start")).cast("long").alias("callable"))
    lagged = previous(ranked, ["chrom"], "pos", ["pos"], {"_before": "callable"}, block)
    return inside.join(lagged.select("chrom", "pos", (F.col("callable") - F.coalesce("_before", F.lit(0))).alias("callable_bp")), ["chrom", "pos"])


def _next_kept(pos: np.ndarray, fixed: np.ndarray, gap: int) -> np.ndarray:
    """For each of rising positions the one that a scan keeps after it, were it kept itself; len(pos) for none."""
    n = len(pos)
    after = np.append(np.where(fixed, np.arange(n), n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    return np.minimum(np.searchsorted(pos, pos + max(gap, 1)), after[1:])


def _orbit(jump: np.ndarray, first: int) -> np.ndarray:
    """What is reached from ``first`` by pointers, taken one, two, four, ... steps at a time."""
    n = len(jump)
    jump, seen = np.append(jump, n), np.zeros(n + 1, bool)
    seen[first] = True
    while jump[first] < n:
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def _ends(jump: np.ndarray) -> np.ndarray:
    """The last position on every orbit, by the same doubling."""
    own = np.arange(len(jump))
    jump = np.where(jump == len(jump), own, jump)
    while not np.array_equal(ahead := jump[jump], jump):
        jump = ahead
    return jump


def _first_kept(pos: np.ndarray, fixed: np.ndarray, gap: int, last: int | None) -> int:
    """The first position kept after ``last`` (None: nothing kept before)."""
    if last is None:
        return 0
    free = int(np.searchsorted(pos, last + gap))
    held = np.flatnonzero(fixed[:free])
    return int(held[0]) if len(held) else free


def thin_markers(df: DataFrame, protected: str = "protected", tail: int = 10_000, gap: int = 20, block: int = BLOCK) -> DataFrame:
    """Drop unprotected markers beyond the chromosome's last protected one + ``tail`` (beyond ``tail`` where none is protected); of
    the rest keep those at least ``gap`` past the last kept one, a greedy scan in order of position. A position with a protected
    marker always stays, with all its markers; of another the first marker by the other columns. Rows without place go.

    The scan is a walk over "next kept" pointers. Blocks of positions first tell where each possible entry leaves them: an entry is
    among the first ``gap`` positions, so a block has few. Those rows are composed along the chromosome, and every block then
    walks from its own entry. A task holds the distinct positions of a block."""
    fixed = F.coalesce(F.col(protected), F.lit(False))
    placed = df.where("chrom is not null and pos is not null")
    ends = placed.groupBy("chrom").agg((F.coalesce(F.max(F.when(fixed, F.col("pos"))), F.lit(0)) + tail).alias("_end"))
    near = placed.join(F.broadcast(ends), "chrom").where(fixed | (F.col("pos") <= F.col("_end"))).drop("_end")  # one row a chromosome
    spots = near.groupBy("chrom", F.col("pos").cast("long").alias("pos")).agg(F.bool_or(fixed).alias("fixed")).withColumn("_blk", F.floor(F.col("pos") / block))
    spots = settled(spots, "markers")

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, held = pdf["pos"].to_numpy(), pdf["fixed"].to_numpy()
        many = min(len(pos), int(np.searchsorted(pos, pos[0] + gap)) + 1)
        stop = np.flatnonzero(held[:many])
        entries = range(min(many, int(stop[0]) + 1 if len(stop) else many))
        exits = pos[_ends(_next_kept(pos, held, gap))][: len(entries)]
        return pd.DataFrame({"chrom": key[0], "_blk": key[1], "entries": [pos[: len(exits)].tolist()], "held": [held[: len(exits)].tolist()], "exits": [exits.tolist()]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, out = pdf.sort_values("_blk"), None, []
        for entries, held, exits in zip(pdf["entries"], pdf["held"], pdf["exits"], strict=True):
            out.append(last)
            at = _first_kept(np.asarray(entries), np.asarray(held), gap, last)
            last = int(exits[at]) if at < len(exits) else last
        return pd.DataFrame({"chrom": pdf["chrom"], "_blk": pdf["_blk"], "last": pd.array(out, dtype="Int64")})

    def walk(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, held = pdf["pos"].to_numpy(), pdf["fixed"].to_numpy()
        last = carried["last"].iloc[0]
        at = _first_kept(pos, held, gap, None if pd.isna(last) else int(last))
        kept = _orbit(_next_kept(pos, held, gap), at) if at < len(pos) else np.zeros(len(pos), bool)
        return pd.DataFrame({"chrom": pdf["chrom"][kept], "pos": pos[kept], "fixed": held[kept]})

    summary = spots.groupBy("chrom", "_blk").applyInPandas(leave, "chrom string, _blk long, entries array<long>, held array<boolean>, exits array<long>")
    carried = summary.groupBy("chrom").applyInPandas(compose, "chrom string, _blk long, last long")  # one row a block
    kept = spots.groupBy("chrom", "_blk").cogroup(carried.groupBy("chrom", "_blk")).applyInPandas(walk, "chrom string, pos long, fixed boolean")
    stay = near.join(kept.withColumnRenamed("fixed", "_fixed"), ["chrom", "pos"])
    whole = F.struct(*[F.col(c) for c in df.columns])
    one = stay.where("not _fixed").groupBy("chrom", "pos").agg(F.min(whole).alias("_row")).select("_row.*")
    return stay.where("_fixed").select(*df.columns).unionByName(one.select(*df.columns))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
