"""Moving coordinates between assemblies by chain blocks, and bp to genetic distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strandloom.functions.scalars import complement
from strandloom.operators.carry import BLOCK, previous, running
from strandloom.operators.intervals import WIDTH, _pairs


def lift_points(df: DataFrame, blocks: DataFrame, ref_bases: DataFrame | None = None, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(lifted, rejected) of 1-based sites (chrom, pos, ref, alt, ...).

    ``blocks``: chrom, start, end (half-open source), t_chrom, t_start, t_end, strand. A site with exactly one block is moved by
    its offset; on strand ``-`` its alleles are complemented. With ``ref_bases`` (chrom, pos, base of the target), REF and ALT
    swap where the target's base is ALT (``swapped``), and sites whose base is neither are rejected. ``reason`` tells why."""
    keys = df.select("chrom", "pos").distinct().withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos"))
    hits = _pairs(keys, blocks, width)
    off = F.col("pos") - 1 - F.col("b_start")
    moved = hits.withColumn("_to", F.when(F.col("b_strand") == "-", F.col("b_t_end") - off).otherwise(F.col("b_t_start") + off + 1))
    one = moved.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_n"), F.first("b_t_chrom").alias("_chrom"), F.first("_to").alias("_pos"), F.first("b_strand").alias("_strand"))
    joined = df.join(one, ["chrom", "pos"], "left")
    turned = F.col("_strand") == "-"
    lifted = joined.where("_n = 1").select(
        F.col("_chrom").alias("chrom"), F.col("_pos").alias("pos"), F.when(turned, complement(F.col("ref"))).otherwise(F.col("ref")).alias("ref"),
        F.when(turned, complement(F.col("alt"))).otherwise(F.col("alt")).alias("alt"), *[c for c in df.columns if c not in ("chrom", "pos", "ref", "alt")], F.col("chrom").alias("src_chrom"), F.col("pos").alias("src_pos"),
    )
    reason = F.when(F.col("_n").isNull(), "no block").otherwise("several blocks")
    rejected = joined.where("_n is null or _n > 1").select(*df.columns, reason.alias("reason"))
    if ref_bases is None:
        return lifted, rejected
    based = lifted.join(ref_bases.select("chrom", "pos", F.upper("base").alias("_base")), ["chrom", "pos"], "left")
    same, swap = F.col("_base") == F.col("ref"), F.col("_base") == F.col("alt")
    good = based.where(same | swap).withColumn("swapped", swap).withColumn("_r", F.when(swap, F.col("alt")).otherwise(F.col("ref")))
    good = good.withColumn("alt", F.when(swap, F.col("ref")).otherwise(F.col("alt"))).withColumn("ref", F.col("_r")).drop("_r", "_base")
    bad = based.where(~F.coalesce(same | swap, F.lit(False)))
    others = [c for c in df.columns if c not in ("chrom", "pos")]
    return good, rejected.unionByName(bad.select(F.col("src_chrom").alias("chrom"), F.col("src_pos").alias("pos"), *others, F.lit("base mismatch").alias("reason")))


def lift_intervals(df: DataFrame, blocks: DataFrame, min_match: float = 0.95, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(lifted, failed) of intervals: all mapped bases must fall on one target chromosome and strand and make up at least
    ``min_match`` of the interval. ``reason``: deleted, split or partly deleted."""
    keys = df.select("chrom", "start", "end").distinct()
    hits = _pairs(keys, blocks, width).withColumn("s", F.greatest("start", "b_start")).withColumn("e", F.least("end", "b_end"))
    turned = F.col("b_strand") == "-"
    hits = hits.withColumn("ts", F.when(turned, F.col("b_t_end") - (F.col("e") - F.col("b_start"))).otherwise(F.col("b_t_start") + F.col("s") - F.col("b_start")))
    hits = hits.withColumn("te", F.col("ts") + F.col("e") - F.col("s"))
    per = hits.groupBy("chrom", "start", "end", "b_t_chrom", "b_strand").agg(F.sum(F.col("e") - F.col("s")).alias("bp"), F.min("ts").alias("ts"), F.max("te").alias("te"))
    best = per.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("targets"), F.max_by(F.struct("b_t_chrom", "b_strand", "bp", "ts", "te"), F.struct("bp", "b_t_chrom", "b_strand")).alias("m"))
    joined = df.join(best, ["chrom", "start", "end"], "left")
    enough = F.col("m.bp") >= F.lit(min_match) * (F.col("end") - F.col("start"))
    ok = F.coalesce((F.col("targets") == 1) & enough, F.lit(False))
    others = [c for c in df.columns if c not in ("chrom", "start", "end")]
    lifted = joined.where(ok).select(F.col("m.b_t_chrom").alias("chrom"), F.col("m.ts").alias("start"), F.col("m.te").alias("end"), *others, F.col("m.b_strand").alias("strand"), F.col("chrom").alias("src_chrom"), F.col("start").alias("src_start"), F.col("end").alias("src_end"))
    reason = F.when(F.col("targets").isNull(), "deleted").when(F.col("targets") > 1, "split").otherwise("partly deleted")
    return lifted, joined.where(~ok).select(*df.columns, reason.alias("reason"))


def single_blocks(blocks: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The blocks cut to where no other block of the source lies: what lifting a site moves."""
    edge = blocks.select("chrom", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(blocks.select("chrom", F.col("end").alias("at"), F.lit(-1).alias("step")))
    steps = edge.groupBy("chrom", "at").agg(F.sum("step").alias("step"))
    depth = running(steps, ["chrom"], "at", ["at"], {"depth": ("sum", F.col("step"))}, block=block)
    cuts = previous(depth, ["chrom"], "at", ["at"], {"_from": "at", "_depth": "depth"}, block).where("_depth = 1").select("chrom", F.col("_from").alias("start"), F.col("at").alias("end"))
    hits = _pairs(cuts, blocks, width)
    left, right = F.col("start") - F.col("b_start"), F.col("b_end") - F.col("end")
    turned = F.col("b_strand") == "-"
    begin, end = F.when(turned, F.col("b_t_start") + right).otherwise(F.col("b_t_start") + left), F.when(turned, F.col("b_t_end") - left).otherwise(F.col("b_t_end") - right)
    return hits.select("chrom", "start", "end", F.col("b_t_chrom").alias("t_chrom"), begin.alias("t_start"), end.alias("t_end"), F.col("b_strand").alias("strand"))


def compose_blocks(first: DataFrame, second: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One block table for ``first`` and then ``second`` (chrom, start, end, t_chrom, t_start, t_end, strand): it moves exactly the
    sites that both move one after the other, as each is cut to its single blocks before. The two meet by one range join."""
    a, b = single_blocks(first, width, block), single_blocks(second, width, block)
    middle = a.select(F.col("t_chrom").alias("chrom"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), F.col("chrom").alias("s_chrom"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("strand").alias("s_strand"))
    hits = _pairs(middle, b, width).withColumn("lo", F.greatest("start", "b_start")).withColumn("hi", F.least("end", "b_end"))
    size = F.col("hi") - F.col("lo")
    source = F.when(F.col("s_strand") == "-", F.col("s_end") - (F.col("hi") - F.col("start"))).otherwise(F.col("s_start") + F.col("lo") - F.col("start"))
    target = F.when(F.col("b_strand") == "-", F.col("b_t_end") - (F.col("hi") - F.col("b_start"))).otherwise(F.col("b_t_start") + F.col("lo") - F.col("b_start"))
    strand = F.when(F.col("s_strand") == F.col("b_strand"), "+").otherwise("-")
    return hits.select(F.col("s_chrom").alias("chrom"), source.alias("start"), (source + size).alias("end"), F.col("b_t_chrom").alias("t_chrom"), target.alias("t_start"), (target + size).alias("t_end"), strand.alias("strand"))


def roundtrip_consistent(df: DataFrame, forward: DataFrame, backward: DataFrame, mode: str = "exact", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Sites of ``df`` (with ``id`` chrom_pos...) that come back to where they were after lifting there and back, by one lift over
    the composed blocks; ``substring`` asks only that the returned position's digits occur in the id. Sites that share an id stay
    if one of them comes back."""
    sites = df.select("chrom", "pos", "id", F.lit("N").alias("ref"), F.lit("N").alias("alt"))
    back, _ = lift_points(sites, compose_blocks(forward, backward, width, block), width=width)
    parts = F.split("id", "_")
    same = F.contains(F.col("id"), F.col("pos").cast("string")) if mode == "substring" else (F.col("chrom") == parts[0]) & (F.col("pos") == F.get(parts, F.lit(1)).try_cast("long"))
    return df.join(back.where(same).select("id").distinct(), "id", "left_semi")


def interpolate(df: DataFrame, gmap: DataFrame, pos: str = "pos", name: str = "cm", block: int = BLOCK) -> DataFrame:
    """Add the map value at ``pos``, linear between map points (chrom, pos, cm) and clamped at the map's ends."""
    asks = df.select("chrom", F.col(pos).alias("at")).distinct().select("chrom", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<at:long,cm:double>").alias("m"))
    points = gmap.select("chrom", F.col("pos").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("pos").cast("long").alias("at"), F.col("cm").cast("double").alias("cm")).alias("m"))
    rows = asks.unionByName(points)
    below = running(rows, ["chrom"], "at", ["at", "kind"], {"lo": ("max", F.col("m"))}, block=block).where("kind = 1").select("chrom", "at", "lo")
    flipped = rows.withColumn("neg", -F.col("at"))
    above = running(flipped, ["chrom"], "neg", ["neg", "kind"], {"hi": ("max", F.when(F.col("m").isNotNull(), F.struct((-F.col("m.at")).alias("at"), F.col("m.cm").alias("cm"))))}, block=block).where("kind = 1").select("chrom", "at", "hi")
    lo, hi = F.col("lo"), F.struct((-F.col("hi.at")).alias("at"), F.col("hi.cm").alias("cm"))
    both = below.join(above, ["chrom", "at"])
    share = F.try_divide(F.col("at") - lo["at"], hi["at"] - lo["at"])
    value = F.when(F.col("lo").isNull(), hi["cm"]).when(F.col("hi").isNull() | (lo["at"] == hi["at"]), lo["cm"]).otherwise(lo["cm"] + share * (hi["cm"] - lo["cm"]))
    return df.join(both.select("chrom", F.col("at").alias(pos), value.alias(name)), ["chrom", pos], "left")


def genetic_span(regions: DataFrame, maps: dict[str, DataFrame], sub_blocks: DataFrame | None = None) -> DataFrame:
    """Genetic length of closed regions (region, chrom, start, end) on every named map, and cM per Mb (null for no length).
    Regions with rows in ``sub_blocks`` (region, chrom, start, end) are measured over those instead, summed."""
    parts = regions.select("region", "chrom", "start", "end")
    if sub_blocks is not None:
        parts = parts.join(sub_blocks.select("region").distinct(), "region", "left_anti").unionByName(sub_blocks.select("region", "chrom", "start", "end"))
    out = parts.groupBy("region").agg(F.sum(F.col("end") - F.col("start")).alias("span_bp"))
    ends = parts.select("region", "chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(-1.0).alias("sign")), F.struct(F.col("end").alias("pos"), F.lit(1.0).alias("sign")))).alias("e")).select("region", "chrom", "e.*")
    for name, gmap in maps.items():
        spans = interpolate(ends, gmap).groupBy("region").agg(F.sum(F.col("cm") * F.col("sign")).alias(f"span_cm_{name}"))
        out = out.join(spans, "region", "left").withColumn(f"rate_{name}", F.try_divide(F.col(f"span_cm_{name}") * 1e6, F.col("span_bp")))
    return regions.join(out, "region", "left")


def reverse_blocks(blocks: DataFrame, names: Sequence[str] = ("chrom", "start", "end", "t_chrom", "t_start", "t_end")) -> DataFrame:
    """The reverse blocks: source and target change places."""
    a, b, c, d, e, f = names
    return blocks.select(F.col(d).alias(a), F.col(e).alias(b), F.col(f).alias(c), F.col(a).alias(d), F.col(b).alias(e), F.col(c).alias(f), "strand")
