"""Random placements of intervals outside excluded stretches, and the genes next to them. A placement is made in the task that uses
it: what is shuffled are intervals, gaps and genes, never a row a placement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from strandloom.operators.carry import previous, work_parts
from strandloom.operators.islands import merge
from strandloom.storage import settled

#: A row of the stream carries the draws of so many replicates; a gene's bits are words of so many.
LANE, WORD = 32, 64
#: Most copies of a chromosome's rows that are dealt out, and most elements of a table of (size, gap).
SHARDS, CELLS = 8, 1 << 21
_GAP, _GENE, _ROW = 0, 1, 2


class Gaps:
    """The free stretches of one chromosome, in order."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.room = low, high - low

    def place(self, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For intervals of ``size`` and draws ``h`` (a row an interval): the (h mod n)-th of the n starts where the interval fits
        into a gap, -1 if there is none."""
        at = np.full(h.shape, -1, np.int64)
        sizes, of = np.unique(size, return_inverse=True)
        if not len(self.low):
            return at
        step = max(1, CELLS // len(self.low))
        for first in range(0, len(sizes), step):
            upto = np.maximum(self.room - sizes[first : first + step, None] + 1, 0).cumsum(axis=1)  # starts up to each gap
            total = upto[:, -1]
            offset = np.arange(len(total)) * (total.max() + 1)
            flat = (upto + offset[:, None]).ravel()
            rows = np.flatnonzero((of >= first) & (of < first + step))
            rows = rows[total[of[rows] - first] > 0]
            i = of[rows] - first
            u = np.mod(h[rows], total[i][:, None])
            g = np.searchsorted(flat, u + offset[i][:, None], "right")
            gap = g - (i * len(self.low))[:, None]
            at[rows] = self.low[gap] + u - np.where(gap > 0, flat[g - 1] - offset[i][:, None], 0)
        return at


class Genes:
    """The genes of one chromosome by start and end; ``first`` names the nearest as ``nearest(ties="first")`` does."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        top = np.maximum.accumulate(high)
        self.raising = np.flatnonzero(np.r_[True, high[1:] > top[:-1]])  # each ends behind all before it
        self.top, self.top_start = high[self.raising], low[self.raising]
        self.ends, self.by_end = np.unique(high, return_index=True)
        self.starts, self.by_start = np.unique(low, return_index=True)

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        r = np.searchsorted(self.top, start, "right")
        over = r < len(self.top)
        r[~over] = 0
        over &= self.top_start[r] < end
        out = self.raising[r]
        free = np.flatnonzero(~over)
        if len(free):
            start, end = start[free], end[free]
            b, a = np.searchsorted(self.ends, start, "right") - 1, np.searchsorted(self.starts, end, "left")
            has_b, has_a = b >= 0, a < len(self.starts)
            a[~has_a] = 0
            below, above = start - self.ends[b], self.starts[a] - end
            row_b, row_a = self.by_end[b], self.by_start[a]
            closer = (below < above) | ((below == above) & (row_b < row_a))
            out[free] = np.where(has_b & (~has_a | closer), row_b, row_a)
        return out


def free_gaps(excluded: DataFrame | None, sizes: DataFrame) -> DataFrame:
    """(chrom, start, end): the stretches of every chromosome (chrom, length) outside ``excluded``."""
    lengths = sizes.select("chrom", F.col("length").cast("long").alias("_len"))
    ends = lengths.select("chrom", F.col("_len").alias("start"), F.col("_len").alias("end"))
    if excluded is None:
        return lengths.select("chrom", F.lit(0).cast("long").alias("start"), F.col("_len").alias("end")).where("start < end")
    inside = merge(excluded.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).join(F.broadcast(lengths), "chrom").where("start < _len and end > 0")  # one row a chromosome
    edges = inside.select("chrom", "start", F.least("end", "_len").alias("end")).unionByName(ends)
    before = previous(edges, ["chrom"], "start", ["start", "end"], {"_before": "end"})
    return before.select("chrom", F.coalesce("_before", F.lit(0).cast("long")).alias("start"), F.col("start").alias("end")).where("start < end")


def _stream(df: DataFrame, sizes: DataFrame, replicates: int, seed: int, excluded: DataFrame | None, genes: DataFrame | None) -> tuple[DataFrame, int]:
    """A partition for each chromosome and stretch of replicates, with gaps, then genes, then intervals (size, start) by size; and
    the replicates of a stretch. An interval's row is repeated for every 32 replicates only after it was dealt and sorted, each with the
    draws of its replicates."""
    spark = df.sparkSession
    names = settled(sizes.select("chrom", F.col("length").cast("long").alias("length")), "sizes")
    chroms = max(1, names.count())
    words = -(-replicates // WORD)
    shards = min(words, SHARDS, -(-work_parts(spark) // chroms))
    stretch = -(-words // shards) * WORD
    shards = -(-replicates // stretch)
    cells = names.select("chrom", ((F.row_number().over(Window.orderBy("chrom")) - 1) * shards).alias("_cell"))  # one row a chromosome

    copies = Window.partitionBy("chrom", "start", "end").orderBy(*[c for c in df.columns if c not in ("chrom", "start", "end")] or [F.col("end") - F.col("start")])
    size = (F.col("end") - F.col("start")).cast("long")
    own = [F.struct(*df.columns).alias("row")] if genes is None else []  # nothing reads it where placements stay in their tasks
    rows = df.withColumn("_copy", F.row_number().over(copies)).select("chrom", F.lit(_ROW).alias("_kind"), size.alias("_low"), F.col("start").cast("long").alias("_high"), "_copy", F.col("start").alias("_start"), F.col("end").alias("_end"), *own).where("_low is not null")
    span = lambda t, kind, *more: t.select("chrom", F.lit(kind).alias("_kind"), F.col("start").cast("long").alias("_low"), F.col("end").cast("long").alias("_high"), *more).where("_low is not null and _high is not null")
    both = rows.unionByName(span(free_gaps(excluded, names), _GAP), allowMissingColumns=True)
    order = ["_cell", "_kind", "_low", "_high"]
    if genes is not None:
        both = both.unionByName(span(genes, _GENE, F.struct("gene", "in_set", "once").alias("gene")), allowMissingColumns=True)
        order.append("gene")
    dealt = both.join(F.broadcast(cells), "chrom").withColumn("_cell", F.explode(F.sequence(F.col("_cell"), F.col("_cell") + shards - 1)))
    parts = min(chroms * shards, 8 * work_parts(spark))
    sent = dealt.repartitionById(parts, F.pmod(F.col("_cell"), F.lit(parts)).cast("int")).sortWithinPartitions(*order)
    first = (F.col("_cell") % shards) * (stretch // LANE)
    last = F.least(first + stretch // LANE, F.lit(-(-replicates // LANE))) - 1
    each = sent.withColumn("_lane", F.explode(F.when(F.col("_kind") == _ROW, F.sequence(first, last)).otherwise(F.array(F.lit(-1)))))
    draws = [F.xxhash64(F.lit(seed), F.col("_lane") * LANE + j, F.lit(0), "_copy", "chrom", "_start", "_end") for j in range(LANE)]
    return each.select("_cell", "_kind", "_low", "_high", "_lane", F.array(*draws).alias("_h"), "row" if genes is None else "gene"), stretch


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, kind, rows) of the stretches of one cell and kind."""
    cell, kind = (batch[c].to_numpy() for c in ("_cell", "_kind"))
    cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
        if b > a:
            yield int(cell[a]), int(kind[a]), batch.slice(a, b - a)


def _numbers(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([b[column].to_numpy() for b in batches]) if batches else np.zeros(0, np.int64)


def _draws(batch: pa.RecordBatch) -> np.ndarray:
    return batch["_h"].flatten().to_numpy().reshape(-1, LANE)


def shuffle_intervals(df: DataFrame, sizes: DataFrame, replicates: int, seed: int, excluded: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Every interval placed in every replicate at a random start of its chromosome, each start that keeps it off ``excluded``
    being equally likely (the law of redrawing until it fits). Start and end are null where no start fits. The draw is a hash of
    seed, replicate and interval; a task holds the gaps of one chromosome and reads its intervals in order of size.

    With ``genes`` (chrom, start, end, gene, in_set) the placements stay in their tasks, and the result is a row a replicate: the
    distinct genes that are nearest to a placement (the first of equals), ``n``, and those of them in the set, ``k``; replicate -1
    has the intervals where they stand. Genes whose ``in_set`` is null are not counted, replicates without a gene are left out. A task also holds the genes of its chromosome, with
    a bit for each replicate of its stretch."""
    if genes is not None:
        return _nearest_genes(df, sizes, replicates, seed, excluded, genes)
    stream, _ = _stream(df, sizes, replicates, seed, excluded, None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, gaps = [], None, None
        for batch in batches:
            for cell, kind, part in _runs(batch):
                if cell != now:
                    held, now, gaps = [], cell, None
                if kind == _GAP:
                    held.append(part)
                    continue
                gaps = gaps or Gaps(_numbers(held, "_low"), _numbers(held, "_high"))
                at = gaps.place(part["_low"].to_numpy(), _draws(part)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, LANE, dtype=np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays([part["row"], part["_lane"], lists], names=["row", "_lane", "at"])

    schema = StructType().add("row", stream.schema["row"].dataType).add("_lane", IntegerType()).add("at", ArrayType(LongType()))
    placed = stream.mapInArrow(place, schema).select("row", "_lane", F.posexplode("at").alias("_j", "_at"))
    placed = placed.select("row", (F.col("_lane") * LANE + F.col("_j")).alias("replicate"), F.when(F.col("_at") >= 0, F.col("_at")).alias("_at")).where(F.col("replicate") < replicates)
    size = (F.col("row.end") - F.col("row.start")).cast("long")
    own = {"start": F.col("_at").alias("start"), "end": (F.col("_at") + size).alias("end")}
    return placed.select(*[own.get(c, F.col("row")[c].alias(c)) for c in ["chrom", *[c for c in df.columns if c != "chrom"]]], "replicate", F.col("row.start").alias("src_start"))


def _nearest_genes(df: DataFrame, sizes: DataFrame, replicates: int, seed: int, excluded: DataFrame | None, genes: DataFrame) -> DataFrame:
    # a gene of one row is counted where it is hit; one of several rows (on two chromosomes, say) goes on as bits
    known = genes.select("chrom", "start", "end", "gene", "in_set").withColumn("once", F.count(F.lit(1)).over(Window.partitionBy("gene", "in_set")) == 1)
    stream, stretch = _stream(df, sizes, replicates, seed, excluded, known)
    shards = -(-replicates // stretch)

    def tell(base: int, bits: np.ndarray, table: pa.StructArray) -> Iterator[pa.RecordBatch]:
        inside, once = table.field("in_set"), table.field("once").to_numpy(zero_copy_only=False)
        named = inside.is_valid().to_numpy(zero_copy_only=False) & bits.any(axis=1)
        inside = inside.fill_null(False).to_numpy(zero_copy_only=False)
        count = lambda rows: sum((np.unpackbits(bits[r], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for r in np.array_split(rows, len(rows) // 10_000 + 1)), np.zeros(bits.shape[1] * 8, np.int64))
        more = np.flatnonzero(named & ~once)
        for some in np.array_split(more, len(more) // 10_000 + 1):
            n = len(some)
            words = bits[some].view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (bits.shape[1] * 8 // WORD)), pa.array(words))
            none = pa.nulls(n, pa.list_(pa.int64()))
            taken = table.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base, np.int32)), taken.field("gene"), taken.field("in_set"), lists, none, none], names=names)
        counts = [pa.array([count(np.flatnonzero(named & once & held)).tolist()], pa.list_(pa.int64())) for held in (np.ones(len(once), bool), inside)]
        yield pa.RecordBatch.from_arrays([pa.array([base], pa.int32()), pa.nulls(1, table.type.field("gene").type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.list_(pa.int64())), *counts], names=names)

    def tell_all(cell: int, bits: np.ndarray, own: np.ndarray, table: pa.StructArray) -> Iterator[pa.RecordBatch]:
        yield from tell((cell % shards) * stretch, bits, table)
        if cell % shards == 0:
            yield from tell(-1, own, table)

    names = ["base", "gene", "in_set", "words", "n", "k"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ground = None, {_GAP: [], _GENE: []}, None
        for batch in batches:
            for cell, kind, part in _runs(batch):
                if cell != now:
                    if ground:
                        yield from tell_all(now, *ground[2:])
                    now, held, ground = cell, {_GAP: [], _GENE: []}, None
                if kind != _ROW:
                    held[kind].append(part)
                    continue
                if not held[_GENE]:
                    continue
                if ground is None:
                    low, high = _numbers(held[_GENE], "_low"), _numbers(held[_GENE], "_high")
                    fresh = np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0)])  # of equal places the first gene
                    table = pa.concat_arrays([b["gene"] for b in held[_GENE]]).take(pa.array(fresh))
                    gaps = Gaps(_numbers(held[_GAP], "_low"), _numbers(held[_GAP], "_high"))
                    ground = gaps, Genes(low[fresh], high[fresh]), np.zeros((len(fresh), stretch // 8), np.uint8), np.zeros((len(fresh), WORD // 8), np.uint8), table
                gaps, near, bits, own, _ = ground
                size, lane = part["_low"].to_numpy(), part["_lane"].to_numpy()
                stands = part["_high"].to_numpy()[lane == 0]  # an interval's first row, in the first stretch
                own[near.first(stands, stands + size[lane == 0]), 0] = 1
                at = gaps.place(size, _draws(part))
                column = (lane * LANE - (cell % shards) * stretch) // 8
                for j in range(LANE):
                    rows = np.flatnonzero((at[:, j] >= 0) & (lane * LANE + j < replicates))
                    start = at[rows, j]
                    # rows of one gene and byte write the same value, as all set the same bit
                    bits[near.first(start, start + size[rows]), column[rows] + j // 8] |= np.uint8(1 << j % 8)
        if ground:
            yield from tell_all(now, *ground[2:])

    schema = StructType().add("base", IntegerType()).add("gene", genes.schema["gene"].dataType).add("in_set", BooleanType())
    for name in names[3:]:
        schema = schema.add(name, ArrayType(LongType()))
    told = settled(stream.mapInArrow(mark, schema), "told")
    counted = told.where("n is not null").select("base", F.posexplode(F.arrays_zip("n", "k")).alias("_at", "_c")).select((F.col("base") + F.col("_at")).alias("replicate"), "_c.n", "_c.k")
    words = told.where("words is not null").select("gene", "in_set", "base", F.posexplode("words").alias("_word", "_bits"))
    merged = words.groupBy("gene", "in_set", (F.col("base") + F.col("_word") * WORD).alias("base")).agg(F.bit_or("_bits").alias("_bits"))
    bit = lambda i: F.shiftrightunsigned("_bits", i).bitwiseAND(F.lit(1).cast("long"))
    sums = merged.groupBy("base", "in_set").agg(*[F.sum(bit(i)).alias(f"_{i}") for i in range(WORD)])
    shared = sums.select("base", "in_set", F.posexplode(F.array(*[f"_{i}" for i in range(WORD)])).alias("_at", "n"))
    shared = shared.select((F.col("base") + F.col("_at")).alias("replicate"), "n", F.when(F.col("in_set"), F.col("n")).otherwise(0).alias("k"))
    return counted.unionByName(shared).groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0")
