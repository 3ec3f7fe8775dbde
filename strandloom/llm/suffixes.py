"""Operator 7: removal of repeated byte strings by depth-limited most-significant-digit passes over suffixes.

Every byte position starts a suffix, and only its first ``width`` bytes count. A pass deals suffixes into buckets by one more
digit; a suffix alone in its bucket retires, and the buckets left after the last digit are exactly the repeated strings. One
row for every byte would be 16 bytes or more for each byte of text, so the digits are chosen such that neighbouring suffixes
share rows until they part:

1. *First digit*: the ``digit`` bytes from the suffix's anchor on, the rightmost stretch of least hash within its ``width``
   bytes. It depends on those bytes alone, so equal strings have equal first digits at equal places. Consecutive suffixes
   with one anchor (a run, some sixty of them) are one row. Runs alone in their bucket retire.
2. Runs of equal bytes fold into one row with a count: all their suffixes are repeated. Anchors with one content are done.
3. *Second digit*: of what is left, ``block`` suffixes at a time, all bytes that the block's suffixes have in common
   (``width - block + 1``). Blocks alone in their bucket retire; buckets in which all contents agree in every byte of the
   block are done.
4. *Last digit*: the ``block - 1`` bytes still missing of each suffix, as they stand. Equal ones are repeated.

Each pass is a grouped minimum and maximum with a map-side combine, so no bucket, however large, meets in one task. Digits
longer than 8 bytes travel as 64-bit hashes, compared within their anchor's (128 bits in all).

Cases: a null text is empty; an empty text or one shorter than ``width`` keeps everything; repeated rows (same id and text) are
further occurrences of their strings; rows that share an id but not a text are told apart; a null id is an id; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm import _kernels as k, _passages as p
from strandloom.llm._shared import discard, keyed_text, settled, table

U = np.uint64
_BLOCK = "anchor long, core long, content long, single boolean, block int, lo int, hi int, whole long, edges binary"
_SUFFIX = "anchor long, rest long, content long, single boolean, block int, bit int"


@dataclass(frozen=True)
class SuffixPasses:
    """``width``: bytes of a string; ``digit``: bytes of the first digit; ``block``: suffixes that share a second digit,
    at most 60."""

    width: int = 200
    digit: int = 80
    block: int = 11

    # -- inside tasks ---------------------------------------------------------------------------------------------
    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(first row, bytes, row offsets, bytes before the slice in its text); a long text comes in several slices."""
        for row, data, bounds in k.text_slices(batch.column(batch.schema.get_field_index("text"))):
            if len(bounds) == 2 and len(data) > 2 * k.SLICE_BYTES:
                for at in range(0, len(data) - self.width + 1, k.SLICE_BYTES):
                    part = data[at : at + k.SLICE_BYTES + self.width - 1]
                    yield row, part, np.array([0, len(part)]), at
            else:
                yield row, data, bounds, 0

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds, before in self.slices(batch):
                found = k.window_runs(k.BYTE_CODES[data], bounds, self.width, self.digit)
                if found is not None:
                    yield p.run_rows(batch, row, bounds, before, found, np.arange(len(found["first"])))

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow over (text, runs): a row for each block of a run's suffixes. ``edges``: the bytes on either side of
        those that the block's suffixes have in common; ``whole``: hash of all bytes that any of them has."""
        wide = self.block - 1
        for batch in batches:
            of_row, runs = p.runs_of(batch)
            for row, data, bounds, before in self.slices(batch):
                inside = (runs["first"] >= before) & (runs["first"] - before <= len(data) - self.width)
                pick = np.flatnonzero((of_row >= row) & (of_row < row + len(bounds) - 1) & inside)
                if not len(pick):
                    continue
                rolling = k.Rolling(k.BYTE_CODES[data], 1)
                many, lead = runs["many"][pick].astype(np.int64), runs["lead"][pick].astype(np.int64)
                anchor = runs["first"][pick] - before + bounds[of_row[pick] - row] + lead
                low = (lead - many + 1) // self.block
                times = lead // self.block - low + 1
                at = np.repeat(np.arange(len(pick)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + low[at]
                base = block * self.block  # leads base .. base + block - 1
                lo, hi = np.maximum(lead[at] - many[at] + 1 - base, 0), np.minimum(lead[at] - base, wide)
                here = anchor[at] - base
                core = rolling.stretches(here, here + self.width - wide)
                whole = k.mix(rolling.stretches(here - hi, here - lo + self.width) ^ (lo * 64 + hi).astype(U))
                side = np.arange(2 * wide)
                places = here[:, None] + np.where(side < wide, side - wide, self.width - 2 * wide + side)
                known = (places >= (here - hi)[:, None]) & (places < (here - lo + self.width)[:, None])
                edges = np.where(known, data[np.clip(places, 0, len(data) - 1)], 0).astype(np.uint8)
                offsets = (np.arange(len(at) + 1) * 2 * wide).astype(np.int32)
                take = pick[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs["anchor"][take]),
                        pa.array(k.mix(core ^ k.mix(block.astype(U))).view(np.int64)),
                        pa.array(runs["content"][take]),
                        pa.array(runs["single"][take].astype(bool)),
                        pa.array(block, pa.int32()),
                        pa.array(lo, pa.int32()),
                        pa.array(hi, pa.int32()),
                        pa.array(whole.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(edges.tobytes())]),
                    ],
                    names=["anchor", "core", "content", "single", "block", "lo", "hi", "whole", "edges"],
                )

    def last_digits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow: a row for each suffix of a block, with its ``block - 1`` last bytes (packed) in its bucket."""
        wide = self.block - 1
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            edges = np.frombuffer(b"".join(get("edges").to_pylist()), np.uint8).reshape(batch.num_rows, 2 * wide)
            core, lo, hi = (np.asarray(get(c)) for c in ("core", "lo", "hi"))
            rows, rest, bits = [], [], []
            for i in range(self.block):
                at = np.flatnonzero((lo <= i) & (i <= hi))
                key = core[at].view(U) + U(i + 1) * U(0x9E3779B97F4A7C15)
                for word in range(0, wide, 8):  # the bytes left and right of the core that suffix i has, eight at a time
                    part = np.zeros((len(at), 8), np.uint8)
                    stretch = edges[at, wide - i + word : min(wide - i + word + 8, 2 * wide - i)]
                    part[:, : stretch.shape[1]] = stretch
                    key = k.mix(key ^ part.view(U)[:, 0])
                rows.append(at)
                rest.append(key)
                bits.append(np.full(len(at), wide - i, np.int32))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [get("anchor").take(at), pa.array(np.concatenate(rest).view(np.int64)), get("content").take(at), get("single").take(at), get("block").take(at), pa.array(np.concatenate(bits))],
                names=["anchor", "rest", "content", "single", "block", "bit"],
            )

    # -- plan -----------------------------------------------------------------------------------------------------
    def spans(self, texts: DataFrame) -> DataFrame:
        """(doc_id, text_key, spans): per text the covered [start, end) stretches of bytes."""
        runs = settled(texts.mapInArrow(self.runs, p.RUN), "suffixes")
        shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
        alive = p.joined_apart(runs, shared, ["anchor"], "first_digit")
        discard(runs)
        fold = p.folded(alive)
        mixed = p.of_mixed_anchors(fold)

        blocks = settled(p.with_text(texts, mixed).mapInArrow(self.blocks, _BLOCK), "blocks")
        differ = [F.min("content").alias("one"), F.max("content").alias("other"), F.max("single").alias("open")]
        second = blocks.groupBy("anchor", "core").agg(*differ, (F.min("whole") == F.max("whole")).alias("agree")).where("one < other and open")
        left = p.joined_apart(blocks, second.select("anchor", "core", "agree"), ["anchor", "core"], "second_digit")
        discard(blocks)
        # bit b of a block's mask is its suffix of lead block * size + size - 1 - b: bits rise with the place in the text
        wide = self.block - 1
        every = F.expr(f"shiftleft(1L, {wide} - lo + 1) - shiftleft(1L, {wide} - hi)").alias("mask")
        agreed = left.where("agree and single").select("anchor", "content", "block", every)

        suffixes = left.where("not agree").select("anchor", "core", "content", "single", "block", "lo", "hi", "edges").mapInArrow(self.last_digits, _SUFFIX)
        last = suffixes.groupBy("anchor", "rest").agg(*differ).where("one < other and open").select("anchor", "rest")
        equal = suffixes.where("single").join(last, ["anchor", "rest"]).select("anchor", "content", "block", F.expr("shiftleft(1L, bit)").alias("mask"))

        masks = agreed.unionByName(equal).groupBy("anchor", "content", "block").agg(F.bit_or("mask").alias("mask"))
        found = masks.join(mixed.where("copies = 1"), ["anchor", "content"])
        base = F.col("first") + F.col("lead") - F.col("block") * self.block - wide
        found = settled(found.select("doc_id", "text_key", base.alias("base"), "mask"), "last_digit")
        discard(left, mixed)
        return p.covered(alive, fold, found, self.width)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: SuffixPasses | None = None) -> DataFrame:
    """Remove every byte that a repeated string of ``width`` bytes covers; see the module for method and cases.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary) and the removed byte spans, one row for each row of ``docs``.
    """
    passes = passes or SuffixPasses()
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text, spans in p.rows_with_spans(batches):
                kept, at = [], 0
                for start, end in spans.tolist():
                    kept.append(text[at:start])
                    at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                yield doc_id, len(text), len(text) - len(rest), len(spans), rest, spans[:, 0].tolist(), spans[:, 1].tolist()

        yield from p.batched(rows(), names)

    texts = keyed_text(docs, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, span_starts array<long>, span_ends array<long>"
    return p.cut_texts(texts, passes.spans(texts), cut, schema)


def query_op7(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
