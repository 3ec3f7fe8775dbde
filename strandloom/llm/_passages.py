"""What the two removers of repeated passages (operators 3 and 7) share: runs of windows, their fold, and the cut.

A *run* is a row (doc_id, text_key, first, many, lead, anchor, content): ``many`` consecutive windows of one text from unit
``first`` on that have the same anchor, which starts ``lead`` units after ``first``. Equal windows have equal anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm import _kernels as k
from strandloom.llm._shared import discard, settled

RUN = "doc_id long, text_key long, first long, many int, lead int, anchor long, content long"
#: Windows whose answers share one row, a bit each.
BITS = 60


def run_rows(batch: pa.RecordBatch, row: int, bounds: np.ndarray, before: int, found: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
    """The kept runs of a slice as rows of ``RUN``."""
    at = pa.array(found["row"][keep] + row)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(batch.schema.get_field_index("doc_id")).take(at),
            batch.column(batch.schema.get_field_index("text_key")).take(at),
            pa.array(found["first"][keep] - bounds[found["row"][keep]] + before, pa.int64()),
            pa.array(found["many"][keep], pa.int32()),
            pa.array(found["lead"][keep], pa.int32()),
            pa.array(found["anchor"][keep].view(np.int64)),
            pa.array(found["content"][keep].view(np.int64)),
        ],
        names=["doc_id", "text_key", "first", "many", "lead", "anchor", "content"],
    )


def joined_apart(rows: DataFrame, keys: DataFrame, on: list[str], label: str) -> DataFrame:
    """Join rows to grouped keys that were written before. A join straight on a grouping would keep its partitioning, and
    all rows of one key in one task; so Spark is free to split a frequent key."""
    known = settled(keys, f"{label}_keys")
    out = settled(rows.join(known, on), label)
    discard(known)
    return out


def folded(runs: DataFrame) -> DataFrame:
    """One row for each (anchor, content) with its number of runs and one of them; map-side first."""
    some = [F.first(c).alias(c) for c in ("doc_id", "text_key", "first", "many", "lead")]
    return settled(runs.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), *some), "folded")


def of_mixed_anchors(fold: DataFrame) -> DataFrame:
    """The rows whose anchor has several contents: the only ones whose windows must be compared one by one."""
    several = fold.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("anchor")
    return joined_apart(fold, several, ["anchor"], "mixed")


def with_text(texts: DataFrame, mixed: DataFrame) -> DataFrame:
    """(text, runs): the runs of each text in one array, which is bounded by the text's own length."""
    run = F.struct("first", "many", "lead", "anchor", "content", (F.col("copies") == 1).alias("single"))
    by_text = mixed.groupBy(F.col("doc_id").alias("run_id"), F.col("text_key").alias("run_key")).agg(F.collect_list(run).alias("runs"))
    one = texts.join(by_text, F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("text_key") == F.col("run_key")))
    return one.select("text", "runs")


def runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each run of a (text, runs) batch, and the runs' columns."""
    column = batch.column(batch.schema.get_field_index("runs"))
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    get = lambda c: np.asarray(flat.field(c).to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(sizes)), sizes), {c: get(c) for c in ("first", "many", "lead", "anchor", "content", "single")}


def mask_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, text_key, base, mask) with bit i for window ``base + i`` to stretches (start, last) of windows."""
    for batch in batches:
        get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        mask = np.asarray(get("mask")).astype(np.uint64)
        bits = ((mask[:, None] >> np.arange(BITS + 2, dtype=np.uint64)) & np.uint64(1)).astype(np.int8)
        step = np.diff(bits, axis=1, prepend=0)
        row, start = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        at, base = pa.array(row), np.asarray(get("base")).astype(np.int64)
        yield pa.RecordBatch.from_arrays([get("doc_id").take(at), get("text_key").take(at), pa.array(base[row] + start), pa.array(base[row] + end - 1)], names=["doc_id", "text_key", "start", "last"])


def covered(runs: DataFrame, fold: DataFrame, masks: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, spans) of each text with repeated windows: runs that have an equal, whole, and single windows from
    ``masks`` (doc_id, text_key, base, mask)."""
    whole = runs.join(fold.where("copies > 1").select("anchor", "content"), ["anchor", "content"])
    whole = whole.select("doc_id", "text_key", F.col("first").alias("start"), (F.col("first") + F.col("many") - 1).alias("last"))
    some = masks.select("doc_id", "text_key", "base", "mask").mapInArrow(mask_ranges, "doc_id long, text_key long, start long, last long")
    span = F.struct("start", (F.col("last") + width).alias("end"))
    # a set, as repeated rows give the same spans again and again
    return whole.unionByName(some).groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("spans"))


def cut_texts(texts: DataFrame, spans: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """Join the spans to their texts and let ``cut`` (a mapInArrow function) make the result rows."""
    spans = spans.withColumnsRenamed({"doc_id": "span_id", "text_key": "span_key"})
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key")), "left")
    starts = F.coalesce(F.col("spans.start"), F.array().cast("array<bigint>")).alias("starts")
    ends = F.coalesce(F.col("spans.end"), F.array().cast("array<bigint>")).alias("ends")
    return joined.select("doc_id", "text", starts, ends).mapInArrow(cut, schema)


def rows_with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, np.ndarray]]:
    for batch in batches:
        get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        starts, ends = get("starts"), get("ends")
        for i, doc_id in enumerate(get("doc_id")):
            at = np.column_stack([np.asarray(starts[i].values).astype(np.int64), np.asarray(ends[i].values).astype(np.int64)]) if len(starts[i]) else np.zeros((0, 2), np.int64)
            yield doc_id.as_py(), get("text")[i].as_buffer().to_pybytes(), k.merge_ranges(at)


def batched(rows: Iterator[tuple], names: list[tuple[str, pa.DataType]], size: int = 500, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``size`` rows, or fewer once their texts and byte strings exceed ``most`` bytes."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])

    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= size or weight > most:
            yield out(held)
            held, weight = [], 0
    if held:
        yield out(held)
