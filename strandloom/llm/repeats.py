"""Operator 3: removal of word windows that occur more than once, by a count-min prefilter and exact groups.

* Windows are taken in *runs*: consecutive windows that have the same anchor, the rightmost stretch of ``gram`` words of least
  hash inside the window. Equal windows have equal anchors, so a window's count is at most its anchor's.
* *Prefilter*: partitions count the anchors of their windows, a shuffle merges the counts (count-min), and a second pass over
  the texts sends on only windows whose anchor is estimated to occur twice or more. An estimate is never too low, so no
  repeated window is lost; a window sent for nothing finds no partner. The sketch grows with the corpus.
* *Exact groups*: runs of equal content fold into one row with a count (map-side first); all windows of a run with an equal
  are repeated. Windows of anchors with several contents are then grouped by their own key. Every group is a minimum and a
  maximum with a map-side combine, so no frequent passage lands in one task.

Keys are 64-bit hashes, compared within their anchor (128 bits in all).

Cases: a null text has no words; a text shorter than the window keeps everything; repeated rows (same id and text) are further
occurrences of their windows; rows that share an id but not a text are told apart; a null id is an id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm import _kernels as k, _passages as p
from strandloom.llm._shared import discard, keyed_text, settled, table
from strandloom.llm._sketch import CountMin

U = np.uint64
_WINDOW = "anchor long, window long, content long, single boolean, block int, bit int"
#: Bytes of text for each anchor, at least: about 17 words of some 6 bytes.
_BYTES_PER_ANCHOR = 64


@dataclass(frozen=True)
class RepeatedWindows:
    """``width``: words of a window; ``gram``: words of an anchor; ``sketch``: None for one sized by the input."""

    width: int = 35
    gram: int = 5
    sketch: CountMin | None = None
    #: Words of a long text that are worked off at a time.
    step: int = 1 << 21

    # -- inside tasks ---------------------------------------------------------------------------------------------
    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(first row, word codes, row offsets, words before the slice in its text)."""
        for row, data, bounds in k.text_slices(batch.column(batch.schema.get_field_index("text"))):
            _, _, codes, offsets = k.words(data, bounds, k.BLANKS)
            if len(bounds) > 2 or len(codes) <= self.step:
                yield row, codes, offsets, 0
                continue
            for at in range(0, max(1, len(codes) - self.width + 1), self.step):  # one long text
                part = codes[at : at + self.step + self.width - 1]
                yield row, part, np.array([0, len(part)]), at

    def anchors(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, codes, bounds, _ in self.slices(batch):
            if (found := k.window_runs(codes, bounds, self.width, min(self.gram, self.width))) is not None:
                yield found["anchor"]

    def runs(self, sketch: CountMin, sent) -> Callable:
        """A mapInArrow function: the runs whose anchor is estimated to occur twice or more."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = sketch.load(sent)
            for batch in batches:
                for row, codes, bounds, before in self.slices(batch):
                    found = k.window_runs(codes, bounds, self.width, min(self.gram, self.width))
                    if found is None:
                        continue
                    keep = np.flatnonzero(sketch.estimate(counts, found["anchor"]))
                    if len(keep):
                        yield p.run_rows(batch, row, bounds, before, found, keep)

        return go

    def windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow over (text, runs): a row for each window of the runs, with the window's own key."""
        for batch in batches:
            of_row, runs = p.runs_of(batch)
            for row, codes, bounds, before in self.slices(batch):
                inside = (runs["first"] >= before) & (runs["first"] - before <= len(codes) - self.width)
                pick = np.flatnonzero((of_row >= row) & (of_row < row + len(bounds) - 1) & inside)
                if not len(pick):
                    continue
                keys = k.Rolling(k.mix(codes ^ U(0x5851F42D4C957F2D)), 1).windows(self.width)
                many = runs["many"][pick].astype(np.int64)
                at = np.repeat(np.arange(len(pick)), many)
                spot = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                start = runs["first"][pick][at] - before + bounds[of_row[pick][at] - row] + spot
                take = pick[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs["anchor"][take]),
                        pa.array(keys[start].view(np.int64)),
                        pa.array(runs["content"][take]),
                        pa.array(runs["single"][take].astype(bool)),
                        pa.array(spot // p.BITS, pa.int32()),
                        pa.array(spot % p.BITS, pa.int32()),
                    ],
                    names=["anchor", "window", "content", "single", "block", "bit"],
                )

    # -- plan -----------------------------------------------------------------------------------------------------
    def spans(self, texts: DataFrame) -> DataFrame:
        """(doc_id, text_key, spans): per text the covered [start, end) stretches of words."""
        sketch = self.sketch or CountMin.sized((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _BYTES_PER_ANCHOR)
        sent = sketch.build(texts.select("text"), self.anchors)
        runs = settled(texts.mapInArrow(self.runs(sketch, sent), p.RUN), "runs")
        fold = p.folded(runs)
        mixed = p.of_mixed_anchors(fold)

        windows = settled(p.with_text(texts, mixed).mapInArrow(self.windows, _WINDOW), "windows")
        often = windows.groupBy("anchor", "window").agg(F.min("content").alias("one"), F.max("content").alias("other"), F.max("single").alias("open"))
        often = often.where("one < other and open").select("anchor", "window")
        equal = windows.where("single").join(often, ["anchor", "window"]).groupBy("anchor", "content", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        found = equal.join(mixed.where("copies = 1"), ["anchor", "content"])
        found = settled(found.select("doc_id", "text_key", (F.col("first") + F.col("block") * p.BITS).alias("base"), "mask"), "repeated")
        discard(windows, mixed)
        return p.covered(runs, fold, found, self.width)


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", finder: RepeatedWindows | None = None) -> DataFrame:
    """Remove every word that a repeated window of words covers; see the module for method and cases.

    Words are stretches without space and \\x09-\\x0D, unchanged. Returns doc_id, n_words, n_removed, kept_text (kept words
    joined by one space) and the removed word spans, one row for each row of ``docs``.
    """
    finder = finder or RepeatedWindows()
    names = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text, spans in p.rows_with_spans(batches):
                tokens = text.split()
                kept, at = [], 0
                for start, end in spans.tolist():
                    kept += tokens[at:start]
                    at = end
                kept += tokens[at:]
                yield doc_id, len(tokens), len(tokens) - len(kept), b" ".join(kept).decode(), spans[:, 0].tolist(), spans[:, 1].tolist()

        yield from p.batched(rows(), names)

    texts = keyed_text(docs, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, span_starts array<long>, span_ends array<long>"
    return p.cut_texts(texts, finder.spans(texts), cut, schema)


def query_op3(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
