"""Operator 4: benchmark passages in documents by Wu-Manber search over words.

The benchmark's windows are the patterns. A block of two words that no pattern holds lets the search skip every position
the block touches (the shift table); a block that ends a pattern leads to the patterns of its suffix bucket, and those
are compared word for word. Items shorter than a window are patterns of their own length, searched by tables of that length.

Patterns travel to the tasks in blocks of a fixed number of windows, so what is broadcast has a bound whatever the
benchmark holds; a document meets the blocks one after another.

Cases: null text has no words, on either side; an item without words has no window and is never counted; an item of
fewer words than a window is one window; items that share an id count once, all items without an id as one (which has no
place in the list of ids as text); rows of documents that repeat are reported each;
empty tables: no documents give an empty result, no items give zero hits; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm._shared import discard, settled, table

#: A-Z to a-z; digits, a-z and every byte above 127 stay; all other bytes part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_FOLD).split()


class WuManber:
    """Occurrences of patterns (tuples of words, all of one length) in a sequence of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}
        for p, items in patterns.items():
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(p[m - b :], {})[p] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        m, b, n, shift, buckets = self.length, self.block, len(words), self.shift, self.buckets
        skip, end = m - b + 1, m
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift.get(key, skip)
            if step:
                end += step
                continue
            items = buckets[key].get(tuple(words[end - m : end]))
            if items is not None:
                yield end - m, items
            end += 1


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(size, pattern, item_id): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(t)
                if w:
                    size = min(window, len(w))
                    rows += [(size, b" ".join(p), i) for p in {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}]
            c = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int64())], names=["size", "pattern", "item_id"])

    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(cut, "size int, pattern binary, item_id long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_size: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted), hit spans in words; one row for each row of ``docs``.

    ``block_size``: most windows that are sent to the tasks at once."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = texts.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("item_ids"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hits"))
    schema, names = "doc_id long, text string, n_words long, item_ids array<long>, hits array<struct<start:long,end:long>>", held.columns

    def step(sent) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers = tables(sent.value)
            for batch in batches:
                n_words, items, hits = [], [], []
                for text, had, spans in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    w, found = words_of(text.as_py()), [(s["start"], s["end"]) for s in spans]
                    ids = set(had)
                    for searcher in searchers:
                        for at, of in searcher.search(w):
                            found.append((at, at + searcher.length))
                            ids.update(of)
                    n_words.append(len(w))
                    items.append(sorted(ids, key=lambda i: (i is not None, i)))
                    hits.append([{"start": s, "end": e} for s, e in merged(found)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=names,
                )

        return scan

    held = in_blocks(held, windows_of(benchmark, window, item_col, item_text_col), block_size, step, schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return held.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "hits")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of half-open spans, those that touch joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def tables(windows: list[tuple[int, bytes, int | None]]) -> list[WuManber]:
    """One searcher for each length of the windows (size, pattern, item_id)."""
    by: dict[int, dict[tuple[bytes, ...], list]] = {}
    for size, pattern, item in windows:
        by.setdefault(size, {}).setdefault(tuple(pattern.split(b" ")), []).append(item)
    return [WuManber(p) for p in by.values()]


def in_blocks(held: DataFrame, windows: DataFrame, block_size: int, step: Callable, schema) -> DataFrame:
    """``held`` mapped by ``step(block)`` for every block of about ``block_size`` windows. Driver and tasks hold one block at a time: what
    a block leaves is written before the next one is sent. Windows are dealt by their pattern and item, so that a passage
    of many items is dealt as well."""
    spark = held.sparkSession
    written = settled(windows.distinct(), "windows")
    blocks = max(1, -(-written.count() // block_size))
    for b in range(blocks):
        part = written.where(F.pmod(F.xxhash64("pattern", "item_id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r["size"], bytes(r["pattern"]), r["item_id"]) for r in part.toLocalIterator()])
        before, held = held, held.mapInArrow(step(sent), schema)
        if b < blocks - 1:
            held = settled(held, "scanned")
            sent.unpersist()
            if b:
                discard(before)
    return held


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_size: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which any benchmark window occurs; all columns stay. Works in the scan itself."""
    place = docs.columns.index(text_col)

    def step(sent) -> Callable:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers = tables(sent.value)
            for batch in batches:
                texts = [words_of(t.as_py()) for t in batch.column(place)]
                yield batch.filter(pa.array([not any(True for s in searchers for _ in s.search(w)) for w in texts], pa.bool_()))

        return keep

    return in_blocks(docs, windows_of(benchmark, window, "item_id", "text"), block_size, step, docs.schema)


def query_op4(spark, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM d, sizes, unnest(range(1, len(w) - size + 2)) t(i) WHERE len(w) >= size),
hit AS (SELECT DISTINCT doc_id, i, size, item_id FROM dw JOIN bw USING (size, p)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + size)) t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
