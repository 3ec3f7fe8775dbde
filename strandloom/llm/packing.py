"""Operator 6: best-fit packing of documents into fixed-length sequences, under conflicts.

Two pieces may not share a sequence (bin) if they come from one source or from one cluster of duplicates. Each bin carries
its residual room and two bitmaps, of the sources and of the clusters in it. Pieces are placed longest first; the search
starts at the bins whose residual is just enough and goes on to the next larger residual (successor) until it finds a bin
whose bitmaps are clear: the tightest compatible bin. If there is none, a bin is opened.

Bins of equal residual are kept by their source bitmap, so a source that holds a third of all rows is passed over one
bitmap at a time and not bin by bin. Work is dealt into shards by a hash of the document's id, source and cluster; a shard
holds about ``shard_units`` units, so the number of shards follows the corpus, every source and cluster is spread over all
shards, rows without an id too, and a shard fits one task. Shards depend on the rows alone, not on how the input is partitioned.

A document longer than a sequence is cut into full sequences and a rest. Cases: null or empty text is one piece of length
zero and is left out of bins (bin null); a null source or cluster conflicts with nothing; repeated rows are packed each, and
conflict as duplicates do; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm._shared import table

_OUT = "doc_id long, piece int, piece_start long, length long, shard int, bin int, bin_start long"


class Bins:
    """Open bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has residual r
        self.clusters: list[int] = []  # bitmap of each bin
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) for a piece with these bitmaps; at most one bit is set in each."""
        room = length
        above = self.rooms >> room
        while above:
            room += (above & -above).bit_length() - 1
            for held, bins in self.by_room[room].items():
                if held & source:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if not self.clusters[bins[i]] & cluster:
                        b = bins[i]
                        bins[i] = bins[-1]
                        bins.pop()
                        if not bins:
                            del self.by_room[room][held]
                            if not self.by_room[room]:
                                self.rooms &= ~(1 << room)
                        return self._put(b, room, held, length, source, cluster)
            room += 1
            above = self.rooms >> room
        self.clusters.append(0)
        self.used.append(0)
        return self._put(len(self.used) - 1, self.capacity, 0, length, source, cluster)

    def _put(self, b: int, room: int, held: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        start = self.used[b]
        self.used[b] += length
        self.clusters[b] |= cluster
        left = room - length
        if left:
            self.by_room[left].setdefault(held | source, []).append(b)
            self.rooms |= 1 << left
        return b, start


def pack_shard(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, piece_start, length, bin, bin_start) for rows in their given order of ties."""
    pieces = [(min(capacity, n - at), i, at // capacity) for i, n in enumerate(lengths) for at in range(0, n, capacity)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    names: dict = {}
    groups: dict = {}
    counts: dict = {}
    for c in clusters:
        counts[c] = counts.get(c, 0) + 1
    bins, out = Bins(capacity), []
    for length, i, piece in pieces:
        s = 0 if sources[i] is None else 1 << names.setdefault(sources[i], len(names))
        # a cluster with one row in the shard conflicts with nothing but that row's own pieces, which share a source or fill bins
        alone = clusters[i] is None or counts[clusters[i]] == 1 and lengths[i] <= capacity
        c = 0 if alone else 1 << groups.setdefault(clusters[i], len(groups))
        b, start = bins.place(length, s, c)
        out.append((i, piece, piece * capacity, length, b, start))
    return out


def pack(docs: DataFrame, length: str, source: str | None, cluster: str | None, capacity: int = 2048, shard_units: int = 1_000_000, id_col: str = "doc_id", total_units: int | None = None) -> DataFrame:
    """Bins for rows of ``docs`` by the columns named; returns doc_id, piece, piece_start, length, shard, bin, bin_start.

    A bin is named by (shard, bin). ``shard_units``: units (words or tokens) that a shard holds on average."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        (F.col(cluster).cast("long") if cluster else F.lit(None).cast("long")).alias("cluster"),
    )
    total = total_units if total_units is not None else rows.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_units))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster"), F.lit(shards)).cast("int"))

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("length", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        lengths = t.column("length").to_pylist()
        placed = pack_shard(lengths, t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity)
        placed += [(i, 0, 0, 0, None, None) for i, n in enumerate(lengths) if n <= 0]
        row, piece, at, n, b, start = zip(*placed, strict=True)
        ids = t.column("doc_id").combine_chunks().take(pa.array(np.array(row)))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([key[0].as_py()] * len(row), pa.int32()), pa.array(b, pa.int32()), pa.array(start, pa.int64())],
            names=["doc_id", "piece", "piece_start", "length", "shard", "bin", "bin_start"],
        )

    return dealt.groupBy("shard").applyInArrow(place, _OUT)


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_units: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack whole texts by their number of words; duplicates are texts equal but for case and blanks."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(text == "", 0).otherwise(blanks + 1).cast("long").alias("length"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.lower(text)).alias("cluster"),
    )
    from strandloom.llm._shared import settled

    return pack(settled(rows, "lengths"), "length", "source", "cluster", capacity, shard_units)


def query_op6(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
