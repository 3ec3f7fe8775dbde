"""Operator 9: exact top-k search by tiled matrix products.

Candidates lie in tiles of at most ``tile`` vectors, queries in blocks of at most ``block``. Each tile meets each block
once, in a cell of a grid of tile buckets and block groups: one matrix product, of which every query keeps its k best
(partial selection). The lists of a query are merged in two levels, by groups of tiles and then whole, so no task gathers
more than k rows from each of its tiles.

Components become floor(256 * x), x as double; scores are integer inner products, computed in doubles while every
partial sum is below 2^53, else in Python integers. Ties go to the smaller vec_id.

Cases: vectors that are null, or hold null or non-finite components, or have a null id, take no part. Every row is a vector of its own:
a query's own row is not its candidate, another row with the same id is, and two query rows with one id get a list each. Equal
scores go to the smaller id, of equal ids to the earlier row. Shorter vectors count as padded with zeros; fewer candidates than k
give them all; an empty table, or one without queries, gives an empty result; further columns are ignored. A score among the best
that does not fit 64 bits ends the job with an error that names the two ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm._shared import settled, table
from strandloom.operators.carry import numbered

_PACK = "part long, ids binary, places binary, cells binary, dim int"


def _packer(most: int):
    """mapInArrow: rows of (id, place, vector) as packs of at most ``most``, sorted by (id, place), components times 256 floored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            ids, places, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            cells = np.zeros((len(ids), int(sizes.max(initial=0))))
            cells[np.arange(cells.shape[1]) < sizes[:, None]] = np.floor(flat * 256)
            order = np.lexsort((places, ids))
            row = [int(places[0]), *(x[order].astype("<i8").tobytes() for x in (ids, places)), cells[order].astype("<f8").tobytes(), cells.shape[1]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["part", "ids", "places", "cells", "dim"])

        for batch in batches:
            ids, places = (np.asarray(batch.column(i)) for i in range(2))
            vectors = batch.column(2)
            bounds = np.asarray(vectors.offsets)
            flat = np.asarray(vectors.values).astype(float)
            at = 0
            while at < len(ids):
                to = min(len(ids), at + most - n)
                held.append((ids[at:to], places[at:to], np.diff(bounds[at : to + 1]), flat[bounds[at] : bounds[to]]))
                n, at = n + to - at, to
                if n == most:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return pack


def _matrix(ids: bytes, places: bytes, cells: bytes, dim: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    x = np.frombuffer(cells, "<f8").reshape(len(own), dim)
    return own, np.frombuffer(places, "<i8"), np.pad(x, ((0, 0), (0, width - dim))) if dim < width else x


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    bound = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries @ tile.T).astype(np.int64)
    exact = [[int(c) for c in row] for row in queries], [[int(c) for c in row] for row in tile]
    return np.array([[sum(a * b for a, b in zip(q, t, strict=True)) for t in exact[1]] for q in exact[0]], object)


def _best(scores: np.ndarray, places: np.ndarray, own: int, k: int) -> np.ndarray:
    """Where the k best of one query stand in a tile; ids rise along the tile, so the first of equals has the least id."""
    free = np.flatnonzero(places != own)
    scores = scores[free]
    if len(scores) <= k:
        return free
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return free[np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])]


def exact_top_k(vectors: DataFrame, asks: Column, k: int = 5, tile: int = 8192, block: int = 512, cells: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of each row of ``vectors`` where the condition
    ``asks`` holds, with all other rows.

    ``cells``: how many cells the grid of tiles and blocks has at least, as far as there are so many; none holds more than
    about 64 tiles and 64 blocks."""
    v = F.col(vector_col)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(id_col).isNotNull()
    rows = settled(vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), v.cast("array<double>").alias("v")).withColumn("place", F.monotonically_increasing_id()), "vectors")
    tiles = rows.select("id", "place", "v").mapInArrow(_packer(tile), _PACK)
    blocks = numbered(rows.where("asks").select("id", "place", "v").mapInArrow(_packer(block), _PACK), ["part"], "block", "queries")
    blocks = blocks.select("block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "places", "cells", "dim")])
    total = blocks.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a grid of cells: a group of blocks meets a bucket of tiles, so keys are many, and tiles are copied once a group and blocks once a bucket
    many = -(-rows.count() // tile)
    side = min(64, max(1, math.ceil(math.sqrt(many * total / cells))))
    groups, buckets = -(-total // side), -(-many // side)
    asked = blocks.withColumn("group", F.floor(F.col("block") / side).cast("int")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dealt = tiles.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    meets = dealt.join(asked, ["group", "bucket"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            for ids, places, cells, dim, q_ids, q_places, q_cells, q_dim in zip(*(get(c) for c in _MEET), strict=True):
                width = max(dim, q_dim)
                own, own_place, q = _matrix(q_ids, q_places, q_cells, q_dim, width)
                them, their_place, t = _matrix(ids, places, cells, dim, width)
                rows: list[tuple[int, ...]] = []
                for at in range(0, len(own), 64):
                    scores = _products(q[at : at + 64], t)
                    for i, (query, place) in enumerate(zip(own[at : at + 64].tolist(), own_place[at : at + 64].tolist(), strict=True)):
                        for j in _best(scores[i], their_place, place, k).tolist():
                            score = int(scores[i][j])
                            if not -(1 << 63) <= score < 1 << 63:
                                raise OverflowError(f"the score of query {query} and vector {int(them[j])} does not fit 64 bits")
                            rows.append((query, place, int(them[j]), int(their_place[j]), score, int(their_place[0]) % 64))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "query", "vec_id", "place", "score", "branch"])

    lists = meets.select(*_MEET).mapInArrow(search, "query_id long, query long, vec_id long, place long, score long, branch long")
    order = (F.desc("score"), F.asc("vec_id"), F.asc("place"))
    some = lists.withColumn("r", F.row_number().over(Window.partitionBy("query", "branch").orderBy(*order))).where(F.col("r") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_MEET = ("ids", "places", "cells", "dim", "q_ids", "q_places", "q_cells", "q_dim")


def query_op9(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


SQL_OP9 = """
WITH e AS (SELECT row_number() OVER () AS place, vec_id, [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.place <> q.place)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY place ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
