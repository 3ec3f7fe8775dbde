"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by how many documents hold them, rare ones to the first, so that owners have about as many postings each.
An owner's lists are cut by document shards. A bundle of items visits the owners one after another: at each stage a cogroup by
shard brings the bundle's sparse accumulators (item, document, score so far) and the owner's lists of the shard together, and the
owner adds its terms' integer contributions. After a stage an accumulator stays only if it can still matter: its score and the
most that later owners can add must reach the item's k-th best score so far (in the shard, or over all shards as of the stage
before). Contributions are never negative, so whatever goes is below k others for good, and the result is exact. After the last
stage each task selects its best and the lists are merged in two steps.

Bounds. A bundle has about ``bundle_terms`` terms, and only a bundle's terms, items and k-th scores are sent to all tasks or to the
driver; further items are further bundles, each against all documents. A shard has ``shard`` documents, so a term that every
document holds is split over all shards. A document counts once for each distinct term of the bundle, however long it is.

Defined results. Null and empty texts have no terms: such a document is in no result and not in N, such an item has no rows.
Every row of ``documents`` is a document and every row of ``benchmark`` an item, also with equal or null ids; equal rows rank next
to each other, null ids after others of the same score. Terms that no document holds, or with weight 0, add nothing. Empty tables
give no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandloom.llm._shared import discard, settled, table
from strandloom.llm._words import pack, slices, split, unpack

#: What stands between terms: everything below 128 but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD = 4096
BUNDLE_TERMS = 1 << 18
STAGES = 4
#: More than any (1000000000 * tf) div (1000 * tf + 8 * m).
_MOST = 1_000_000


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# -- items -----------------------------------------------------------------------------------------------------------
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in slices(_column(batch, "text")):
            flat, counts = split(texts, SEPARATORS)
            terms = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), flat)
            yield pa.RecordBatch.from_arrays([_column(batch, "id").slice(row, len(texts)), pa.array(counts, pa.int64()), terms.cast(pa.list_(pa.string()))], names=["id", "n", "terms"])


class _Bundle:
    """The items that visit the owners together; ``vocabulary`` in order, ``items`` as (place of the term, how often) lists."""

    def __init__(self, rows: list):
        self.ids = [r["id"] for r in rows]
        self.vocabulary = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(self.vocabulary)}
        self.items = [np.unique([place[t] for t in r["terms"]], return_counts=True) for r in rows]


# -- postings --------------------------------------------------------------------------------------------------------
_INDEX = "shard long, documents long, tokens long, ids binary, missing binary, sizes binary, terms binary, held binary, places binary, tf binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), *[(c, pa.binary()) for c in ("ids", "missing", "sizes", "terms", "held", "places", "tf")]])


def _indexer(vocabulary, shard: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary.value, pa.large_string())
        base, made, n, kept = TaskContext.get().partitionId() << 32, 0, 0, []

        def close() -> pa.RecordBatch:
            ids, missing, sizes, place, term, tf = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(term, kind="stable")
            found, held = np.unique(term, return_counts=True)
            packed = [pack(x) for x in (ids, missing, sizes, found, held, place[order], tf[order])]
            row = [base + made, int((sizes > 0).sum()), int(sizes.sum()), *packed]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX_ARROW.types, strict=True)], schema=_INDEX_ARROW)

        for batch in batches:
            ids, missing = _column(batch, "doc_id").fill_null(0).to_numpy(), _column(batch, "doc_id").is_null().to_numpy(zero_copy_only=False)
            for row, texts in slices(_column(batch, "text")):
                flat, counts = split(texts, SEPARATORS)
                coded = flat.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)
                term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                keys = (np.repeat(np.arange(len(texts)), counts) * max(1, len(terms)) + term)[term >= 0]
                keys, tf = np.unique(keys, return_counts=True)
                doc, term = np.divmod(keys, max(1, len(terms)))
                at = 0
                while at < len(texts):  # whole documents up to the shard's size
                    to = min(len(texts), at + shard - n)
                    a, b = np.searchsorted(doc, [at, to])
                    kept.append((ids[row + at : row + to], missing[row + at : row + to], counts[at:to], doc[a:b] - at + n, term[a:b], tf[a:b]))
                    n, at = n + to - at, to
                    if n == shard:
                        yield close()
                        made, n = made + 1, 0
                        kept.clear()
        if n:
            yield close()

    return index


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task's shards hold each term."""
    for batch in batches:
        for terms, held in zip(_column(batch, "terms").to_pylist(), _column(batch, "held").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(terms)), pa.array(unpack(held))], names=["term", "df"])


def _deal(df: np.ndarray, weight: np.ndarray, stages: int) -> np.ndarray:
    """The owner of every term: by rising frequency, owners of about equally many postings; -1 where nothing is added."""
    order = np.argsort(df, kind="stable")
    order = order[weight[order] > 0]
    volume = np.cumsum(df[order])
    owner = np.full(len(df), -1)
    if len(order):
        owner[order] = np.minimum(stages - 1, (volume - df[order]) * stages // max(1, volume[-1]))
    return owner


_LISTS = "shard long, owner int, terms binary, held binary, places binary, added binary"
_LISTS_ARROW = pa.schema([("shard", pa.int64()), ("owner", pa.int32()), *[(c, pa.binary()) for c in ("terms", "held", "places", "added")]])


def lengths(sizes: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """m of every document; numbers beyond 64 bits are worked out whole."""
    if 75 * int(sizes.max(initial=0)) * documents < 2**63:
        return 25 + 75 * sizes * documents // max(1, tokens)
    return np.array([25 + 75 * int(n) * documents // max(1, tokens) for n in sizes], np.int64)


def _owners(shared, documents: int, tokens: int):
    """Cut a shard's postings by owner, with what a posting adds to an item that holds the term once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, owner = shared.value
        for batch in batches:
            for shard, *packed in zip(*(_column(batch, c).to_pylist() for c in ("shard", "sizes", "terms", "held", "places", "tf")), strict=True):
                sizes, terms, held, place, tf = (unpack(x) for x in packed)
                m, term = lengths(sizes, documents, tokens), np.repeat(terms, held)
                added = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
                of, of_list = owner[term], owner[terms]
                for o in np.unique(of_list[of_list >= 0]):
                    a, b = of_list == o, of == o
                    row = [shard, int(o), pack(terms[a]), pack(held[a]), pack(place[b]), pack(added[b])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _LISTS_ARROW.types, strict=True)], schema=_LISTS_ARROW)

    return cut


# -- stages ----------------------------------------------------------------------------------------------------------
_CARRIED = "shard long, items binary, held binary, places binary, scores binary"
_CARRIED_ARROW = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("items", "held", "places", "scores")]])


def _stage(shared, stage: int, k: int, shard: int):
    def visit(carried: pa.Table, lists: pa.Table) -> pa.Table:
        items, owner, rest, least = shared.value
        name = (carried if len(carried) else lists)["shard"][0].as_py()
        mine: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(lists):
            terms, held, place, added = (unpack(lists[c][0].as_py()) for c in ("terms", "held", "places", "added"))
            ends = np.cumsum(held)
            mine = {int(t): (place[a:b], added[a:b]) for t, a, b in zip(terms, ends - held, ends, strict=True)}
        before: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(carried):
            who, held, place, score = (unpack(carried[c][0].as_py()) for c in ("items", "held", "places", "scores"))
            ends = np.cumsum(held)
            before = {int(i): (place[a:b], score[a:b]) for i, a, b in zip(who, ends - held, ends, strict=True)}
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        sums = np.zeros(shard, np.int64)
        for i, (terms, often) in enumerate(items):
            if i in before:
                sums[before[i][0]] = before[i][1]
            for t, q in zip(terms.tolist(), often.tolist(), strict=True):
                if t in mine:
                    sums[mine[t][0]] += q * mine[t][1]
            at = np.flatnonzero(sums)
            if not len(at):
                continue
            score = sums[at]
            sums[at] = 0
            floor = max(1, int(least[i]), int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 1)
            stay = score + rest[stage][i] >= floor
            if stay.any():
                out.append((i, at[stay], score[stay]))
        if not out:
            return _CARRIED_ARROW.empty_table()
        who, place, score = zip(*out, strict=True)
        row = [name, pack(np.array(who)), pack(np.array([len(p) for p in place])), pack(np.concatenate(place)), pack(np.concatenate(score))]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, _CARRIED_ARROW.types, strict=True)], schema=_CARRIED_ARROW)

    return visit


# -- selection -------------------------------------------------------------------------------------------------------
_BEST_ARROW = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _task_best(k: int, named: bool):
    """The k best of every item among a task's shards, by (score, id); without ids only the scores count."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, score, ids, missing = (np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            columns = ("items", "held", "places", "scores") + (("ids", "missing") if named else ())
            for packed in zip(*(_column(batch, c).to_pylist() for c in columns), strict=True):
                who, held, place, got, *known = (unpack(x) for x in packed)
                item, score = np.append(item, np.repeat(who, held)), np.append(score, got)
                ids, missing = (np.append(x, known[j][place] if named else np.zeros(len(place), np.int64)) for j, x in enumerate((ids, missing)))
                order = np.lexsort((ids, missing, -score, item))
                begin = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0])
                rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
                item, score, ids, missing = (x[order[rank < k]] for x in (item, score, ids, missing))
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=missing.astype(bool)), pa.array(score)], schema=_BEST_ARROW)

    return select


def _merged(best: DataFrame, k: int) -> DataFrame:
    """The k best of every item with ``rank``, over tasks: first among about 64 stretches of tasks' lists, then over those."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, stages: int = STAGES, shard: int = SHARD, bundle_terms: int = BUNDLE_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every row of ``items``."""
    spark = docs.sparkSession
    asked = settled(items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).mapInArrow(_item_terms, "id long, n long, terms array<string>").where("n > 0").withColumn("bundle", F.monotonically_increasing_id()), "items")
    bundles = -(-(asked.agg(F.sum("n")).first()[0] or 0) // bundle_terms)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for b in range(bundles):
        bundle = _Bundle(asked.where(F.pmod(F.xxhash64("bundle"), F.lit(bundles)) == b).select("id", "terms").collect())  # about bundle_terms terms
        if bundle.items:
            found.append(_search(spark, texts, bundle, k, stages, shard))
    discard(asked)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(spark: SparkSession, texts: DataFrame, bundle: _Bundle, k: int, stages: int, shard: int) -> DataFrame:
    send = spark.sparkContext.broadcast
    index = settled(texts.mapInArrow(_indexer(send(bundle.vocabulary), shard), _INDEX), "index")
    documents, tokens = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = np.zeros(len(bundle.vocabulary), np.int64)
    for term, n in index.select("terms", "held").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row a term of the bundle
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)
    owner = _deal(df, weight, stages)
    lists = settled(index.mapInArrow(_owners(send((weight, owner)), documents, tokens), _LISTS), "lists")
    # what owners after each stage can add to an item at most
    rest = [[int((often * weight[terms] * _MOST)[owner[terms] > s].sum()) for terms, often in bundle.items] for s in range(stages)]
    least = np.zeros(len(bundle.items), np.int64)
    carried = spark.createDataFrame([], _CARRIED)
    for s in range(stages):
        visit = _stage(send((bundle.items, owner, rest, least)), s, k, shard)
        now = settled(carried.groupBy("shard").cogroup(lists.where(F.col("owner") == s).groupBy("shard")).applyInArrow(visit, _CARRIED), "accumulators")
        if s:
            discard(carried)
        carried = now
        if s < stages - 1:
            best = _merged(carried.mapInArrow(_task_best(k, False), "item long, doc_id long, score long"), k)
            for item, score in best.where(F.col("rank") == k).select("item", "score").collect():  # a row an item of the bundle
                least[item] = score
    named = carried.join(index.select("shard", "ids", "missing"), "shard").mapInArrow(_task_best(k, True), "item long, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(bundle.ids)), "item long, item_id long")
    return settled(_merged(named, k), "best").join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def query_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM i) GROUP BY ALL),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * max(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term),
s AS (SELECT item, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * n) // l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (row), g GROUP BY item, row),
r AS (SELECT item, row, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN i USING (item) JOIN d USING (row) WHERE rank <= 10
"""
