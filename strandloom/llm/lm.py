"""Language-model scores of whole texts by a weighted backoff automaton.

States are the n-grams of up to ``order - 1`` tokens seen in training, and the empty one. A state has an arc for each token seen
after it, weighted by the smoothed log-probability, and a failure arc to its own longest proper suffix, weighted by the mass that
smoothing leaves to unseen tokens. A text is read once from left to right from the empty state: each token takes the arc of
the state that it finds, or failure arcs until one is found; weights add up.

Smoothing is hierarchical: with c(s) occurrences of a state and c(s, w) of a token after it,
p(w | s) = (c(s, w) + strength * p(w | suffix of s)) / (c(s) + strength), and at the empty state (c(w) + 0.5) / (N + 0.5 (V + 1)),
where one unknown type takes all tokens without a count. So the failure arc of s weighs strength / (c(s) + strength).

The automaton grows with the corpus and is never in one place. Texts are written once as blocks of token codes. Level by level a
block asks for its distinct n-grams: they go, with their training counts in the block, to buckets by a hash of (state, word); a
bucket adds the counts of equal n-grams, numbers them, and answers every block that asked. Numbers of one level are the states of
the next. A frequent n-gram comes once a block, whatever the text; a frequent state's n-grams are spread over all buckets. Then
each block holds the part of the automaton that its texts can reach, and reads them. Words are compared as strings, n-grams as
pairs of numbers: no hash decides a result.

Defined results. A null text is empty: its end token alone. A null id is in training and not held out. Repeated rows count and are
returned as often as they stand there. Without training text every token has probability 1 at the empty state. An empty table
gives no rows. Further columns are not read. A text of any length is read whole; it is never cut over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.llm._shared import settled, table
from strandloom.llm._words import pack, slices, split, unpack

SEPARATORS = r"[\x20\x09-\x0D]+"
#: Stands for the end of a text; no word holds a blank.
END = " "
#: Tokens after which a block closes: what one task holds at a time.
BLOCK_TOKENS = 1 << 20
STRENGTH = 30.0


# -- blocks ----------------------------------------------------------------------------------------------------------
_BLOCK = "block long, n_tokens long, ids binary, missing binary, held binary, lengths binary, tokens binary, words array<string>, hashes binary, counts binary"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("ids", "missing", "held", "lengths", "tokens")], ("words", pa.list_(pa.string())), ("hashes", pa.binary()), ("counts", pa.binary())])


class _Blocks:
    """Collects slices of texts into blocks."""

    def __init__(self, limit: int):
        self.limit, self.part, self.made = limit, TaskContext.get().partitionId(), 0
        self.clear()

    def clear(self) -> None:
        self.dictionaries, self.codes, self.lengths, self.n = [pa.array([END], pa.large_string())], [], [], 0
        self.ids, self.missing, self.held = [], [], []

    def add(self, texts: pa.Array, ids: np.ndarray, missing: np.ndarray, held: np.ndarray) -> None:
        flat, counts = split(texts, SEPARATORS)
        coded = flat.dictionary_encode()
        ends = np.cumsum(counts) + np.arange(len(counts))
        codes = np.full(len(flat) + len(counts), -1, np.int64)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
        self.dictionaries.append(coded.dictionary)
        self.codes.append(codes)
        self.lengths.append(counts + 1)
        self.ids.append(ids)
        self.missing.append(missing)
        self.held.append(held)
        self.n += len(codes)

    def close(self) -> pa.RecordBatch:
        merged = pa.chunked_array(self.dictionaries).combine_chunks().dictionary_encode()
        to = merged.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, tokens = 1, []
        for codes, dictionary in zip(self.codes, self.dictionaries[1:], strict=True):
            tokens.append(to[np.where(codes < 0, 0, at + codes)])
            at += len(dictionary)
        tokens, lengths, ids, missing, held = (np.concatenate(x) for x in (tokens, self.lengths, self.ids, self.missing, self.held))
        words = merged.dictionary.cast(pa.string())
        hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) >> np.uint64(33)
        counts = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(words))
        row = [
            pa.array([(self.part << 32) + self.made]), pa.array([len(tokens)]),
            *[pa.array([pack(x)], pa.binary()) for x in (ids, missing, held, lengths, tokens)],
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([pack(hashes.astype(np.int64))], pa.binary()), pa.array([pack(counts)], pa.binary()),
        ]
        self.made += 1
        self.clear()
        return pa.RecordBatch.from_arrays(row, schema=_BLOCK_ARROW)


def _encoder(limit: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(limit)
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            ids, missing = column("doc_id").fill_null(0).to_numpy(), column("doc_id").is_null().to_numpy(zero_copy_only=False)
            held = column("held").to_numpy(zero_copy_only=False)
            for row, texts in slices(column("text")):
                blocks.add(texts, *(x[row : row + len(texts)] for x in (ids, missing, held)))
                if blocks.n >= limit:
                    yield blocks.close()
        if blocks.n:
            yield blocks.close()

    return encode


# -- asking and answering --------------------------------------------------------------------------------------------
def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, kept inside one; buckets; where each begins, and the end)."""
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return order, found, np.append(begin, len(bucket))


def _word_requests(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, hashes, counts in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("block", "words", "hashes", "counts")), strict=True):
                order, found, bounds = _by_bucket(unpack(hashes.as_py()) % buckets)
                sorted_words, sorted_counts = words.values.take(pa.array(order)), unpack(counts.as_py())[order]
                many = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array([block.as_py()] * many, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), sorted_words), pa.array([pack(sorted_counts[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())],
                    names=["bucket", "block", "words", "counts"],
                )

    return ask


_ANSWER = "bucket long, block long, level int, numbers binary, counts binary, types long, tokens long"
_ANSWER_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("numbers", pa.binary()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])


def _answers(bucket: int, blocks: list[int], level: int, sizes: list[int], place: np.ndarray, counts: np.ndarray, numbered: bool = True) -> pa.Table:
    """What each block gets back: places of its n-grams among the bucket's, and their counts over all blocks."""
    sums = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    np.add.at(sums, place, counts)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    parts = [place[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    first = np.arange(len(blocks)) == 0
    return pa.Table.from_arrays(
        [
            pa.array([bucket] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array([level] * len(blocks), pa.int32()),
            pa.array([pack(p, level > 1) if numbered else None for p in parts], pa.binary()), pa.array([pack(sums[p]) for p in parts], pa.binary()),
            pa.array(np.where(first, (sums > 0).sum(), 0)), pa.array(np.where(first, sums.sum(), 0)),
        ],
        schema=_ANSWER_ARROW,
    )


def _word_owner(group: pa.Table) -> pa.Table:
    group = group.sort_by("block")
    words = group["words"].combine_chunks()
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    counts = np.concatenate([unpack(x) for x in group["counts"].to_pylist()])
    sizes = np.diff(words.offsets.to_numpy()).tolist()
    return _answers(group["bucket"][0].as_py(), group["block"].to_pylist(), 1, sizes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)


def _distinct(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of every pair among the distinct pairs in their order."""
    span = int(word.max(initial=0)) + 1
    if (int(state.max(initial=0)) + 1) * span < 2**63:
        return np.unique(state * span + word, return_inverse=True)[1]
    order = np.lexsort((word, state))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(state[order]) != 0) | (np.diff(word[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return place


def _gram_owner(level: int, numbered: bool):
    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        state, word = ([unpack(x, c == "state") for x in group[c].to_pylist()] for c in ("state", "word"))
        counts = np.concatenate([unpack(x) for x in group["counts"].to_pylist()])
        place = _distinct(np.concatenate(state), np.concatenate(word))
        return _answers(group["bucket"][0].as_py(), group["block"].to_pylist(), level, [len(s) for s in state], place, counts, numbered)

    return answer


def _spread(state: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    x = state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


class _View:
    """One block and what it has been told: for every token and level, the count of the n-gram that ends there."""

    def __init__(self, block: pa.Table, told: pa.Table, buckets: int):
        get = lambda c: block[c][0].as_py()
        self.buckets, self.lengths = buckets, unpack(get("lengths"))
        self.tokens, self.hashes = unpack(get("tokens")), unpack(get("hashes"))
        begin = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.depth = np.arange(len(self.tokens)) - begin
        self.train = ~np.repeat(unpack(get("held")).astype(bool), self.lengths)
        self.rows: dict[int, list] = {}
        for row in told.select(["level", "bucket", "numbers", "counts"]).sort_by("bucket").to_pylist():
            self.rows.setdefault(row["level"], []).append(row)
        order = _by_bucket(self.hashes % buckets)[0]
        self.numbers, counts = self._hear(1, order)
        self.word_numbers = self.numbers
        #: counts[k]: by token, of the (k + 1)-gram that ends there; 0 where it was not seen in training
        self.counts, self.local = [counts[self.tokens]], self.tokens
        for level in range(2, max(self.rows) + 1):
            self._grams()
            self.numbers, counts = self._hear(level, self.order)
            self._settle(counts)

    def _hear(self, level: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        at = 0
        for row in self.rows.get(level, ()):
            got = unpack(row["counts"])
            counts[order[at : at + len(got)]] = got
            if row["numbers"] is not None:
                numbers[order[at : at + len(got)]] = unpack(row["numbers"], level > 1) * self.buckets + row["bucket"]
            at += len(got)
        return numbers, counts

    def _grams(self) -> None:
        """The next level's distinct n-grams: those whose first and last tokens each leave an n-gram seen in training."""
        level, seen = len(self.counts), self.counts[-1] > 0
        ok = self.depth >= level
        ok[1:] &= seen[1:] & seen[:-1]
        self.at = np.flatnonzero(ok)
        span = len(self.word_numbers)
        keys, self.inverse = np.unique(self.local[self.at - 1] * span + self.tokens[self.at], return_inverse=True)
        self.state, self.word = self.numbers[keys // span], self.word_numbers[keys % span]
        by_state = np.argsort(self.state, kind="stable")
        bucket = _spread(self.state[by_state], self.word[by_state], self.buckets)
        order, self.found, self.bounds = _by_bucket(bucket)
        self.order = by_state[order]

    def _settle(self, counts: np.ndarray) -> None:
        own, local = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        own[self.at], local[self.at] = counts[self.inverse], self.inverse
        self.counts.append(own)
        self.local = local

    def request(self) -> dict[str, list]:
        self._grams()
        counts = np.bincount(self.inverse[self.train[self.at]], minlength=len(self.order))[self.order]
        state, word = self.state[self.order], self.word[self.order]
        pairs = list(zip(self.bounds, self.bounds[1:], strict=False))
        return {"bucket": self.found.tolist(), "state": [pack(state[a:b], True) for a, b in pairs], "word": [pack(word[a:b]) for a, b in pairs], "counts": [pack(counts[a:b]) for a, b in pairs]}

    def read(self, total: int, types: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
        """By token: log10 probability at the empty state, and what the automaton adds as the token is read.

        The state before a token is the longest suffix of the text so far that was seen, up to the order; the reading of all
        tokens of the block goes level by level, as the state left by each token is known from the counts."""
        p = (self.counts[0] + 0.5) / (total + 0.5 * (types + 1))
        base = np.log10(p)
        arcs, fails, states = [base], [None], [None]
        for level in range(1, len(self.counts)):
            state = np.zeros(len(p), np.int64)
            state[1:] = np.where(self.depth[1:] >= level, self.counts[level - 1][:-1], 0)
            p = np.where(state > 0, (self.counts[level] + strength * p) / (state + strength), p)
            arcs.append(np.log10(p))
            fails.append(np.log10(strength / (state + strength)))
            states.append(state)
        added, open_ = np.zeros(len(p)), np.ones(len(p), bool)
        for level in range(len(self.counts) - 1, 0, -1):
            there = open_ & (states[level] > 0)
            taken = there & (self.counts[level] > 0)
            added[taken] += arcs[level][taken]
            added[there & ~taken] += fails[level][there & ~taken]
            open_ &= ~taken
        added[open_] += base[open_]
        return base, added


_REQUEST = "bucket long, block long, state binary, word binary, counts binary"
_REQUEST_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("state", pa.binary()), ("word", pa.binary()), ("counts", pa.binary())])
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORE_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, held: Column, order: int = 3, strength: float = STRENGTH, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``; the model is learnt from the
    rows where ``held`` is not true. ``order``: tokens of the longest n-gram; ``strength``: what a state lends to its suffix."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = settled(texts.mapInArrow(_encoder(block_tokens), _BLOCK), "lm-blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-tokens // block_tokens))
    words = blocks.select("block", "words", "hashes", "counts").mapInArrow(_word_requests(buckets), "bucket long, block long, words array<string>, counts binary")
    told = [settled(words.groupBy("bucket").applyInArrow(_word_owner, _ANSWER), "lm-words")]
    types, total = told[0].agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    plain = blocks.select("block", "ids", "missing", "held", "lengths", "tokens", "hashes")

    def meet(f, schema: str) -> DataFrame:
        all_told = told[0]
        for more in told[1:]:
            all_told = all_told.unionByName(more)
        return plain.groupBy("block").cogroup(all_told.groupBy("block")).applyInArrow(f, schema)

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        got = _View(block, answers, buckets).request()
        got["block"] = [block["block"][0].as_py()] * len(got["bucket"])
        return pa.table(got, schema=_REQUEST_ARROW)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        view = _View(block, answers, buckets)
        base, added = view.read(total, types, strength)
        begin = np.cumsum(view.lengths) - view.lengths
        ids, missing, held_out = (unpack(block[c][0].as_py()) for c in ("ids", "missing", "held"))
        per_text = lambda x: np.add.reduceat(x, begin)
        return pa.Table.from_arrays(
            [pa.array(ids, mask=missing.astype(bool)), pa.array(held_out.astype(bool)), pa.array(view.lengths), pa.array(per_text((view.counts[0] > 0).astype(np.int64))), pa.array(np.full(len(ids), total, np.int64)), pa.array(per_text(base)), pa.array(per_text(added))],
            schema=_SCORE_ARROW,
        )

    for level in range(2, order + 1):
        told.append(settled(meet(ask, _REQUEST).groupBy("bucket").applyInArrow(_gram_owner(level, level < order), _ANSWER), "lm-grams"))
    return meet(score, _SCORE)


def query_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return score_texts(table(spark, sf_dir, "documents"), held)
