"""Operator 10: exact join of documents whose word-shingle sets are near in the Jaccard metric, and its components.

* Equal sets are folded first, over the whole table: the vertices of the join are distinct sets.
* *First regions.* Documents without a common shingle are at distance one from each other and from any pivot, so pivots alone
  cannot part them. Two sets of similarity 0.8 share one of the first fifth of their shingles in any fixed order of all
  shingles; each such shingle is a region, and a document is replicated to as many regions as its first fifth holds
  shingles. The order puts shingles of many documents last, so that passages that many documents share seldom make
  regions; any order gives the same result.
* *Pivots and Voronoi cells.* A set carries a parity bitmap: bit i is the parity of the number of its shingles with hash i. The
  Hamming distance of two bitmaps is a metric and never exceeds the size of the sets' symmetric difference, and sets of
  sizes n and m that link differ in (n + m) / 9 shingles at most. In a region of more than ``few`` members pivots are chosen,
  every member goes to its nearest pivot's cell, and a document is replicated to each other cell whose distances to its
  pivot its own distance reaches, give or take that radius (triangle inequality). Cells are joined recursively. What is left
  passes tests that no linked pair can fail: sizes, places of the common shingle in the order, Hamming distance.
* *Rounds.* Pairs are measured exactly by their sets. A region's first round measures every member with its nearest partners,
  or its nearest pivot, so that groups of near copies come together by stars and not by all their pairs. Later rounds look at
  the regions that held more candidates, and there only at members of different components, eight times as many each
  round, until no candidate is left. No candidate is capped or dropped.

Cases: null text, or text without words, has no shingles and links with nothing; fewer words than a shingle make one
shingle of the whole sequence; rows that share a doc_id are one vertex of ``component_id`` and several of ``class_id``, which
joins sets alone; rows with a null id are only counted; repeated rows fold; an empty table gives an empty result; further
columns are ignored. Shingles and sets go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm import _kernels as k
from strandloom.llm._shared import discard, keyed_text, settled, table
from strandloom.llm.components import components

U = np.uint64
#: A member's bitmap: 512 bits, by 64. Sets of up to some 1100 shingles fill them so little that unlike ones stay apart.
_BITS = [f"bits{i}" for i in range(8)]
_SIGN = "doc_id long, text_key long, n_shingles long, set_key long, " + ", ".join(f"{b} long" for b in _BITS) + ", wide binary, code long, seen long"
_PAIR = "region long, a long, b long"


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


@dataclass(frozen=True)
class JaccardJoin:
    """``words``: shingle length; ``percent``: least similarity; ``few``: members up to which a region is looked at pair by
    pair; ``crowd``: members of a region in one task; ``first``: partners of a member in its first round; ``frequent``: how
    often a shingle must occur within ``chunk`` shingles to be counted as frequent, and ``ranked`` the number of most frequent
    ones that the order knows (both only change which regions exist, not the result)."""

    words: int = 5
    percent: int = 80
    few: int = 48
    crowd: int = 8192
    first: int = 3
    frequent: int = 4
    chunk: int = 1 << 20
    ranked: int = 1 << 17

    # -- sets -----------------------------------------------------------------------------------------------------
    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, sorted distinct shingle codes) of each text."""
        for row, data, bounds in k.text_slices(column):
            _, _, codes, at = k.words(data, bounds, k.BLANKS, k.LOWER)
            rolling = k.Rolling(codes)
            grams = rolling.windows(self.words)
            few = rolling.stretches(at[:-1], at[1:])
            for i in range(len(bounds) - 1):
                n = at[i + 1] - at[i]
                if n >= self.words:
                    s = np.sort(grams[at[i] : at[i + 1] - self.words + 1])
                    yield row + i, s[np.append(True, s[1:] != s[:-1])]
                else:
                    yield row + i, few[i : i + 1] ^ U(0x6A09E667F3BCC909) if n else few[:0]

    @staticmethod
    def set_key(s: np.ndarray) -> int:
        both = np.array([s.sum(dtype=U), k.mix(s ^ U(0x3C6EF372FE94F82B)).sum(dtype=U)], U)
        return int(k.mix(both[:1] ^ k.mix(both[1:] + U(len(s)))).view(np.int64)[0])

    @staticmethod
    def parity(s: np.ndarray) -> np.ndarray:
        """A set's bitmap as bytes: two bits or more a shingle, 512 to 16384 in all. A longer one folds to a shorter one."""
        size = 1 << min(14, max(9, int(2 * len(s) - 1).bit_length()))
        return np.packbits(np.bincount((s & U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little")

    def signs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow: each row's number of shingles, set key and parity bitmap; and rows (code, seen) for shingles that are
        frequent within some ``chunk`` shingles."""
        names = [x.split()[0] for x in _SIGN.split(", ")]
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch | None:
            codes = np.sort(np.concatenate(held))
            begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            seen = np.diff(np.append(begin, len(codes)))
            often = seen >= self.frequent
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none] * (4 + len(_BITS)) + [pa.nulls(len(none), pa.binary()), _longs(codes[begin][often]), pa.array(seen[often])], names=names)

        for batch in batches:
            ids, keys, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key", "text"))
            n, key = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
            bits, wide = np.zeros((len(text), 8 * len(_BITS)), np.uint8), [None] * len(text)
            for row, s in self.sets(text):
                n[row] = len(s)
                if len(s):
                    key[row] = self.set_key(s)
                    full = self.parity(s)
                    wide[row], bits[row] = full.tobytes(), np.bitwise_xor.reduce(full.reshape(-1, 8 * len(_BITS)))
                    held.append(s)
                    size += len(s)
                if size >= self.chunk:
                    yield frequent()
                    held, size = [], 0
            none = pa.nulls(len(text), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n), pa.array(key), *(pa.array(x) for x in np.ascontiguousarray(bits.view(np.int64).T)), pa.array(wide, pa.binary()), none, none], names=names)
        if held:
            yield frequent()

    # -- first regions --------------------------------------------------------------------------------------------
    def prefixes(self, sent) -> Callable:
        """mapInArrow: (region, part, set_key, n, place) for the first fifth of each set's shingles, once a partition."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, counts = (np.frombuffer(x, t) for x, t in zip(sent.value, (U, np.int64), strict=True))
            maybe = np.zeros(1 << 20, bool)
            maybe[(codes >> U(44)).astype(np.int64)] = True
            seen: set[int] = set()
            names = ["region", "part", "set_key", "n", "place"]

            def flush(held: list) -> pa.RecordBatch:
                region, part, key, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
                place = np.concatenate([np.arange(len(x[0])) for x in held])
                return pa.RecordBatch.from_arrays([_longs(region), pa.array(part, pa.int32()), pa.array(key), pa.array(n, pa.int32()), pa.array(place, pa.int32())], names=names)

            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for batch in batches:
                known = np.asarray(batch.column(batch.schema.get_field_index("doc_id")).is_valid())
                for row, s in self.sets(batch.column(batch.schema.get_field_index("text"))):
                    n = len(s)
                    if n < 2 or not known[row] or (key := self.set_key(s)) in seen:
                        continue  # sets of one shingle link with equal ones only
                    seen.add(key)
                    count = np.zeros(n, np.int64)
                    some = np.flatnonzero(maybe[(s >> U(44)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(codes, s[some]), max(len(codes) - 1, 0))
                    if len(codes):
                        count[some] = np.where(codes[at] == s[some], counts[at], 0)
                    many = n - (self.percent * n + 99) // 100 + 1
                    first = np.argsort(count, kind="stable")[:many]
                    parts = count[first] // self.crowd + 1
                    part = np.where(parts > 1, (key & 0x7FFFFFFF) % parts + 1, 0)
                    held.append((s[first], part, np.full(many, key), np.full(many, n)))
                    size += many
                    if size > 50_000:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

        return go

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow over rows sorted by region, part and set: each set once a region, without regions of one set
        (but for parts of a region). Only one row is remembered between batches."""
        waiting: pa.RecordBatch | None = None  # the only set so far of the group that the last batch ended in
        going_on: tuple | None = None  # else: that group and its last set, which has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            region, part, key = (np.asarray(rows.column(i)) for i in range(3))
            other = np.append(True, (region[1:] != region[:-1]) | (part[1:] != part[:-1]))
            fresh = other | np.append(True, key[1:] != key[:-1])
            group = np.cumsum(other) - 1
            continued = going_on is not None and going_on[:2] == (region[0], part[0])
            if continued:
                fresh[0] = key[0] != going_on[2]
            several = (np.bincount(group, weights=fresh) > 1) | (part[other] > 0)
            several[0] |= continued
            keep = fresh & several[group]
            if keep.any():
                yield rows.filter(pa.array(keep))
            if several[-1]:
                waiting, going_on = None, (region[-1], part[-1], key[-1])
            else:
                waiting, going_on = rows.slice(int(np.flatnonzero(other)[-1]), 1), None

    # -- candidates inside a region -------------------------------------------------------------------------------
    def common(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Shingles that linked sets of these sizes share at least."""
        return (self.percent * (n + m) + 99 + self.percent) // (100 + self.percent)

    def may_link(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether members i and j (arrays that broadcast) pass the tests that no linked pair fails, and their distance."""
        n, m = x["n"][i], x["n"][j]
        need = self.common(n, m)
        most = np.minimum(n - x["place"][i], m - x["place"][j])  # if this is the first shingle that they share
        ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent) & (most >= need) & (x["label"][i] != x["label"][j])
        far = sum(np.bitwise_count(x["bits"][i, c] ^ x["bits"][j, c]).astype(np.int64) for c in range(x["bits"].shape[1]))
        return ok & (far <= n + m - 2 * need), far

    def by_pairs(self, x: dict[str, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All candidate pairs within small groups of consecutive rows."""
        found = [(np.zeros(0, np.int64),) * 3]
        i = np.arange(len(group))
        for lag in range(1, self.few):
            i = i[i + lag < len(group)]
            i = i[group[i] == group[i + lag]]
            if not len(i):
                break
            ok, far = self.may_link(x, i, i + lag)
            found.append((i[ok], i[ok] + lag, far[ok]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def distances(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(x["bits"][i, c][:, None] ^ x["bits"][j, c][None, :]).astype(np.int32) for c in range(x["bits"].shape[1]))

    def by_pivots(self, x: dict[str, np.ndarray], members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each member with its nearest pivot among as many as the root of their number."""
        pivots = members[:: max(1, int(np.sqrt(len(members))))]
        near = np.concatenate([pivots[self.distances(x, part, pivots).argmin(1)] for part in np.array_split(members, len(members) * len(pivots) // (1 << 20) + 1)])
        ok, far = self.may_link(x, members, near)
        return members[ok], near[ok], far[ok]

    def by_cells(self, x: dict[str, np.ndarray], guests: np.ndarray, members: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each guest with its candidates among the members, of each cell or block the nearest ``limit`` + 1."""
        if not len(guests) or not len(members):
            return
        pivots = members[:: len(members) // 32 + 1]
        if len(guests) * len(members) > 1 << 20 and len(pivots) > 1:
            far = self.distances(x, members, pivots)
            cell, radius = far.argmin(1), x["n"][guests] * (100 - self.percent) // self.percent + 1
            reach = self.distances(x, guests, pivots)
            sizes = np.bincount(cell, minlength=len(pivots))
            if sizes.max() < 0.9 * len(members):
                for c in np.flatnonzero(sizes):
                    own = cell == c
                    low, high = far[own, c].min(), far[own, c].max()
                    visit = (reach[:, c] - radius <= high) & (reach[:, c] + radius >= low)
                    yield from self.by_cells(x, guests[visit], members[own], limit)
                return
        for part in np.array_split(guests, len(guests) * len(members) // (1 << 20) + 1):
            ok, far = self.may_link(x, part[:, None], members[None, :])
            ok &= x["key"][part][:, None] != x["key"][members][None, :]
            i, j = np.nonzero(ok)
            yield self.nearest(x, part[i], members[j], far[i, j], limit + 1)[:3]

    @staticmethod
    def nearest(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, far: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
        """The pairs that are among the nearest ``limit`` of i, and the i that have more."""
        order = np.lexsort((x["key"][j], far, i))
        i, j, far = i[order], j[order], far[order]
        begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
        rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
        keep = rank < limit
        return i[keep], j[keep], far[keep], i[~keep]

    def candidates(self, limit: int, stars: bool) -> Callable:
        """mapInArrow over members sorted by region and part: (region, a, b) to measure; (region, null, null) for regions with
        more candidates than the nearest ``limit`` of each member."""

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            x = {c: np.asarray(t.column(c)).astype(np.int64) for c in ("region", "part", "n", "place", "label", "guest")}
            x["key"] = np.asarray(t.column("set_key")).astype(np.int64)
            x["bits"] = np.stack([np.asarray(t.column(c)).astype(np.int64).view(U) for c in _BITS], 1)
            fresh = np.append(True, (np.diff(x["region"]) != 0) | (np.diff(x["part"]) != 0))
            group = np.cumsum(fresh) - 1
            sizes = np.bincount(group)
            small = np.flatnonzero(sizes[group] <= self.few)
            sub = {c: v[small] for c, v in x.items()}
            i, j, far = self.by_pairs(sub, group[small])
            i, j = small[i], small[j]
            i, j, far, more = self.nearest(x, np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far]), limit)
            pairs, still = [(i, j)], [x["region"][more], x["region"][(x["part"] > 0) & stars]]
            begin = np.append(np.flatnonzero(fresh), len(group))
            for g in np.flatnonzero(sizes > self.few):
                rows = np.arange(begin[g], begin[g + 1])
                if stars:
                    pairs.append(self.by_pivots(x, rows)[:2])
                    still.append(x["region"][rows[:1]])
                    continue
                guests, members = rows[x["guest"][rows] == 1], rows[x["guest"][rows] == 0]
                if found := list(self.by_cells(x, guests, members, limit)):
                    i, j, _, more = self.nearest(x, *(np.concatenate(c) for c in zip(*found, strict=True)), limit)
                    pairs.append((i, j))
                    still.append(x["region"][more])
            i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
            a, b = np.maximum(x["key"][i], x["key"][j]), np.minimum(x["key"][i], x["key"][j])
            order = np.lexsort((b, a))
            order = order[np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[: len(order)]]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(order), pa.int64()), pa.array(a[order]), pa.array(b[order])], names=["region", "a", "b"])
            still = np.unique(np.concatenate(still))
            if len(still):
                yield pa.RecordBatch.from_arrays([pa.array(still), *[pa.nulls(len(still), pa.int64())] * 2], names=["region", "a", "b"])

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) < 20_000:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                region, part = np.asarray(t.column("region")), np.asarray(t.column("part"))
                other = np.flatnonzero((region != region[-1]) | (part != part[-1]))
                whole = int(other[-1]) + 1 if len(other) else 0  # rows before the last group, which may go on
                if whole:
                    yield from work(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
            if held and sum(b.num_rows for b in held):
                yield from work(pa.Table.from_batches(held).combine_chunks())

        return go

    def sift(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow over pairs: those that the Hamming distance of their whole bitmaps allows."""
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            n, m = (np.asarray(get(c)).astype(np.int64) for c in ("n_a", "n_b"))
            spare = n + m - 2 * self.common(n, m)
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(get("wide_a"), get("wide_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (a, b))
                size = min(len(x), len(y))
                both = np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))
                keep[i] = np.bitwise_count(both).sum() <= spare[i]
            yield pa.RecordBatch.from_arrays([get("a").filter(pa.array(keep)), get("b").filter(pa.array(keep))], names=["a", "b"])

    # -- measuring ------------------------------------------------------------------------------------------------
    def wanted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow over texts: (set_key, codes), each set once a partition."""
        seen: set[int] = set()
        for batch in batches:
            keys, codes, size = [], [], 0
            for _, s in self.sets(batch.column(batch.schema.get_field_index("text"))):
                if len(s) and (key := self.set_key(s)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    codes.append(s.astype("<u8").tobytes())
                    size += 8 * len(s)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.binary())], names=["set_key", "codes"])
                    keys, codes, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.binary())], names=["set_key", "codes"])

    def measure(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow: which pairs link, by the exact sizes of intersection and union of their sets."""
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            linked = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(get("codes_a"), get("codes_b"), strict=True)):
                merged = np.concatenate([np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")])
                merged.sort(kind="stable")
                both = int((merged[1:] == merged[:-1]).sum())
                linked[i] = both * 100 >= (len(merged) - both) * self.percent
            yield pa.RecordBatch.from_arrays([get("a"), get("b"), pa.array(linked)], names=["a", "b", "linked"])

    def measured(self, texts: DataFrame, signs: DataFrame, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of distinct pairs; only sets that some pair needs are made."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        ids = signs.where("n_shingles > 1 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).join(needed, "set_key").select("doc_id").distinct()
        sets = settled(texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(self.wanted, "set_key long, codes binary"), "sets")
        one = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("codes").alias("codes_a")), "a")
        two = one.join(sets.select(F.col("set_key").alias("b"), F.col("codes").alias("codes_b")), "b")
        out = settled(two.select("a", "b", "codes_a", "codes_b").mapInArrow(self.measure, "a long, b long, linked boolean"), "measured")
        discard(sets)
        return out

    # -- plan -----------------------------------------------------------------------------------------------------
    def members(self, texts: DataFrame, signs: DataFrame, bits: DataFrame) -> DataFrame:
        """(region, part, set_key, n, place, bitmap) of the first regions that hold several sets."""
        often = signs.where("code is not null").groupBy("code").agg(F.sum("seen").alias("seen"))
        often = often.orderBy(F.desc("seen"), "code").limit(self.ranked).collect()  # a ranking of fixed length
        often = sorted(((r["code"] & (1 << 64) - 1, r["seen"]) for r in often))
        sent = texts.sparkSession.sparkContext.broadcast((np.array([c for c, _ in often], U).tobytes(), np.array([n for _, n in often], np.int64).tobytes()))
        schema = "region long, part int, set_key long, n int, place int"
        rows = texts.select("doc_id", "text").mapInArrow(self.prefixes(sent), schema)
        rows = rows.repartition("region", "part").sortWithinPartitions("region", "part", "set_key").mapInArrow(self.gather, schema)
        rows = settled(rows, "regions")
        out = settled(rows.join(bits.select("set_key", *_BITS), "set_key").select(*rows.columns, *_BITS), "members")
        discard(rows)
        return out

    def look(self, rows: DataFrame, bits: DataFrame, limit: int, stars: bool) -> tuple[DataFrame, DataFrame]:
        """(pairs to measure, regions still open)."""
        columns = ["region", "part", "set_key", "n", "place", "label", "guest", *_BITS]
        found = settled(rows.select(*columns).repartition("region", "part").sortWithinPartitions("region", "part", "set_key").mapInArrow(self.candidates(limit, stars), _PAIR), "candidates")
        pairs = found.where("a is not null").select("a", "b").distinct()
        for c in ("a", "b"):
            pairs = pairs.join(bits.select(F.col("set_key").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")), c)
        pairs = settled(pairs.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(self.sift, "a long, b long"), "pairs")
        return pairs, found.where("region is not null").select("region").distinct()

    def apart(self, members: DataFrame, still: DataFrame, label: DataFrame) -> DataFrame:
        """The members, with their component as ``label``, of open regions that hold several components. A region of more
        than ``crowd`` members is dealt over parts, and those outside its largest component visit every part as guests."""
        named = members.drop("part").join(still, "region").join(label.select(F.col("node").alias("set_key"), F.col("component").alias("label")), "set_key", "left")
        named = settled(named.withColumn("label", F.coalesce("label", "set_key")), "named")
        shares = named.groupBy("region", "label").agg(F.count(F.lit(1)).alias("share")).groupBy("region")
        shares = shares.agg(F.sum("share").alias("members"), F.max_by("label", "share").alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        shares = settled(shares.select("region", "members", "top"), "shares")
        sized = named.join(shares, "region").withColumn("parts", F.ceil(F.col("members") / self.crowd).cast("int"))
        own = sized.withColumn("part", F.pmod(F.xxhash64("set_key"), "parts").cast("int")).withColumn("guest", F.lit(0))
        guests = sized.where((F.col("label") != F.col("top")) & (F.col("members") > self.few)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("guest", F.lit(1))
        return own.unionByName(guests)

    def links(self, texts: DataFrame, signs: DataFrame) -> DataFrame:
        """(node, component) over set keys that some other set links with."""
        one = [F.first(c).alias(c) for c in ("wide", *_BITS)]
        bits = settled(signs.where("n_shingles > 1").groupBy("set_key").agg(F.first("n_shingles").alias("n"), *one), "bitmaps")
        members = self.members(texts, signs, bits)
        limit = self.first
        pairs, still = self.look(members.withColumns({"label": F.col("set_key"), "guest": F.lit(0)}), bits, limit, stars=True)
        tested = self.measured(texts, signs, pairs)
        label = components(tested.where("linked").select("a", "b"))
        while still.take(1):
            limit *= 8
            pairs, still = self.look(self.apart(members, still, label), bits, limit, stars=False)
            pairs = settled(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            if pairs.take(1):
                more = self.measured(texts, signs, pairs)
                tested = tested.unionByName(more)
                if more.where("linked").take(1):
                    label = components(tested.where("linked").select("a", "b"))
        discard(members, bits)
        return label

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        texts = keyed_text(docs, id_col, text_col)
        rows = settled(texts.mapInArrow(self.signs, _SIGN), "signs")
        signs = rows.where("n_shingles is not null")
        label = settled(self.links(texts, rows), "label").select(F.col("node").alias("set_key"), F.col("component").alias("root"))
        named = signs.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_key").distinct().join(label, "set_key", "left")
        classes = settled(named.select("doc_id", "set_key", F.coalesce("root", "set_key").alias("class_id")), "classes")
        least = classes.groupBy("class_id").agg(F.min("doc_id").alias("least"))
        lows = settled(classes.join(least, "class_id").select("doc_id", "least").distinct(), "least")
        found = lows.select("doc_id", F.col("least").alias("component_id"))
        if lows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):  # classes that share an id
            joined = components(lows.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
            found = joined.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
        out = signs.select("doc_id", "text_key", "n_shingles", "set_key")
        out = out.join(classes.select("set_key", "class_id").distinct(), "set_key", "left").join(found, "doc_id", "left")
        component = F.coalesce("component_id", "doc_id").alias("component_id")
        return out.select("doc_id", "n_shingles", component, "text_key", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: JaccardJoin | None = None) -> DataFrame:
    """Components of documents linked at Jaccard similarity ``percent`` or more; see the module for method and cases.

    Returns doc_id, n_shingles, component_id (least doc_id), text_key (``xxhash64`` of the text) and class_id (a number
    that rows of linked sets share; null without shingles), one row for each row of ``docs``.
    """
    return (join or JaccardJoin()).apply(docs, id_col, text_col)


def query_op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
