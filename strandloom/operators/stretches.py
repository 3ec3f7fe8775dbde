"""Stretches of rows inside one task: where a stretch ends, its mean and its nearest gene, for batches of draws that follow the rows of
their block in a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: What is known of a draw: with its stretch (``block`` null), or on its way to the block where the stretch ends.
FOUND = "replicate int, locus long, attempt int, mean_score double, distance double, number long, block int, far struct<goal long, close long, d0 long, w0 double, low double, high double>"
_FAR = pa.struct([("goal", pa.int64()), ("close", pa.int64()), ("d0", pa.int64()), ("w0", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])


def first_reaching(values: np.ndarray, low: np.ndarray, high: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The first place from ``low`` to before ``high`` whose value is ``goal`` or more, else ``high``; values rise there."""
    while (within := low < high).any():
        middle = np.where(within, (low + high) >> 1, 0)
        short = within & (values[middle] < goal)
        low, high = np.where(short, middle + 1, low), np.where(within & ~short, middle, high)
    return high


class Least:
    """The place of the least value of any stretch, from minima over 2^k places; of equal values the first, NaN is no value."""

    def __init__(self, values: np.ndarray):
        self.order, self.n = np.argsort(values, kind="stable"), len(values)
        rank = np.empty(self.n, np.int32)
        rank[self.order] = np.arange(self.n)
        rank[np.isnan(values)] = self.n
        self.levels = [rank]

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each stretch ``low`` .. ``high``; -1 without a value."""
        k, out = np.frexp(high - low + 1)[1] - 1, np.full(len(low), -1)
        for level in np.unique(k).tolist():
            while len(self.levels) <= level:
                half = 1 << (len(self.levels) - 1)
                self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))
            of = np.flatnonzero(k == level)
            rank = np.minimum(self.levels[level][low[of]], self.levels[level][high[of] - (1 << level) + 1])
            some = rank < self.n
            out[of[some]] = self.order[rank[some]]
        return out


class Rows:
    """The rows of one block in order of their numbers."""

    def __init__(self, parts: list[pa.StructArray]):
        table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(p) for p in parts])
        by = np.argsort(table["number"].to_numpy())
        self.number, self.start, self.end, self.close, self.d0, self.d1, self.w0, self.w1, self.distance = (table[c].to_numpy()[by] for c in ("number", "start", "end", "close", "d0", "d1", "w0", "w1", "distance"))
        self.least = Least(self.distance)

    def closing(self, close: np.ndarray) -> np.ndarray:
        """The last place of a run in this block."""
        return np.searchsorted(self.number, close, "right") - 1


class Blocks:
    """All blocks, a row each: its first number, the end of its last row, its nearest gene (distance, number)."""

    def __init__(self, block: list[int], first: list[int], end: list[int], distance: list[float | None], number: list[int | None]):
        self.block, self.first, self.end = np.array(block, np.int32), np.array(first, np.int64), np.array(end, np.int64)
        self.distance, self.number = np.array(distance, float), np.array([-1 if n is None else n for n in number], np.int64)
        self.least = Least(self.distance)

    def of(self, number: np.ndarray) -> np.ndarray:
        """The place of the block that holds a row."""
        return np.maximum(np.searchsorted(self.first, number, "right") - 1, 0)


def _fits(mean: np.ndarray, low: np.ndarray, low_open: np.ndarray, high: np.ndarray, high_open: np.ndarray) -> np.ndarray:
    """low < mean <= high where they are not open, with NaN above all numbers, as Spark orders them."""
    above = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))
    return (low_open | above(mean, low)) & (high_open | ~above(mean, high))


def _mean(weight: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means, and where there is one."""
    some = length != 0
    with np.errstate(invalid="ignore"):
        return weight / np.where(some, length, 1), some


def _column(table: pa.RecordBatch, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False)


def _open(table: pa.RecordBatch, name: str) -> np.ndarray:
    return table[name].is_null().to_numpy(zero_copy_only=False)


def begin(rows: Rows, draws: pa.RecordBatch, blocks: Blocks, cap: float | None) -> pa.RecordBatch:
    """Draws (replicate, locus, attempt, first, span, low, high) from rows of this block: those whose stretch ends here and fits,
    and those whose run goes on, with the block where they end and the nearest gene before it."""
    first = _column(draws, "first")
    i = np.minimum(np.searchsorted(rows.number, first), len(rows.number) - 1)
    known = rows.number[i] == first
    goal, close = rows.start[i] + _column(draws, "span"), rows.close[i]
    last = rows.closing(close)
    j = first_reaching(rows.end, i, last + 1, goal)
    to = np.minimum(j, last)
    mean, some = _mean(rows.w1[to] - rows.w0[i], rows.d1[to] - rows.d0[i])
    low, low_open, high, high_open = _column(draws, "low"), _open(draws, "low"), _column(draws, "high"), _open(draws, "high")
    here = np.flatnonzero(known & (j <= last) & (rows.start[to] < goal) & some & _fits(mean, low, low_open, high, high_open))
    near = rows.least.place(i[here], j[here])
    ok = near >= 0
    if cap is not None:
        ok &= rows.distance[near] <= cap
    here, near = here[ok], near[ok]
    far = np.flatnonzero(known & (j > last) & (close > rows.number[-1]))
    took = np.r_[here, far]
    n, m = len(here), len(far)
    distance, number, block, rest = np.r_[rows.distance[near], np.zeros(m)], np.r_[rows.number[near], np.full(m, -1)], np.zeros(m, np.int32), pa.nulls(0, _FAR)
    if m:
        at = blocks.of(rows.number[-1:])
        end = first_reaching(blocks.end, np.full(m, at[0] + 1), blocks.of(close[far]), goal[far])
        block = blocks.block[end]
        own = rows.least.place(i[far], np.full(m, len(rows.number) - 1))
        distance[n:], number[n:] = np.where(own >= 0, rows.distance[own], 0), np.where(own >= 0, rows.number[own], -1)
        whole = np.flatnonzero(end > at[0] + 1)
        between = blocks.least.place(np.full(len(whole), at[0] + 1), end[whole] - 1)
        _nearer(distance, number, n + whole[between >= 0], blocks.distance[between[between >= 0]], blocks.number[between[between >= 0]])
        rest = pa.StructArray.from_arrays([pa.array(goal[far]), pa.array(close[far]), pa.array(rows.d0[i[far]]), pa.array(rows.w0[i[far]]), pa.array(low[far], mask=low_open[far]), pa.array(high[far], mask=high_open[far])], fields=list(_FAR))
    values = [draws["replicate"].take(pa.array(took)), draws["locus"].take(pa.array(took)), draws["attempt"].take(pa.array(took))]
    values += [pa.array(np.r_[mean[here], np.zeros(m)], mask=np.arange(n + m) >= n), pa.array(distance, mask=number < 0), pa.array(number, mask=number < 0)]
    values += [pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(block)]), pa.concat_arrays([pa.nulls(n, _FAR), rest])]
    return pa.RecordBatch.from_arrays(values, names=_NAMES)


def finish(rows: Rows, draws: pa.RecordBatch, cap: float | None) -> pa.RecordBatch:
    """Draws that ``begin`` sent here: those whose stretch ends in this block and fits."""
    rest = pa.RecordBatch.from_struct_array(draws["far"])
    goal, last = _column(rest, "goal"), rows.closing(_column(rest, "close"))
    j = first_reaching(rows.end, np.zeros(len(goal), np.int64), last + 1, goal)
    to = np.minimum(j, last)
    mean, some = _mean(rows.w1[to] - _column(rest, "w0"), rows.d1[to] - _column(rest, "d0"))
    here = np.flatnonzero((j <= last) & (rows.start[to] < goal) & some & _fits(mean, _column(rest, "low"), _open(rest, "low"), _column(rest, "high"), _open(rest, "high")))
    distance, number = draws["distance"].fill_null(0.0).to_numpy()[here], draws["number"].fill_null(-1).to_numpy()[here]
    distance, number = distance.copy(), number.copy()
    near = rows.least.place(np.zeros(len(here), np.int64), j[here])
    _nearer(distance, number, np.flatnonzero(near >= 0), rows.distance[near[near >= 0]], rows.number[near[near >= 0]])
    ok = number >= 0
    if cap is not None:
        ok &= distance <= cap
    took = pa.array(here[ok])
    n = len(took)
    values = [draws["replicate"].take(took), draws["locus"].take(took), draws["attempt"].take(took), pa.array(mean[here[ok]]), pa.array(distance[ok]), pa.array(number[ok]), pa.nulls(n, pa.int32()), pa.nulls(n, _FAR)]
    return pa.RecordBatch.from_arrays(values, names=_NAMES)


_NAMES = ["replicate", "locus", "attempt", "mean_score", "distance", "number", "block", "far"]


def _nearer(distance: np.ndarray, number: np.ndarray, at: np.ndarray, other: np.ndarray, row: np.ndarray) -> None:
    """Put later rows in where they are nearer, or where there is none yet."""
    new = (number[at] < 0) | (other < distance[at])
    distance[at[new]], number[at[new]] = other[new], row[new]


def met(batches: Iterator[pa.RecordBatch], find: Callable[[Rows, pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``find`` for each batch of draws (column draw) of a (block, part) with the rows (column row) before them in the stream."""
    now, held, rows = None, [], None
    for batch in batches:
        block, part, drawn = _column(batch, "block"), _column(batch, "part"), _column(batch, "drawn")
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (drawn[1:] != drawn[:-1])) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(block)]):
            if a == b:
                continue
            if (block[a], part[a]) != now:
                now, held, rows = (block[a], part[a]), [], None
            if not drawn[a]:
                held.append(batch["row"].slice(a, b - a))
            elif held:
                rows = rows or Rows(held)
                yield find(rows, pa.RecordBatch.from_struct_array(batch["draw"].slice(a, b - a)))
