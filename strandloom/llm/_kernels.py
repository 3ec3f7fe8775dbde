"""Vectorised hashing of words and windows over Arrow text buffers (numpy inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASES = (0x1E3779B97F4A7C15, 0x11342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_LOW_BITS = 24
#: Texts are hashed in slices of about this many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U))


#: Stretches are hashed in the field of this prime, 2^61 - 1: two unlike ones of n symbols meet with a chance of n / 2^61. Modulo
#: 2^64 there are long words (Thue-Morse) and their complements that meet for every odd base.
_PRIME = U((1 << 61) - 1)
_30, _31, _61 = U(30), U(31), U(61)
_STRETCH = 1 << 13
_LOW30, _LOW31 = U((1 << 30) - 1), U((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _61)
    return np.minimum(x, x - _PRIME)  # x - prime wraps to a larger number where x is below it


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2^31 in the field, short of the last reduction, for x below 2^62."""
    return (x >> _30) + ((x & _LOW30) << _31)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    return _reduced(((a1 * b1) << U(1)) + _shifted(a1 * b0 + a0 * b1) + a0 * b0)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the field, by stretches that stay in the processor's cache."""
    if len(a) <= _STRETCH:
        return _product(a, b)
    out = np.empty(len(a), U)
    for at in range(0, len(a), _STRETCH):
        out[at : at + _STRETCH] = _product(a[at : at + _STRETCH], b[at : at + _STRETCH] if len(b) > 1 else b)
    return out


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    done, prime = 1, int(_PRIME)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], np.full(1, pow(base, done, prime), U))
        done += more
    return out


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        got = _powers_of(base, size), _powers_of(pow(base, -1, int(_PRIME)), size)
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = got
    return got


class Rolling:
    """Hashes of any stretch of a symbol sequence from one prefix sum: sum of symbol * base^position in the field. The sums are
    kept as sums of the terms' high and low halves, which do not overflow below 2^32 symbols."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self.down = _powers(_BASES[which], len(symbols) + 1)
        n = len(symbols)
        self.high, self.low = np.zeros(n + 1, U), np.zeros(n + 1, U)
        for at in range(0, n, _STRETCH):
            to = min(n, at + _STRETCH)
            terms = _product(_reduced(symbols[at:to]), up[at:to])
            self.high[at + 1 : to + 1] = terms >> _31
            self.low[at + 1 : to + 1] = terms & _LOW31
        np.cumsum(self.high, out=self.high)
        np.cumsum(self.low, out=self.low)

    def _between(self, starts, ends) -> np.ndarray:
        high, low = self.high[ends] - self.high[starts], self.low[ends] - self.low[starts]
        return _product(_reduced(_shifted(high) + low), self.down[starts])

    def windows(self, width: int) -> np.ndarray:
        out = np.zeros(max(0, len(self.high) - width), U)
        for at in range(0, len(out), _STRETCH):
            to = min(len(out), at + _STRETCH)
            out[at:to] = mix(self._between(slice(at, to), slice(at + width, to + width)))
        return out

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), U)
        for at in range(0, len(out), _STRETCH):
            s, e = starts[at : at + _STRETCH], ends[at : at + _STRETCH]
            out[at : at + _STRETCH] = mix(self._between(s, e) ^ ((e - s).astype(U) * U(0xA24BAED4963EE407)))
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span :]) if span < width else out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows holding about ``limit`` bytes; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, raw[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def _word_chunk(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray, fold: np.ndarray | None) -> tuple[np.ndarray, ...]:
    solid = ~separator[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = BYTE_CODES[data if fold is None else fold[data]]
    return starts, ends, Rolling(codes).stretches(starts, ends)


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and 64-bit code of every word, and the word offsets of the rows.

    A text longer than a slice is worked off in pieces cut at separators, so memory holds one piece and the codes.
    """
    parts, at, n = [], 0, len(data)
    while at < n:
        to = min(n, at + 4 * SLICE_BYTES)
        if to < n:
            cut = np.flatnonzero(separator[data[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
            else:
                more = np.flatnonzero(separator[data[to:]])
                to = to + int(more[0]) + 1 if len(more) else n
        inside = bounds[(bounds > at) & (bounds < to)] - at
        starts, ends, codes = _word_chunk(data[at:to], inside, separator, fold)
        parts.append((starts + at, ends + at, codes))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(bounds), np.int64)
    starts, ends, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return starts, ends, codes, np.searchsorted(starts, bounds)


#: Word separators: space and \x09-\x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def window_runs(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray] | None:
    """Runs of consecutive windows (``width`` symbols, inside one row) that share an anchor.

    A window's anchor is its rightmost ``gram``-symbol stretch of least hash; it depends on the window's symbols alone,
    so equal windows have equal anchors at equal offsets, and two windows of one run are never equal.
    """
    n = len(symbols)
    if n < width:
        return None
    assert n < 1 << _LOW_BITS, "slices are shorter than 2^24 symbols"
    valid = np.zeros(n + 1, np.int32)
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    some = counts > 0
    np.add.at(valid, bounds[:-1][some], 1)
    np.add.at(valid, bounds[:-1][some] + counts[some], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return None
    one, two = Rolling(symbols, 0), Rolling(symbols, 1)
    grams = one.windows(gram)
    low = U((1 << _LOW_BITS) - 1)
    keys = (grams & ~low) | (low - np.arange(len(grams), dtype=U))
    anchors = (low - (sliding_min(keys, width - gram + 1) & low)).astype(np.int64)[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(anchors) != 0) | (np.diff(at) != 1)
    begin = np.flatnonzero(fresh)
    first, many, anchor = at[begin], np.diff(np.append(begin, len(at))), anchors[begin]
    lead = (anchor - first).astype(U)
    return {
        "first": first,
        "many": many,
        "lead": anchor - first,
        "row": np.searchsorted(bounds, first, "right") - 1,
        "anchor": grams[anchor],
        "content": mix(two.stretches(first, first + many - 1 + width) + lead * U(0x2545F4914F6CDD1D)),
    }


def merge_ranges(ranges: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows as sorted disjoint rows; touching rows are joined."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    fresh = np.ones(len(ranges), bool)
    fresh[1:] = ranges[1:, 0] > reach[:-1]
    begin = np.flatnonzero(fresh)
    return np.column_stack([ranges[begin, 0], reach[np.append(begin[1:], len(ranges)) - 1]])
