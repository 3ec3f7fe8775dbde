"""Words of Arrow text columns, exact strings, and arrays as small byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is worked off in slices of about this many bytes; a longer text comes alone.
SLICE_BYTES = 1 << 22
_CODEC = pa.Codec("zstd", 1)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """A signed integer array, shorter: differences if ``rising``, its bytes by significance, compressed."""
    x = np.ascontiguousarray(values, "<i8")
    if rising:
        x = np.diff(x, prepend=0)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(data[8:], 8 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel() if n else np.zeros(0, np.int64)
    return np.cumsum(x) if rising else x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, stretch of rows) of about ``limit`` bytes of text; nulls become empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + limit, "right")))
        yield row, column.slice(row, to - row)
        row = to


def split(texts: pa.Array, separators: str, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(all words, how many each row has); words are what stands between ``separators``, a pattern of one or more; A-Z are
    lower-cased, no other letter."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts) if lower else texts, separators)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    solid = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(solid.to_numpy(zero_copy_only=False))])
    return flat.filter(solid), np.diff(before[bounds])
