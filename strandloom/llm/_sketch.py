"""Count-min sketches: partitions count their keys, a shuffle merges the counts, tasks read "twice or more" as bits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_BLOCK_BITS = 18
_SCHEMA = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary())])
_LOADED: dict[str, np.ndarray] = {}


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cells, as zstd over their differences; the lowest bit tells cells of two or more from those of one."""
    body = np.diff(cells.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").tobytes()
    return len(cells).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    many = int.from_bytes(packed[:4], "little")
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(packed[4:], 4 * many, asbytes=True), "<u4"), dtype=np.uint32)


class CountMin:
    """``depth`` rows of 2^``bits`` counters that stop at two. An estimate is the least of a key's counters, so it never falls
    below the true count (or two): a key that occurs twice is never estimated to occur once.

    A task that fills it holds its own keys' cells only; a task that reads it holds depth * 2^bits / 8 bytes.
    """

    def __init__(self, bits: int = 24, depth: int = 2):
        self.bits, self.depth = bits, depth
        self.block_bits = min(bits, _BLOCK_BITS)

    @classmethod
    def sized(cls, keys: int, depth: int = 2, least: int = 16, most: int = 28) -> CountMin:
        """Four counters or more a key in every row, up to 2^``most`` counters (64 MB of bits at depth 2). Past that size
        more keys are let through, and results stay the same."""
        return cls(min(most, max(least, int(4 * max(keys, 1) - 1).bit_length())), depth)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (keys * U(_ODD[row])) >> U(64 - self.bits)

    def estimate(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """True where the estimate is two or more."""
        out = np.ones(len(keys), bool)
        for row in range(self.depth):
            cell = self.cells(keys, row)
            byte = table[row, (cell >> U(3)).astype(np.int64)]
            out &= (byte >> (cell & U(7)).astype(np.uint8)) & 1 == 1
        return out

    def partials(self, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Callable:
        """A mapInArrow function: one partition's counts, by blocks of cells."""

        def fold(parts: list[np.ndarray]) -> np.ndarray:
            """cell * 2 + (1 if it was counted twice or more), sorted."""
            both = np.sort(np.concatenate(parts))
            cell = both >> U(1)
            fresh = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
            begin = np.flatnonzero(fresh)
            again = np.diff(np.append(begin, len(cell))) > 1
            top = both[np.append(begin[1:], len(both)) - 1]
            return top | again.astype(U)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = [[] for _ in range(self.depth)]
            size = 0
            for batch in batches:
                for keys in keys_of(batch):
                    for row in range(self.depth):
                        held[row].append(self.cells(keys, row) << U(1))
                    size += len(keys)
                    if size > 1 << 21:
                        held = [[fold(x)] for x in held]
                        size = len(held[0][0]) // 2
            for row in range(self.depth):
                if not sum(map(len, held[row])):
                    continue
                cells = fold(held[row])
                blocks = (cells >> U(1 + self.block_bits)).astype(np.int64)
                edges = np.flatnonzero(np.append(True, np.diff(blocks) != 0))
                inside = cells & U((2 << self.block_bits) - 1)
                named = [int(b) + (row << (self.bits - self.block_bits)) for b in blocks[edges]]
                packed = [_pack(x) for x in np.split(inside, edges[1:])]
                salt = int(cells[: 1 << 12].sum()) % 16
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array([salt] * len(named), pa.int32()), pa.array(packed, pa.binary())], schema=_SCHEMA)

        return fill

    def _merged(self, tables: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << self.block_bits, np.uint8)
        for t in tables:
            for x in t.column("cells"):
                cells = _unpack(x.as_py())
                at = cells >> np.uint32(1)
                total[at] = np.minimum(total[at] + 1 + (cells & np.uint32(1)).astype(np.uint8), 2)
        return total

    def build(self, source: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
        """Merge the partitions' counts in two levels and broadcast the bits (their size is fixed by the parameters)."""

        def half(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = self._merged(tables)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([_pack(at * 2 + (total[at] > 1))], pa.binary())], schema=_SCHEMA)

        def whole(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.packbits(self._merged(tables) > 1, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([bits], pa.binary())], schema=_SCHEMA)

        schema = "block int, slice int, cells binary"
        parts = source.mapInArrow(self.partials(keys_of), schema)
        halves = parts.groupBy("block", "slice").applyInArrow(half, schema)
        rows = halves.groupBy("block").applyInArrow(whole, schema).select("block", "cells").collect()  # bits of fixed size
        return source.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, {r["block"]: bytes(r["cells"]) for r in rows}))

    def load(self, sent) -> np.ndarray:
        """The broadcast bits as an array; a worker keeps the last one it read for its next tasks."""
        name, blocks = sent.value
        if name not in _LOADED:
            _LOADED.clear()
            got = np.zeros((self.depth, max(1, (1 << self.bits) // 8)), np.uint8)
            flat, size = got.reshape(-1), (1 << self.block_bits) // 8
            for b, bits in blocks.items():
                flat[b * size : (b + 1) * size] = np.frombuffer(bits, np.uint8)
            _LOADED[name] = got
        return _LOADED[name]
