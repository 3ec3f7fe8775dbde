"""Random draws that any engine can repeat: 32-bit integer arithmetic on keys, as Spark columns, numpy arrays and SQL text.

A draw depends on its keys (seed, replicate, unit, ...) alone: not on partitions, task attempts or the number of other draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

#: Fixed values of the 32-bit mixing function, of its first state and of the second word of a draw.
_FACTOR, _FIRST, _SECOND, _LOW = 73244475, 2654435769, 2246822507, 0xFFFFFFFF
#: Rounds of the keyed permutation.
ROUNDS = 24


# -- columns ---------------------------------------------------------------------------------------------------------
def _scrambled(x: Column) -> Column:
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(_FACTOR)).bitwiseAND(F.lit(_LOW))
    return x.bitwiseXOR(F.shiftright(x, 16))


def hashed(*keys: Column | int) -> Column:
    """A number below 2^32 from whole, non-negative keys."""
    columns = [(F.lit(k) if isinstance(k, int) else k).cast("long") for k in keys]
    folded = lambda k: k.bitwiseXOR(F.shiftright(k, 32)).bitwiseAND(F.lit(_LOW))
    return F.aggregate(F.array(*columns), F.lit(_FIRST), lambda h, k: _scrambled(h.bitwiseXOR(folded(k))))


def draw(n: Column | int, *keys: Column | int) -> Column:
    """A number from 0 to n - 1."""
    words = F.array(hashed(*keys))
    wide = F.transform(words, lambda h: h * F.lit(1 << 31) + F.shiftright(_scrambled(h.bitwiseXOR(F.lit(_SECOND))), 1))
    return wide[0] % (F.lit(n) if isinstance(n, int) else n).cast("long")


def text_draw(n: Column | int, *keys: Column | int) -> Column:
    """A number from 0 to n - 1 from keys of any type, by their MD5."""
    joined = F.concat_ws(":", *[(F.lit(k) if isinstance(k, int) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n).cast("long")


# -- numpy -----------------------------------------------------------------------------------------------------------
def scrambled_array(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * _FACTOR) & _LOW
    return x ^ (x >> 16)


def hashed_array(*keys: np.ndarray | int) -> np.ndarray:
    h = np.int64(_FIRST)
    for k in keys:
        k = np.asarray(k, np.int64)
        h = scrambled_array(h ^ ((k ^ (k >> 32)) & _LOW))
    return h


def draw_array(n: np.ndarray | int, *keys: np.ndarray | int) -> np.ndarray:
    h = hashed_array(*keys)
    return (h * (1 << 31) + (scrambled_array(h ^ _SECOND) >> 1)) % n


def permuted_array(index: np.ndarray, n: np.ndarray, *keys: np.ndarray | int) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 that the keys choose takes each index: rounds that swap an element with its partner
    (round key - element, modulo n) or not, by one bit that both share. Any n up to 2^31 is a domain of its own."""
    x = np.asarray(index, np.int64)
    base = hashed_array(*keys)
    for r in range(ROUNDS):
        key = scrambled_array(base ^ (r + 1))
        partner = (key % n - x) % n
        bit = scrambled_array(key ^ np.maximum(x, partner)) & 1
        x = np.where(bit == 1, partner, x)
    return x


def permuted(index: Column, n: Column | int, *keys: Column | int) -> Column:
    """The same as a column: the ``index``-th draw without replacement from 0 .. n - 1."""

    @pandas_udf("long")
    def place(index: pd.Series, n: pd.Series, *keys: pd.Series) -> pd.Series:
        return pd.Series(permuted_array(index.to_numpy(), n.to_numpy(), *[k.to_numpy() for k in keys]))

    lift = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("long")
    return place(lift(index), lift(n), *[lift(k) for k in keys])


# -- SQL text --------------------------------------------------------------------------------------------------------
def _sql_scrambled(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {_FACTOR}) & {_LOW})"
    return f"xor({x}, {x} >> 16)"


def sql_hashed(*keys: str | int) -> str:
    elements = ", ".join(f"({k})::BIGINT" for k in keys)
    return f"list_reduce([{_FIRST}::BIGINT, {elements}], lambda h, k: {_sql_scrambled(f'xor(h, xor(k, k >> 32) & {_LOW})')})"


def sql_draw(n: str | int, *keys: str | int) -> str:
    return f"(list_transform([{sql_hashed(*keys)}], lambda h: h * {1 << 31} + ({_sql_scrambled(f'xor(h, {_SECOND})')} >> 1))[1] % ({n}))"


def sql_text_draw(n: str | int, *keys: str | int) -> str:
    joined = " || ':' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5({joined}), 1, 15))::BIGINT % ({n}))"


def sql_permuted(index: str, n: str, *keys: str | int) -> str:
    """``n`` must be short: it is repeated."""
    rounds = f"list_transform(range(1, {ROUNDS + 1}), lambda r: {_sql_scrambled('xor(b, r)')})"
    partner = f"((k % {n} - x + {n}) % {n})"
    step = f"CASE WHEN {_sql_scrambled(f'xor(k, greatest(x, {partner}))')} & 1 = 1 THEN {partner} ELSE x END"
    keyed = f"list_transform([{sql_hashed(*keys)}], lambda b: {rounds})[1]"
    return f"list_reduce(list_prepend(({index})::BIGINT, {keyed}), lambda x, k: {step})"
