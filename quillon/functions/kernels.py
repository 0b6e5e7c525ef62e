"""Building blocks of encoders: native expressions, and 64-bit hash kernels in numpy for Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = "array<int>"
#: Fixed values of the public FNV-1a and LCG definitions.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LCG_FACTOR = 6364136223846793005
_MASK = (1 << 64) - 1


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def block(start: Column, width: int) -> Column:
    """width consecutive bits."""
    return F.sequence(start, start + F.lit(width - 1))


def run(x: Column, bits: int, width: int, offset: int = 0) -> Column:
    """A run of width bits whose start follows x in [0, 1] over a block of so many bits at offset; null for a null x."""
    return block(F.round(x * F.lit(float(bits - width))).cast("int") + F.lit(offset), width)


def shifted(bits: Column, offset: int) -> Column:
    return F.transform(bits, lambda b: b + F.lit(offset)) if offset else bits


def joined(*parts: Column) -> Column:
    """Parts that lie in ascending, disjoint blocks."""
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def normal(bits: Column) -> Column:
    """Sorted and distinct."""
    return F.array_sort(F.array_distinct(bits))


def no_bits() -> Column:
    return F.array().cast(BITS)


def csv(bits: Column) -> Column:
    """Bits as text, for comparisons."""
    return F.array_join(bits.cast("array<string>"), ",")


def in_range(x: Column, size: int) -> Column:
    """x clamped to 0 .. size - 1, as an int."""
    return F.least(F.greatest(x, F.lit(0)), F.lit(size - 1)).cast("int")


# ---- Murmur3 of an int with any seed, by Spark's hash() ------------------------------------------------------------


def _rotate(x: int, n: int) -> int:
    return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 32)


def murmur3_prefix(seed: int) -> int:
    """The int p with murmur3(p, 42) = seed, so that hash(p, x) is the Murmur3 hash of x with this seed.

    hash() chains: each argument's hash is the next one's seed. All steps of the hash of one int can be undone.
    """
    h = seed & 0xFFFFFFFF
    h ^= h >> 16
    h = h * _inverse(0xC2B2AE35) & 0xFFFFFFFF
    h ^= (h >> 13) ^ (h >> 26)
    h = h * _inverse(0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 16
    h ^= 4  # the length
    h = (h - 0xE6546B64) * _inverse(5) & 0xFFFFFFFF
    k = _rotate(h, 32 - 13) ^ 42
    k = k * _inverse(0x1B873593) & 0xFFFFFFFF
    k = _rotate(k, 32 - 15) * _inverse(0xCC9E2D51) & 0xFFFFFFFF
    return k - (1 << 32) if k >= 1 << 31 else k


def murmur3(x: Column, seed: int) -> Column:
    """The unsigned Murmur3 hash of an int column, as a long."""
    return F.hash(F.lit(murmur3_prefix(seed)).cast("int"), x.cast("int")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


# ---- 64-bit kernels; Python ints where the work is per distinct value, numpy where it is per row -----------------------


def fnv(data: bytes, state: int = FNV_OFFSET) -> int:
    for b in data:
        state = (state ^ b) * FNV_PRIME & _MASK
    return state


def fnv_numbers(*values: int | np.ndarray) -> np.ndarray:
    """FNV-1a over whole 64-bit numbers, row by row."""
    state: np.ndarray = np.uint64(FNV_OFFSET)
    with np.errstate(over="ignore"):
        for v in values:
            state = (state ^ (v.astype(np.int64).view(np.uint64) if isinstance(v, np.ndarray) else np.uint64(v & _MASK))) * np.uint64(FNV_PRIME)
    return state


def lcg_pick(state: int, count: int, size: int, taken: Sequence[int] = ()) -> list[int]:
    """count distinct numbers below size, by a linear congruential generator."""
    if count > size:
        raise ValueError("more bits than the block has")
    out: list[int] = []
    seen = set(taken)
    tries = 0
    while len(out) < count:
        state = (state * LCG_FACTOR + 1) & _MASK
        bit = state % size
        if bit not in seen:
            seen.add(bit)
            out.append(bit)
        tries += 1
        if tries > 64 * size + 4096:  # a power-of-two size can lock the low bits into a short cycle
            out += [b for b in range(size) if b not in seen][: count - len(out)]
    return out


def sign_bits(rows: np.ndarray, planes: np.ndarray) -> list[int]:
    """For each row an integer whose bit i is 1 if its product with plane i isn't negative."""
    signs = rows @ planes.T >= 0
    weight = [1 << i for i in range(signs.shape[1])]
    return [sum(w for w, s in zip(weight, row, strict=True) if s) for row in signs.tolist()]


#: Elements, or characters of text, that bits_udf() hands on at a time.
UDF_ELEMENTS = 1 << 18


def runs_of_rows(columns: Sequence, most: int) -> list[tuple[int, int]]:
    """Runs (i, j) of the rows of Arrow columns with about so many elements or characters, whatever the batch has."""
    size = np.ones(len(columns[0]), np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            size += c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
    return [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]


def bits_udf(function: Callable) -> Callable[..., Column]:
    """An Arrow UDF that returns bits: function gets pandas Series and returns a list of bit lists, None for null.

    A batch has thousands of rows, each as long as its text, and Python objects for all its words are many times as large: only the
    rows of about UDF_ELEMENTS elements are Python objects at a time.
    """
    @F.arrow_udf(BITS)
    def udf(*columns: pa.Array) -> pa.Array:
        parts = []
        for i, j in runs_of_rows(columns, UDF_ELEMENTS):
            some = [c.slice(i, j - i).to_pandas() for c in columns]
            parts.append(pa.array([None if r is None else sorted(set(r)) for r in function(*some)], pa.list_(pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return udf
