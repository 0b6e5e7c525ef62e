"""SDR algebra: functions on bit columns. A null SDR gives null."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import DimensionMismatch, InvalidDimensions

from .kernels import BITS, no_bits, normal, shifted


def _all_below(values: Column, n: int) -> Column:
    return F.forall(values, lambda c: (c >= 0) & (c < F.lit(n)))


@dataclass(frozen=True)
class Shape:
    """The dimensions of an SDR. (0,) is a placeholder."""

    dims: tuple[int, ...]

    def __post_init__(self):
        if not self.dims or (len(self.dims) > 1 and 0 in self.dims) or min(self.dims) < 0:
            raise InvalidDimensions(f"{self.dims}")

    @property
    def size(self) -> int:
        return prod(self.dims)

    @property
    def strides(self) -> list[int]:
        return [prod(self.dims[k + 1 :]) for k in range(len(self.dims))]

    def reshape(self, *dims: int) -> Shape:
        """Other dimensions of the same size; bits stay as they are."""
        new = Shape(dims)
        if new.size != self.size:
            raise DimensionMismatch(f"{self.dims} has {self.size} bits, {dims} has {new.size}")
        return new

    def flat(self, *coordinates: Column) -> Column:
        """The bit number at coordinates, row-major."""
        if len(coordinates) != len(self.dims):
            raise DimensionMismatch(f"{len(coordinates)} coordinates for {self.dims}")
        return reduce(lambda a, b: a + b, [c * F.lit(s) for c, s in zip(coordinates, self.strides, strict=True)])

    def coordinates(self, bits: Column) -> Column:
        """array<array<int>>: for each dimension the coordinate of every bit, in bit order."""
        def of(s: int, d: int) -> Column:
            return F.transform(bits, lambda b: (F.floor(b / F.lit(s)) % F.lit(d)).cast("int"))

        return F.array(*[of(s, d) for s, d in zip(self.strides, self.dims, strict=True)])

    def from_coordinates(self, coordinates: Column, strict: bool = True) -> Column:
        """The bits at the coordinates (one array per dimension); strict checks lengths and bounds."""
        n = len(self.dims)
        at = [F.get(coordinates, F.lit(k)) for k in range(n)]
        flat = F.transform(at[0], lambda _, i: reduce(lambda a, b: a + b, [F.get(at[k], i) * F.lit(self.strides[k]) for k in range(n)]))
        if strict:
            good = F.size(coordinates) == n
            for own, d in zip(at, self.dims, strict=True):
                good = good & (F.size(own) == F.size(at[0])) & _all_below(own, d)
            flat = F.when(coordinates.isNull(), F.lit(None)).when(good, flat).otherwise(F.raise_error(F.lit("coordinates out of bounds")).cast(BITS))
        return normal(flat)

    def at(self, bits: Column, *coordinates: Column) -> Column:
        """Whether the bit at the coordinates is active."""
        return F.array_contains(bits, self.flat(*coordinates))


def zero() -> Column:
    return no_bits()


def from_dense(dense: Column) -> Column:
    """The places of nonzero entries."""
    return F.filter(F.transform(dense, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def to_dense(bits: Column, size: int) -> Column:
    """array<tinyint> of 0 and 1. Only for small sizes: everything else here works on bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(bits, i).cast("tinyint"))


def checked(bits: Column, size: int) -> Column:
    """bits, or an error where they aren't strictly ascending and below size."""
    good = (bits == normal(bits)) & F.coalesce((F.array_min(bits) >= 0) & (F.array_max(bits) < size), F.size(bits) == 0)
    return F.when(bits.isNull() | good, bits).otherwise(F.raise_error(F.lit("bits are not ascending or out of bounds")).cast(BITS))


def count(bits: Column) -> Column:
    return F.when(bits.isNotNull(), F.size(bits))


def sparsity(bits: Column, size: int) -> Column:
    return count(bits) / F.lit(float(size)) if size else F.when(bits.isNotNull(), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return count(F.array_intersect(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def concatenate(*parts: tuple[Column, int]) -> Column:
    """The parts (bits, size) one after the other."""
    out, offset = [], 0
    for bits, size in parts:
        out.append(shifted(bits, offset))
        offset += size
    return F.concat(*out)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, overlap(a, b) / both).when(a.isNotNull() & b.isNotNull(), F.lit(1.0))


def randomize(key: Column, size: int, share: float, seed: int = 0) -> Column:
    """round(size * share) distinct bits, drawn by a hash of key and seed: the same key gives the same bits."""
    n = max(0, min(size, int(size * share + 0.5)))
    if n == 0:
        return F.when(key.isNotNull(), no_bits())
    drawn = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.struct(F.xxhash64(F.lit(seed), key, b).alias("h"), b.alias("b")))
    return F.when(key.isNotNull(), F.sort_array(F.transform(F.slice(F.sort_array(drawn), 1, n), lambda x: x["b"])))


def add_noise(bits: Column, key: Column, size: int, share: float, seed: int = 0) -> Column:
    """Moves round(active * share) bits to places that were inactive, drawn by a hash of key and seed."""

    def drawn(pool: Column, n: Column, salt: int) -> Column:
        order = F.sort_array(F.transform(pool, lambda b: F.struct(F.xxhash64(F.lit(seed + salt), key, b).alias("h"), b.alias("b"))))
        return F.transform(F.slice(order, 1, n), lambda x: x["b"])

    free = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), bits)
    n = F.least(F.round(F.size(bits) * F.lit(float(share))).cast("int"), F.size(free))
    return F.array_sort(F.concat(F.array_except(bits, drawn(bits, n, 0)), drawn(free, n, 1)))


def show(bits: Column, shape: Shape) -> Column:
    """SDR( d0, d1 ) b0, b1 as text."""
    return F.concat(F.lit(f"SDR( {', '.join(map(str, shape.dims))} ) "), F.array_join(bits.cast("array<string>"), ", "))
