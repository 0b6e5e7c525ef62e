"""Encoders of categories, flags, levels, paths and sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import bits_udf, block, fnv, lcg_pick, run

from .base import Encoder


def _index(values: list[str], c: Column) -> Column:
    """The place of a column's value in a list, from 0; null if it isn't there. One lookup in a literal array."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int") - F.lit(1)


@dataclass
class CategoryEncoder(Encoder):
    """A block of bits of its own for each category."""

    categories: list[str]
    width: int = 21
    size: int = 0
    strict: bool = True

    def __post_init__(self):
        n = len(self.categories)
        require(n > 0, "categories", "give at least one")
        require(len(set(self.categories)) == n, "categories", "must be distinct")
        self.size = self.size or n * self.width
        require(self.size >= n * self.width, "size", "too small for the categories")
        self.step = self.size // n

    def encode(self, category: Column) -> Column:
        at = _index(self.categories, category)
        return self.within(at >= 0, block(at * F.lit(self.step), self.width), "unknown category")

    def encode_index(self, index: Column) -> Column:
        return self.within((index >= 0) & (index < len(self.categories)), block(index.cast("int") * F.lit(self.step), self.width), "unknown category")


@dataclass
class BooleanEncoder(Encoder):
    """The first half for true, the second for false. Numbers count as true if they aren't 0."""

    width: int = 21

    def __post_init__(self):
        require(self.width > 0, "width", "must be positive")
        self.size = 2 * self.width

    def encode(self, flag: Column) -> Column:
        start = F.when(flag.cast("boolean"), F.lit(0)).when(flag.isNotNull(), F.lit(self.width))
        return F.when(start.isNotNull(), block(start, self.width))


@dataclass
class OrdinalEncoder(Encoder):
    """A run of bits that follows the level's rank: neighbouring levels share bits."""

    levels: list[str] = field(default_factory=lambda: ["very_low", "low", "medium", "high", "very_high"])
    size: int = 100
    width: int = 21
    strict: bool = True

    def __post_init__(self):
        require(len(self.levels) > 0 and len(set(self.levels)) == len(self.levels), "levels", "must be distinct, at least one")
        require(0 < self.width <= self.size, "width", "must be positive and at most size")

    def encode(self, level: Column) -> Column:
        at = _index(self.levels, level)
        return self.within(at >= 0, run(at / F.lit(float(max(1, len(self.levels) - 1))), self.size, self.width), "unknown level")


@dataclass
class HierarchicalCategoryEncoder(Encoder):
    """A block of bits per level of a path; each prefix hashes into its level's block, so that kin share upper levels."""

    separator: str = "/"
    bits_per_level: int = 50
    width_per_level: int = 10
    depth: int = 5

    def __post_init__(self):
        require(0 < self.width_per_level <= self.bits_per_level, "width_per_level", "must be positive and at most the level's bits")
        self.size = self.bits_per_level * self.depth

    def bits_of(self, path: str) -> list[int]:
        out: list[int] = []
        parts = path.split(self.separator)[: self.depth]
        for level in range(len(parts)):
            state = fnv(self.separator.join(parts[: level + 1]).encode(), fnv_level(level))
            out += [level * self.bits_per_level + b for b in lcg_pick(state, self.width_per_level, self.bits_per_level)]
        return sorted(out)

    def encode(self, path: Column) -> Column:
        return _memo_udf(self.bits_of)(path)


def fnv_level(level: int) -> int:
    """The hash state after a level number of eight bytes' weight: one xor and one product."""
    return (0xCBF29CE484222325 ^ level) * 0x100000001B3 & (1 << 64) - 1


def _memo_udf(of):
    """An Arrow UDF of one string column that computes each distinct value of a batch once."""

    def function(column):
        known = {v: of(v) for v in column.dropna().unique()}
        return [known.get(v) for v in column]

    return bits_udf(function)


@dataclass
class SetEncoder(Encoder):
    """The union of hashed bits of a set's first elements."""

    size: int = 2048
    bits_per_element: int = 5
    max_elements: int = 50

    def __post_init__(self):
        require(0 < self.bits_per_element <= self.size, "bits_per_element", "must be positive and at most size")

    def element_bits(self, element: str) -> list[int]:
        return lcg_pick(fnv(element.encode()), self.bits_per_element, self.size)

    def encode(self, elements: Column) -> Column:
        def function(column):
            known: dict[str, list[int]] = {}
            out = []
            for row in column:
                if row is None:
                    out.append(None)
                    continue
                own = [x for x in list(row)[: self.max_elements] if x is not None]
                for x in own:
                    if x not in known:
                        known[x] = self.element_bits(x)
                out.append([b for x in own for b in known[x]])
            return out

        return bits_udf(function)(elements)
