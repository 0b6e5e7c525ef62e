"""Encoders of numbers: scalar, random distributed scalar, logarithmic, delta, pass-through."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import block, clamp, murmur3, no_bits, normal, run

from .base import Encoder


@dataclass
class ScalarEncoder(Encoder):
    """Buckets of equal width over [minimum, maximum]; neighbouring buckets share width - 1 bits.

    One of category, radius and size gives the size, in this order. A periodic range wraps around. Values outside the
    range are in the first or last bucket; with clip=False and refuse=True they are errors. NaN gives null.
    """

    minimum: float = 0.0
    maximum: float = 100.0
    size: int = 400
    width: int = 21
    radius: float = 0.0
    clip: bool = False
    periodic: bool = False
    category: bool = False
    refuse: bool = False
    strict: bool = True

    def __post_init__(self):
        require(self.maximum > self.minimum, "maximum", "must be above minimum")
        require(self.width > 0, "width", "must be positive")
        self.range = self.maximum - self.minimum
        ends = 0 if self.periodic else self.width - 1
        if self.category:
            self.size = int(self.range + 1) + self.width - 1
        elif self.radius > 0:
            self.size = math.ceil(self.range / (self.radius / self.width)) + ends
        require(self.size > 0, "size", "give a size or a radius")
        require(self.size >= self.width, "size", "must hold an SDR's bits")
        self.buckets = self.size - ends

    @classmethod
    def from_resolution(cls, minimum: float, maximum: float, resolution: float, width: int = 21, **other) -> ScalarEncoder:
        return cls(minimum, maximum, 0, width, radius=resolution * width, **other)

    def bucket(self, value: Column) -> Column:
        """The bucket number."""
        v, low = value.cast("double"), F.lit(float(self.minimum))
        if self.periodic:
            v = low + F.pmod(v - low, F.lit(float(self.range)))
        else:
            v = clamp(v, float(self.minimum), float(self.maximum))
        return F.least(F.floor((v - low) / F.lit(float(self.range)) * F.lit(float(self.buckets))), F.lit(self.buckets - 1)).cast("int")

    def encode(self, value: Column) -> Column:
        bits = block(self.bucket(value), self.width)
        if self.periodic:
            bits = F.array_sort(F.transform(bits, lambda b: b % F.lit(self.size)))
        if self.clip or self.periodic or not self.refuse:
            return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), bits)
        return self.within(value.between(float(self.minimum), float(self.maximum)), bits, "value out of range")


@dataclass
class RandomDistributedScalarEncoder(Encoder):
    """Each bucket's bits are hashed: bit i of bucket k is murmur3(k + i, seed) modulo size, so neighbours share bits.

    Hash collisions can leave fewer than width bits. NaN gives no bits. Negative values have buckets of their own, or all
    share bucket 0 with saturate=True.
    """

    size: int = 400
    width: int = 0
    sparsity: float = 0.0
    radius: float = 0.0
    resolution: float = 0.0
    category: bool = False
    seed: int = 42
    saturate: bool = False
    strict: bool = True

    def __post_init__(self):
        require(self.size > 0, "size", "must be positive")
        require((self.width > 0) != (self.sparsity > 0), "width", "give either width or sparsity")
        require(sum([self.radius > 0, self.resolution > 0, self.category]) == 1, "radius", "give one of radius, resolution and category")
        self.width = self.width or int(self.size * self.sparsity + 0.5)
        require(0 < self.width < self.size, "width", "must be positive and below size")
        self.radius = 1.0 if self.category else self.radius
        self.resolution = self.resolution or self.radius / self.width
        self.radius = self.radius or self.resolution * self.width

    def encode(self, value: Column) -> Column:
        v = value.cast("double")
        at = v / F.lit(float(self.resolution))
        first = (F.greatest(F.lit(0.0), at) if self.saturate else F.floor(at)).cast("int")
        bits = normal(F.transform(block(first, self.width), lambda i: (murmur3(i, self.seed) % F.lit(self.size)).cast("int")))
        bits = F.when(F.isnan(v), no_bits()).otherwise(bits)
        if self.category:
            return self.within(F.isnan(v) | ((v >= 0) & (v == F.floor(v))), bits, "a category is a whole number, not negative")
        return F.when(v.isNotNull(), bits)


@dataclass
class LogEncoder(Encoder):
    """A run of bits that follows the logarithm of the value."""

    minimum: float = 1.0
    maximum: float = 10_000.0
    size: int = 100
    width: int = 10
    clip: bool = False
    strict: bool = True

    def __post_init__(self):
        require(self.minimum > 0, "minimum", "must be positive")
        require(self.maximum > self.minimum, "maximum", "must be above minimum")
        require(0 < self.width <= self.size, "width", "must be positive and at most size")

    def encode(self, value: Column) -> Column:
        low, high = math.log(self.minimum), math.log(self.maximum)
        v = value.cast("double")
        x = (F.ln(clamp(v, float(self.minimum), float(self.maximum))) - F.lit(low)) / F.lit(high - low)
        good = (v > 0) if self.clip else v.between(float(self.minimum), float(self.maximum))
        return self.within(good, run(x, self.size, self.width), "value out of range")


@dataclass
class DeltaEncoder(Encoder):
    """Encodes the change from the previous value of the same series; the first change is 0."""

    max_delta: float = 100.0
    size: int = 100
    width: int = 10
    clip: bool = True
    strict: bool = True

    def __post_init__(self):
        require(self.max_delta > 0, "max_delta", "must be positive")
        self.inner = ScalarEncoder(-self.max_delta, self.max_delta, self.size, self.width, clip=self.clip, strict=self.strict)

    def encode(self, delta: Column) -> Column:
        return self.inner.encode(delta)

    @staticmethod
    def delta(value: Column, series: list[str], order: list[str]) -> Column:
        """value minus the one before it, by a window; a reset column in series starts anew."""
        return F.coalesce(value - F.lag(value).over(Window.partitionBy(*series).orderBy(*order)), F.when(value.isNotNull(), F.lit(0.0)))

    def encode_series(self, value: Column, series: list[str], order: list[str]) -> Column:
        return self.encode(self.delta(value, series, order))


@dataclass
class PassThroughEncoder(Encoder):
    """Bits that are given, checked against the size and, if active is set, their number (repeats included)."""

    size: int = 2048
    active: int | None = None
    strict: bool = True

    def encode(self, bits: Column) -> Column:
        good = F.forall(bits, lambda b: (b >= 0) & (b < F.lit(self.size)))
        if self.active is not None:
            good = good & (F.size(bits) == self.active)
        return self.within(good, normal(bits), "bits out of bounds or of the wrong number")
