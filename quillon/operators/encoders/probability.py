"""Encoders of distributions and confidence intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import block, clamp, no_bits, run

from .base import Encoder
from .signal import scaled


@dataclass
class DistributionEncoder(Encoder):
    """A block per bin; the more probable a bin against the likeliest one, the more bits around the block's middle."""

    bins: int = 50
    bits_per_bin: int = 10
    min_probability: float = 0.01
    strict: bool = True

    def __post_init__(self):
        require(self.bins > 0 and self.bits_per_bin > 0, "bins", "must be positive")
        self.size = self.bins * self.bits_per_bin

    def encode(self, p: Column) -> Column:
        n, top = self.bits_per_bin, F.greatest(F.array_max(p), F.lit(0.0))

        def of(x: Column, i: Column) -> Column:
            active = clamp(F.round(x / top * F.lit(float(n))), 1, n).cast("int")
            start = F.floor((F.lit(n) - active) / 2).cast("int") + i * F.lit(n)
            return F.when(x >= self.min_probability, F.sequence(start, start + active - 1)).otherwise(no_bits())

        return self.within(F.size(p) == self.bins, F.when(top > 0, F.flatten(F.transform(p, of))).otherwise(no_bits()), "wrong number of bins")


def entropy(p: Column) -> Column:
    """In nats."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))


def mode(p: Column) -> Column:
    """The last bin of greatest probability."""
    return (F.size(p) - F.array_position(F.reverse(p), F.array_max(p))).cast("int")


def mean(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)


def uniform(bins: int) -> Column:
    return F.array_repeat(F.lit(1.0 / bins), bins)


def gaussian(centre: Column, sd: Column, bins: int) -> Column:
    """A Gaussian over the bins' numbers, normalised; sd 0 puts all on the nearest bin."""
    at = F.sequence(F.lit(0), F.lit(bins - 1))
    raw = F.transform(at, lambda i: F.when(sd > 0, F.exp(-F.pow((i - centre) / sd, F.lit(2.0)) / 2)).otherwise((i == F.round(centre)).cast("double")))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


@dataclass
class ConfidenceIntervalEncoder(Encoder):
    """Runs for an interval's centre and its width."""

    centre_bits: int = 100
    centre_width: int = 21
    width_bits: int = 50
    width_width: int = 10
    minimum: float = 0.0
    maximum: float = 100.0
    max_width_share: float = 0.5
    strict: bool = True

    def __post_init__(self):
        require(self.minimum < self.maximum and self.max_width_share > 0, "minimum", "must be below maximum")
        require(self.centre_width <= self.centre_bits and self.width_width <= self.width_bits, "width", "must be at most the bits")
        self.size = self.centre_bits + self.width_bits

    def encode(self, lower: Column, upper: Column) -> Column:
        centre = run(scaled((lower + upper) / 2.0, self.minimum, self.maximum), self.centre_bits, self.centre_width)
        most = (self.maximum - self.minimum) * self.max_width_share
        return self.within(lower <= upper, F.concat(centre, run(clamp((upper - lower) / F.lit(most), 0.0, 1.0), self.width_bits, self.width_width, self.centre_bits)), "lower is above upper")


def interval_contains(lower: Column, upper: Column, x: Column) -> Column:
    return x.between(lower, upper)


def interval_overlap(lower1: Column, upper1: Column, lower2: Column, upper2: Column) -> Column:
    """The length of the common part, 0 if there is none."""
    return F.greatest(F.lit(0.0), F.least(upper1, upper2) - F.greatest(lower1, lower2))


def from_margin(centre: Column, margin: Column) -> tuple[Column, Column]:
    return centre - margin, centre + margin


def from_percent(centre: Column, percent: Column) -> tuple[Column, Column]:
    return from_margin(centre, F.abs(centre) * percent / 100.0)
