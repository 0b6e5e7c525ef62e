"""Encoders of colours and edges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import block, joined, no_bits, run

from .base import Encoder
from .signal import part, scaled


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of red, green and blue in [0, 1]."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0) * 60.0
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(d / top), top


def rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue in [0, 1]."""

    def channel(n: float) -> Column:
        k = F.pmod(F.lit(n) + h / 60.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


@dataclass
class ColorEncoder(Encoder):
    """A ring of hues, and runs for saturation and value."""

    hue_bits: int = 120
    hue_width: int = 21
    saturation_bits: int = 50
    saturation_width: int = 10
    value_bits: int = 50
    value_width: int = 10

    def __post_init__(self):
        require(self.hue_width <= self.hue_bits and self.saturation_width <= self.saturation_bits and self.value_width <= self.value_bits, "width", "must be at most the bits")
        self.size = self.hue_bits + self.saturation_bits + self.value_bits

    def encode(self, h: Column, s: Column, v: Column) -> Column:
        positions = self.hue_bits - self.hue_width + 1
        start = (F.round(F.pmod(h, F.lit(360.0)) / 360.0 * F.lit(float(positions))) % F.lit(positions)).cast("int")
        s = run(scaled(s, 0.0, 1.0), self.saturation_bits, self.saturation_width, self.hue_bits)
        v = run(scaled(v, 0.0, 1.0), self.value_bits, self.value_width, self.hue_bits + self.saturation_bits)
        return F.when(h.isNotNull(), joined(block(start, self.hue_width), s, v))

    def encode_rgb(self, r: Column, g: Column, b: Column) -> Column:
        return self.encode(*hsv(r, g, b))


@dataclass
class EdgeOrientationEncoder(Encoder):
    """A block per orientation bin over half a turn, and a run for the magnitude; weak edges have no bits."""

    orientations: int = 8
    bits_per_orientation: int = 20
    width_per_orientation: int = 5
    magnitude_bits: int = 40
    magnitude_width: int = 10
    min_magnitude: float = 0.01
    max_magnitude: float = 1.0

    def __post_init__(self):
        require(self.width_per_orientation <= self.bits_per_orientation and self.magnitude_width <= self.magnitude_bits, "width", "must be at most the bits")
        require(self.min_magnitude < self.max_magnitude, "min_magnitude", "must be below max_magnitude")
        self.size = self.orientations * self.bits_per_orientation + self.magnitude_bits

    def encode(self, orientation: Column, magnitude: Column) -> Column:
        x = F.pmod(orientation, F.lit(math.pi)) / F.lit(math.pi) * F.lit(float(self.orientations))
        which = (F.floor(x) % F.lit(self.orientations)).cast("int")
        fine = part(scaled(x - which, 0.0, 1.0), self.bits_per_orientation, self.width_per_orientation, which * F.lit(self.bits_per_orientation))
        strong = run(scaled(magnitude, self.min_magnitude, self.max_magnitude), self.magnitude_bits, self.magnitude_width, self.orientations * self.bits_per_orientation)
        return F.when(orientation.isNotNull() & (magnitude >= self.min_magnitude), joined(fine, strong)).when(orientation.isNotNull() & magnitude.isNotNull(), no_bits())

    def encode_gradient(self, dx: Column, dy: Column) -> Column:
        return self.encode(F.atan2(dy, dx), F.hypot(dx, dy))
