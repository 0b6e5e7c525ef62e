"""Encoders of signals: spectra, waveforms, pitches, heart rates, electrocardiograms, accelerations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import BITS, block, clamp, joined, no_bits, run

from .base import Encoder


def part(x: Column, bits: int, width: int, offset: Column) -> Column:
    """A run whose offset is a column."""
    return block(F.round(x * F.lit(float(bits - width))).cast("int") + offset, width)


def scaled(x: Column, low: float, high: float) -> Column:
    """x as a share of [low, high], clamped."""
    return (clamp(x, float(low), float(high)) - F.lit(float(low))) / F.lit(float(high - low))


@dataclass
class SpectrogramEncoder(Encoder):
    """A block per frequency bin; a bin at or below the least magnitude has no bits."""

    bins: int = 64
    bits_per_bin: int = 20
    width_per_bin: int = 5
    minimum: float = 0.001
    maximum: float = 1.0
    log_scale: bool = True
    strict: bool = True

    def __post_init__(self):
        require(0 < self.width_per_bin <= self.bits_per_bin, "width_per_bin", "must be positive and at most the bin's bits")
        require(0 < self.minimum < self.maximum, "minimum", "must be positive and below maximum")
        self.size = self.bins * self.bits_per_bin

    def encode(self, spectrum: Column) -> Column:
        def of(m: Column, i: Column) -> Column:
            v = clamp(m.cast("double"), self.minimum, self.maximum)
            x = F.ln(v / self.minimum) / math.log(self.maximum / self.minimum) if self.log_scale else scaled(v, self.minimum, self.maximum)
            return F.when(x > 0, part(x, self.bits_per_bin, self.width_per_bin, i * F.lit(self.bits_per_bin))).otherwise(no_bits())

        return self.within(F.size(spectrum) == self.bins, F.flatten(F.transform(spectrum, of)), "wrong number of bins")


@dataclass
class WaveformEncoder(Encoder):
    """A block per sample."""

    samples: int = 64
    bits_per_sample: int = 16
    width_per_sample: int = 4
    minimum: float = -1.0
    maximum: float = 1.0
    strict: bool = True

    def __post_init__(self):
        require(0 < self.width_per_sample <= self.bits_per_sample, "width_per_sample", "must be positive and at most the sample's bits")
        require(self.minimum < self.maximum, "minimum", "must be below maximum")
        self.size = self.samples * self.bits_per_sample

    def blocks(self, samples: Column) -> Column:
        return F.flatten(F.transform(samples, lambda v, i: part(scaled(v, self.minimum, self.maximum), self.bits_per_sample, self.width_per_sample, i * F.lit(self.bits_per_sample))))

    def encode(self, samples: Column) -> Column:
        return self.within(F.size(samples) == self.samples, self.blocks(samples), "wrong number of samples")


def midi(frequency: Column) -> Column:
    return F.lit(69.0) + F.lit(12.0) * F.log2(frequency / F.lit(440.0))


def frequency_of_midi(note: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (note - F.lit(69.0)) / F.lit(12.0))


def frequency_of_note(name: Column) -> Column:
    """The frequency of a name like A4, C#5 or Bb3; null if it isn't one."""
    semitone = F.element_at(F.create_map(*[F.lit(x) for kv in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True) for x in kv]), F.upper(F.substring(name, 1, 1)))
    change = F.when(F.substring(name, 2, 1) == "#", F.lit(1)).when(F.substring(name, 2, 1) == "b", F.lit(-1)).otherwise(F.lit(0))
    octave = F.try_to_number(F.regexp_extract(name, r"^[A-Ga-g][#b]?(-?\d)$", 1), F.lit("S9")).cast("int")
    return frequency_of_midi(((octave + 1) * 12 + semitone + change).cast("double"))


@dataclass
class PitchEncoder(Encoder):
    """A ring of pitch classes and a run for the octave."""

    class_bits: int = 120
    class_width: int = 21
    octave_bits: int = 72
    octave_width: int = 8
    min_octave: int = 0
    max_octave: int = 8
    strict: bool = True

    def __post_init__(self):
        require(0 < self.class_width <= self.class_bits and 0 < self.octave_width <= self.octave_bits, "width", "must be positive and at most the bits")
        require(self.min_octave < self.max_octave, "min_octave", "must be below max_octave")
        self.size = self.class_bits + self.octave_bits

    def encode(self, frequency: Column) -> Column:
        note = midi(frequency)
        positions = self.class_bits - self.class_width + 1
        start = (F.round(F.pmod(note, F.lit(12.0)) / 12.0 * F.lit(float(positions))) % F.lit(positions)).cast("int")
        octave = clamp(F.floor(note / 12.0) - 1, self.min_octave, self.max_octave)
        x = (octave - F.lit(self.min_octave)) / F.lit(float(self.max_octave - self.min_octave))
        return self.within(frequency > 0, joined(block(start, self.class_width), run(x, self.octave_bits, self.octave_width, self.class_bits)), "frequency must be positive")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _steps(values: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)


def hrv_metrics(rr: Column, unit: float = 1.0) -> Column:
    """struct(mean_rr, sdnn, rmssd, pnn50) of at least two intervals of so many ms, else null.

    Means and steps are taken in rr's own numbers and scaled then, so that scaling intervals that are exactly 50 ms apart
    doesn't put them on one side or the other.
    """
    n, rr = F.size(rr), rr.cast("array<double>")
    mean, ms = _sum(rr) / n, F.lit(float(unit))
    sd = F.sqrt(_sum(F.transform(rr, lambda x: (x - mean) * (x - mean))) / (n - 1)) * ms
    steps = F.transform(_steps(rr), lambda d: d * ms)
    rmssd = F.sqrt(_sum(F.transform(steps, lambda d: d * d)) / (n - 1))
    pnn = F.size(F.filter(steps, lambda d: F.abs(d) > 50)) / (n - 1) * 100.0
    return F.when(n >= 2, F.struct((mean * ms).alias("mean_rr"), sd.alias("sdnn"), rmssd.alias("rmssd"), pnn.alias("pnn50")))


def beats_per_minute(mean_rr: Column) -> Column:
    return F.when(mean_rr > 0, F.lit(60_000.0) / mean_rr)


@dataclass
class HrvEncoder(Encoder):
    """Blocks for mean interval, SDNN, RMSSD and pNN50: each (bits, width, low, high)."""

    mean_rr: tuple = (50, 10, 400.0, 1500.0)
    sdnn: tuple = (40, 8, 10.0, 200.0)
    rmssd: tuple = (40, 8, 10.0, 150.0)
    pnn50: tuple = (30, 6, 0.0, 100.0)

    def __post_init__(self):
        self.fields = {n: getattr(self, n) for n in ("mean_rr", "sdnn", "rmssd", "pnn50")}
        require(all(0 < w <= b and lo < hi for b, w, lo, hi in self.fields.values()), "width", "must be positive and at most the bits")
        self.size = sum(b for b, *_ in self.fields.values())

    def encode(self, metrics: Column) -> Column:
        """metrics: the struct that hrv_metrics() gives."""
        parts, offset = [], 0
        for name, (bits, width, low, high) in self.fields.items():
            parts.append(run(scaled(metrics[name], low, high), bits, width, offset))
            offset += bits
        return F.when(metrics.isNotNull(), joined(*parts))


def ecg_stats(samples: Column) -> Column:
    """struct(max, min, mean, std, zero_crossings); the standard deviation is the population's."""
    n = F.size(samples)
    mean = _sum(samples) / n
    sd = F.sqrt(_sum(F.transform(samples, lambda x: (x - mean) * (x - mean))) / n)
    sign = F.transform(samples, lambda x: (x >= 0).cast("int"))
    crossings = F.size(F.filter(_steps(sign), lambda d: d != 0))
    return F.when(n > 0, F.struct(F.array_max(samples).alias("max"), F.array_min(samples).alias("min"), mean.alias("mean"), sd.alias("std"), crossings.alias("zero_crossings")))


@dataclass
class EcgEncoder(WaveformEncoder):
    """A block per sample, and one for each of five statistics of the window."""

    samples: int = 50
    bits_per_sample: int = 10
    width_per_sample: int = 3
    minimum: float = -2.0
    maximum: float = 2.0
    stats_bits: int = 60
    stats_width: int = 15

    def __post_init__(self):
        super().__post_init__()
        self.wave = self.size
        self.size += self.stats_bits

    def encode(self, samples: Column) -> Column:
        s, bits, width = ecg_stats(samples), self.stats_bits // 5, self.stats_width // 5
        values = [scaled(s[k], self.minimum, self.maximum) for k in ("max", "min", "mean")]
        values += [clamp(s["std"] / F.lit(self.maximum - self.minimum), 0.0, 1.0), clamp(s["zero_crossings"] / F.lit(float(self.samples)), 0.0, 1.0)]
        stats = [run(v, bits, width, self.wave + k * bits) for k, v in enumerate(values)]
        return self.within(F.size(samples) == self.samples, joined(self.blocks(samples), *stats), "wrong number of samples")


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def tilt(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pitch and roll in radians."""
    m = magnitude(x, y, z)
    return F.when(m == 0, F.lit(0.0)).otherwise(F.asin(y / m)), F.atan2(x, z)


def is_level(x: Column, y: Column, z: Column, tolerance: float) -> Column:
    pitch, roll = tilt(x, y, z)
    return (F.abs(pitch) < tolerance) & (F.abs(roll) < tolerance)


def is_motion(x: Column, y: Column, z: Column, threshold: float) -> Column:
    return F.abs(magnitude(x, y, z) - 1.0) > threshold


@dataclass
class AccelerometerEncoder(Encoder):
    """Blocks for the three axes, the magnitude, pitch and roll; accelerations in g."""

    axis_bits: int = 32
    axis_width: int = 8
    magnitude_bits: int = 32
    magnitude_width: int = 8
    orientation_bits: int = 64
    orientation_width: int = 16
    top: float = 4.0

    def __post_init__(self):
        require(self.top > 0, "top", "must be positive")
        self.size = 3 * self.axis_bits + self.magnitude_bits + self.orientation_bits

    def encode(self, x: Column, y: Column, z: Column) -> Column:
        pitch, roll = tilt(x, y, z)
        half, width, at = self.orientation_bits // 2, self.orientation_width // 2, 3 * self.axis_bits
        parts = [run(scaled(v, -self.top, self.top), self.axis_bits, self.axis_width, k * self.axis_bits) for k, v in enumerate((x, y, z))]
        parts.append(run(scaled(magnitude(x, y, z), 0.0, self.top), self.magnitude_bits, self.magnitude_width, at))
        parts.append(run(scaled(pitch, -math.pi / 2, math.pi / 2), half, width, at + self.magnitude_bits))
        parts.append(run(scaled(roll, -math.pi, math.pi), half, width, at + self.magnitude_bits + half))
        return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), joined(*parts).cast(BITS))
