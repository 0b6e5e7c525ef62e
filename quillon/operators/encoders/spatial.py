"""Encoders of places: coordinates, latitude and longitude, grid cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import bits_udf, fnv_numbers

from .base import Encoder

EARTH_RADIUS = 6_371_000.0


def _distinct(hashes: np.ndarray, size: int, count: int) -> list[list[int]]:
    """The first count distinct values modulo size of each row."""
    out = []
    for row in (hashes % np.uint64(size)).astype(np.int64).tolist():
        out.append(list(dict.fromkeys(row))[:count])
    return out


@dataclass
class CoordinateEncoder(Encoder):
    """Hashed bits of the cell that a point lies in; neighbouring cells have nothing in common."""

    num_dimensions: int = 2
    size: int = 1000
    width: int = 21
    radius: float = 1.0

    def __post_init__(self):
        require(self.num_dimensions > 0, "num_dimensions", "must be positive")
        require(0 < self.width <= self.size, "width", "must be positive and at most size")
        require(self.radius > 0, "radius", "must be positive")

    def cell(self, value: Column) -> Column:
        return F.round(value / F.lit(float(self.radius))).cast("long")

    def encode(self, *coordinates: Column) -> Column:
        require(len(coordinates) == self.num_dimensions, "coordinates", f"expected {self.num_dimensions}")

        def function(*cells):
            ok = np.logical_and.reduce([c.notna().to_numpy() for c in cells])
            own = [c[ok].to_numpy(dtype=np.int64) for c in cells]
            tries = self.width * 4
            hashes = np.stack([fnv_numbers(np.full(ok.sum(), k, np.int64), *own) for k in range(tries)], axis=1)
            found = iter(self._more(_distinct(hashes, self.size, self.width), own))
            return [next(found) if good else None for good in ok]

        return bits_udf(function)(*[self.cell(c) for c in coordinates])

    def _more(self, found: list[list[int]], cells: list[np.ndarray]) -> list[list[int]]:
        """Rows that are still short of bits go on, up to 100 tries a bit."""
        for k, bits in enumerate(found):
            index = self.width * 4
            while len(bits) < self.width and index <= self.width * 100:
                bit = int(fnv_numbers(index, *[int(c[k]) for c in cells]) % np.uint64(self.size))
                if bit not in bits:
                    bits.append(bit)
                index += 1
        return found


@dataclass
class GeospatialEncoder(Encoder):
    """Hashed bits of the cell of a latitude and longitude, at scales that double."""

    size: int = 1000
    width: int = 21
    scale: float = 100.0
    num_scales: int = 1
    strict: bool = True

    def __post_init__(self):
        require(0 < self.width <= self.size, "width", "must be positive and at most size")
        require(self.scale > 0 and self.num_scales > 0, "scale", "must be positive")

    @staticmethod
    def metres(lat: Column, lon: Column) -> tuple[Column, Column]:
        return F.radians(lat) * EARTH_RADIUS, F.radians(lon) * EARTH_RADIUS * F.cos(F.radians(lat))

    def encode(self, lat: Column, lon: Column) -> Column:
        y, x = self.metres(lat, lon)
        cells = [F.floor(v / F.lit(self.scale * (1 << k))).cast("long") for k in range(self.num_scales) for v in (y, x)]
        share = self.width // self.num_scales

        def function(*columns):
            ok = columns[0].notna().to_numpy()
            out: list[set[int]] = [set() for _ in range(int(ok.sum()))]
            for k in range(self.num_scales):
                a, b = (c[ok].to_numpy(dtype=np.int64) for c in columns[2 * k : 2 * k + 2])
                want = self.width if k == self.num_scales - 1 else (k + 1) * share  # the last scale takes the remainder
                hashes = np.stack([fnv_numbers(a, b, k, j) for j in range(self.width * 6)], axis=1) if len(a) else np.zeros((0, 0), np.uint64)
                for bits, row in zip(out, (hashes % np.uint64(self.size)).tolist(), strict=True):
                    for bit in row:
                        if len(bits) >= want:
                            break
                        bits.add(bit)
            found = iter(out)
            return [next(found) if good else None for good in ok]

        good = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
        return self.within(good, bits_udf(function)(*cells), "latitude or longitude out of range")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


@dataclass
class GridCellEncoder(Encoder):
    """One active bit per module: the cell of a square grid that is scaled and rotated module by module."""

    num_modules: int = 4
    cells_per_module: int = 16
    base_scale: float = 1.0
    ratio: float = 1.5
    turn: float = math.pi / 6

    def __post_init__(self):
        self.side = math.isqrt(self.cells_per_module)
        require(self.side**2 == self.cells_per_module, "cells_per_module", "must be a square")
        require(self.num_modules > 0, "num_modules", "must be positive")
        self.size = self.num_modules * self.cells_per_module

    def encode(self, x: Column, y: Column) -> Column:
        bits = []
        for k in range(self.num_modules):
            scale, c, s = self.base_scale * self.ratio**k, math.cos(k * self.turn), math.sin(k * self.turn)

            def cell(v: Column, scale=scale) -> Column:
                return F.least(F.floor(F.pmod(v / F.lit(scale), F.lit(float(self.side)))), F.lit(self.side - 1)).cast("int")

            bits.append(cell(x * s + y * c) * F.lit(self.side) + cell(x * c - y * s) + F.lit(k * self.cells_per_module))
        return F.when(x.isNotNull() & y.isNotNull(), F.array(*bits))
