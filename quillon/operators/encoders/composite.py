"""Encoders made of encoders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import shifted

from .base import Encoder


@dataclass
class MultiEncoder(Encoder):
    """Named encoders side by side, each over its own columns; fields has their offsets and sizes."""

    parts: list[tuple[str, Encoder]]

    def __post_init__(self):
        require(bool(self.parts), "parts", "give at least one encoder")
        require(len({n for n, _ in self.parts}) == len(self.parts), "parts", "names must be distinct")
        self.fields, offset = {}, 0
        for name, e in self.parts:
            self.fields[name] = (offset, e.size)
            offset += e.size
        self.size = offset

    def encode(self, *values: Column | tuple[Column, ...]) -> Column:
        """One value for all parts, or one (or a tuple of columns) for each."""
        require(len(values) in (1, len(self.parts)), "values", f"give 1 or {len(self.parts)}")
        values = values * len(self.parts) if len(values) == 1 else values
        bits = [shifted(e.encode(*(v if isinstance(v, tuple) else (v,))), self.fields[n][0]) for (n, e), v in zip(self.parts, values, strict=True)]
        return F.concat(*bits)

    def field(self, bits: Column, name: str) -> Column:
        """The bits of one part, counted from its own start."""
        offset, size = self.fields[name]
        return F.transform(F.filter(bits, lambda b: (b >= offset) & (b < offset + size)), lambda b: b - F.lit(offset))
