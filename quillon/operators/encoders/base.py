"""What all encoders share: a size, and encode(), which turns columns into a column of bits.

Encoders are lazy expressions, so that filters and column pruning reach the scan. Null in, null out. With strict=True a
value outside the domain raises in the task; else it gives null.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.kernels import BITS


class Encoder(ABC):
    size: int
    strict: bool = True

    @abstractmethod
    def encode(self, *columns: Column) -> Column:
        """array<int> of active bits."""

    @property
    def dimensions(self) -> tuple[int, ...]:
        return (self.size,)

    def within(self, good: Column, bits: Column, message: str) -> Column:
        """bits where good holds; a null condition gives null."""
        bad = F.raise_error(F.lit(f"{type(self).__name__}: {message}")).cast(BITS) if self.strict else F.lit(None).cast(BITS)
        return F.when(good.isNull(), F.lit(None).cast(BITS)).when(good, bits).otherwise(bad)
