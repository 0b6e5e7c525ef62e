"""Anomaly scores and their likelihood: all native expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import require

#: Coefficients of the published rational approximation of erfc (fixed values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


MODES = ("pure", "active")


def score(active: Column, predicted: Column, mode: str = "pure") -> Column:
    """The share of active columns that weren't predicted; 0 without active ones. Both modes give the same score."""
    require(mode in MODES, "mode", f"one of {', '.join(MODES)}")
    n = F.size(active)
    return F.when(n > 0, 1 - F.size(F.array_intersect(active, predicted)) / n).when(active.isNotNull(), F.lit(0.0))


def score_of_cells(active: Column, predicted_cells: Column, cells_per_column: int) -> Column:
    return score(active, F.array_distinct(F.transform(predicted_cells, lambda c: F.floor(c / F.lit(cells_per_column)).cast("int"))))


def erfc(x: Column) -> Column:
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[1:-1]):
        poly = F.lit(c) + t * poly
    tau = t * F.exp(-x * x + ERFC[0] + t * poly)
    return F.when(x >= 0, tau).otherwise(2.0 - tau)


@dataclass(frozen=True)
class Likelihood:
    """How unlikely a score is, against the mean and variance of the latest scores, re-estimated now and then.

    0.5 while learning. Estimates are made at rows max(learning, every) + k * every, over the last samples scores.
    """

    learning: int = 288
    samples: int = 100
    every: int = 100

    def __post_init__(self):
        require(min(self.learning, self.samples, self.every) > 0, "learning", "all parameters must be positive")

    def add(self, df: DataFrame, value: str, series: list[str], order: list[str], name: str = "likelihood") -> DataFrame:
        """df with the likelihood of its column value; one window pass per series."""
        by = Window.partitionBy(*series).orderBy(*order)
        last = by.rowsBetween(1 - self.samples, 0)
        first = max(self.learning, self.every)
        df = df.withColumn("__i", F.row_number().over(by)).withColumn("__m", F.avg(value).over(last)).withColumn("__v", F.var_pop(value).over(last)).withColumn("__n", F.count(F.lit(1)).over(last))
        at = (F.col("__i") >= first) & ((F.col("__i") - first) % self.every == 0) & (F.col("__n") >= 2)
        stat = F.last(F.when(at, F.struct(F.col("__m").alias("m"), F.greatest("__v", F.lit(1e-4)).alias("v"))), ignorenulls=True)
        df = df.withColumn("__s", stat.over(by.rowsBetween(Window.unboundedPreceding, 0)))
        z = (F.col(value) - F.coalesce(F.col("__s.m"), F.lit(0.5))) / F.sqrt(F.coalesce(F.col("__s.v"), F.lit(1e-4)))
        out = F.when(F.col("__i") < self.learning, F.lit(0.5)).otherwise(1 - 0.5 * erfc(z / math.sqrt(2)))
        return df.withColumn(name, out).drop("__i", "__m", "__v", "__n", "__s")
