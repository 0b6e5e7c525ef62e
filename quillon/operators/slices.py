"""Operators on ordered rows whose work doesn't gather in one task, however long a series is.

Rows are cut into *slices*: ranges of (series, order) of about even size, whatever the lengths of the series. A slice is one
task's work. What crosses the borders is a summary of each series in each slice, combined over the slices before it by an
associative operation (a parallel prefix): how many rows came before, and the last row. Only series that span slices have
such a carry, so there are no more of them than slices.

Only series of more rows than a task's share are cut; the others stay whole, and one sort of them gives all that is asked.
``slices`` given, all are cut.

With the row's place in its series known, windows of rows are groups: ``count_windows`` and ``likelihood`` need no more
order than that.

Rows with equal series and order are told apart by nothing, as in any window; give enough columns. Nulls sort first. The
cuts come from a bounded number of keys, those with the least hashes; they decide the evenness of slices only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import sdr

from .anomaly import Likelihood, erfc

#: Rows of a slice, or so; slices at most, which bounds carries and cuts; and keys sampled for each cut.
SLICE_ROWS, MAX_SLICES, SAMPLED = 1 << 20, 4096, 32
#: Series of up to so many rows are never cut.
WHOLE_ROWS = 1 << 14
NAMES = ("slice_", "place_", "before_")


def _literal(row, fields) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f"k{n}") for n, (v, f) in enumerate(zip(row, fields, strict=True))])


def sliced(df: DataFrame, series: list[str], order: list[str], slices: int | None = None, name: str = "slice_") -> DataFrame:
    """df with the number of each row's slice: ranges of (series, order) of about equal numbers of rows."""
    keys = df.select(*series, *order)
    if slices is None:
        slices = min(MAX_SLICES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS)))
    columns = keys.columns
    found = keys.orderBy(F.xxhash64(*columns), *columns).limit(slices * SAMPLED).orderBy(*columns).collect()  # MAX_SLICES * SAMPLED keys at most
    cuts = [found[len(found) * k // slices] for k in range(1, slices)] if found else []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    key = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(columns)])
    # Two levels of cuts, so that a row is compared with some 2 sqrt(slices) of them.
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    first = F.array(*[_literal(g[-1], keys.schema.fields) for g in groups])
    inner = F.array(*[F.array(*[_literal(c, keys.schema.fields) for c in g]) for g in groups])
    group = F.size(F.filter(first, lambda c: c <= key))
    rest = F.when(group < len(groups), F.size(F.filter(F.element_at(inner, F.least(group + 1, F.lit(len(groups)))), lambda c: c <= key))).otherwise(0)
    return df.withColumn(name, (F.least(group * step, F.lit(len(cuts))) + rest).cast("int"))


def by_length(df: DataFrame, series: list[str], whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """whole() of the rows of short series, and cut() of those of series with more rows than a task's share or a slice."""
    if not series:
        return (whole if df.count() <= WHOLE_ROWS else cut)(df)
    counts = df.groupBy(*series).agg(F.count("*").alias("rows_"))
    n, most = counts.agg(F.sum("rows_"), F.max("rows_")).first()
    limit = max(WHOLE_ROWS, min(SLICE_ROWS, (n or 0) // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if not n or most <= limit:
        return whole(df)
    long = F.broadcast(counts.where(F.col("rows_") > limit).select(*[F.col(c).alias(f"c{k}_") for k, c in enumerate(series)]))  # no more than tasks or slices
    same = [F.col(c).eqNullSafe(F.col(f"c{k}_")) for k, c in enumerate(series)]
    return whole(df.join(long, same, "left_anti")).unionByName(cut(df.join(long, same, "left_semi")))


def carried(df: DataFrame, series: list[str], order: list[str], last: list[str] = (), slices: int | None = None) -> DataFrame:
    """df with slice_, place_ (of the row in its series, from 0) and before_: the columns ``last`` of the row before, a struct, null for the first row."""
    if slices is not None:
        return _cut(df, series, order, last, slices)
    return by_length(df, series, lambda d: _whole(d, series, order, last), lambda d: _cut(d, series, order, last))


def _before(last: list[str]) -> Column:
    return F.struct(F.lit(True).alias("there"), *[F.col(c).alias(f"v{n}") for n, c in enumerate(last)])


def _whole(df: DataFrame, series: list[str], order: list[str], last: list[str]) -> DataFrame:
    by = Window.partitionBy(*series).orderBy(*order)
    return df.withColumn("slice_", F.lit(0)).withColumn("place_", F.row_number().over(by) - 1).withColumn("before_", F.lag(_before(last)).over(by))


def _cut(df: DataFrame, series: list[str], order: list[str], last: list[str], slices: int | None = None) -> DataFrame:
    rows = sliced(df, series, order, slices)
    at = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)])
    own = _before(last)
    parts = rows.groupBy(*series, "slice_").agg(F.count("*").alias("n_"), F.max_by(own, at).alias("last_"))
    earlier = Window.partitionBy(*series).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*series, "slice_", F.sum("n_").over(earlier).alias("n_"), F.last("last_").over(earlier).alias("last_")).where("n_ > 0")
    carry = carry.withColumnsRenamed({c: f"c{n}_" for n, c in enumerate(series)}).withColumnRenamed("slice_", "at_")
    here = Window.partitionBy("slice_", *series).orderBy(*order)
    rows = rows.withColumn("place_", F.row_number().over(here) - 1).withColumn("before_", F.lag(own).over(here))
    same = [F.col("slice_") == F.col("at_"), *[F.col(c).eqNullSafe(F.col(f"c{n}_")) for n, c in enumerate(series)]]
    met = rows.join(F.broadcast(carry), same, "left")  # a row for each slice at most
    met = met.withColumn("place_", F.col("place_") + F.coalesce("n_", F.lit(0))).withColumn("before_", F.coalesce("before_", "last_"))
    return met.drop("n_", "last_", "at_", *[f"c{n}_" for n in range(len(series))])


def delta(df: DataFrame, value: str, series: list[str], order: list[str], name: str = "delta", slices: int | None = None) -> DataFrame:
    """df with the value less the value before; 0 for a series' first row."""
    rows = carried(df, series, order, [value], slices)
    return rows.withColumn(name, F.coalesce(F.col(value) - F.col("before_.v0"), F.lit(0.0))).drop(*NAMES)


def summary(df: DataFrame, bits: str, size: int, series: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """metrics.summary() of series of any length."""
    rows = carried(df.select(*series, *order, bits), series, order, [bits], slices)
    rows = rows.select(*series, sdr.sparsity(F.col(bits), size).alias("s"), sdr.overlap(F.col(bits), F.col("before_.v0")).alias("o"))
    agg = [F.count("*").alias("num_samples"), F.avg("s").alias("sparsity_mean"), F.stddev_pop("s").alias("sparsity_std"), F.min("s").alias("sparsity_min"), F.max("s").alias("sparsity_max")]
    agg += [F.coalesce(F.avg("o"), F.lit(0.0)).alias("overlap_mean"), F.coalesce(F.min("o"), F.lit(0)).alias("overlap_min"), F.coalesce(F.max("o"), F.lit(0)).alias("overlap_max")]
    return rows.groupBy(*series).agg(*agg)


def count_windows(df: DataFrame, series: list[str], order: list[str], value: str, n: int, slices: int | None = None) -> DataFrame:
    """windows.count_windows() of series of any length."""
    rows = carried(df.select(*series, *order, value), series, order, [], slices)
    rows = rows.select(*series, F.floor(F.col("place_") / n).alias("window"), (F.col("place_") % n).alias("at"), F.col(value).alias("v"))
    made = rows.groupBy(*series, "window").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))  # n rows a group
    return made.where(F.size("all") == n).select(*series, "window", F.transform("all", lambda x: x["v"]).alias("samples"))


def likelihood(df: DataFrame, value: str, series: list[str], order: list[str], rule: Likelihood | None = None, name: str = "likelihood", slices: int | None = None) -> DataFrame:
    """df with Likelihood.add()'s column, for series of any length.

    The k-th estimate of a series is a mean and variance of the last rows up to row first + k * every: a group of the rows
    that it covers. A row meets the latest estimate at or before it by an equality join. Series that aren't cut have windows.
    """
    rule = rule or Likelihood()
    if slices is None:
        return by_length(df, series, lambda d: rule.add(d, value, series, order, name), lambda d: _likelihood_cut(d, value, series, order, rule, name))
    return _likelihood_cut(df, value, series, order, rule, name, slices)


def _likelihood_cut(df: DataFrame, value: str, series: list[str], order: list[str], rule: Likelihood, name: str, slices: int | None = None) -> DataFrame:
    first = max(rule.learning, rule.every)
    rows = _cut(df, series, order, [], slices).withColumn("i_", F.col("place_") + 1).withColumn("k_", F.floor((F.col("i_") - first) / rule.every))
    # Estimates that cover row i: i <= first + k * every < i + samples.
    low = F.greatest(F.ceil((F.col("i_") - first) / rule.every), F.lit(0))
    high = F.ceil((F.col("i_") + rule.samples - first) / rule.every) - 1
    covered = rows.select(*series, F.col(value).alias("v_"), F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))).alias("k_"))
    made = covered.groupBy(*series, "k_").agg(F.avg("v_").alias("m_"), F.greatest(F.var_pop("v_"), F.lit(1e-4)).alias("s_"), F.count(F.lit(1)).alias("n_")).where("n_ >= 2").drop("n_")
    made = made.withColumnsRenamed({c: f"c{n}_" for n, c in enumerate(series)}).withColumnRenamed("k_", "e_")
    same = [F.col("k_") == F.col("e_"), *[F.col(c).eqNullSafe(F.col(f"c{n}_")) for n, c in enumerate(series)]]
    met = rows.join(made, same, "left")
    z = (F.col(value) - F.coalesce(F.col("m_"), F.lit(0.5))) / F.sqrt(F.coalesce(F.col("s_"), F.lit(1e-4)))
    out = F.when(F.col("i_") < rule.learning, F.lit(0.5)).otherwise(1 - 0.5 * erfc(z / math.sqrt(2)))
    return met.withColumn(name, out).drop("i_", "k_", "e_", "m_", "s_", *NAMES, *[f"c{n}_" for n in range(len(series))])


def sessions(df: DataFrame, series: list[str], order: list[str], starts: Column, last: list[str], name: str = "session", slices: int | None = None) -> DataFrame:
    """df with the number of each row's session in its series, from 1: a session begins at a series' first row and where ``starts`` holds.

    ``starts`` may use the columns of the row and before_, whose fields v0, v1, ... are the columns ``last`` of the row before.
    """
    new = (F.col("before_").isNull() | F.coalesce(starts, F.lit(False))).cast("long")
    if slices is not None:
        return _sessions_cut(df, series, order, new, last, name, slices)

    def whole(d: DataFrame) -> DataFrame:
        so_far = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return _whole(d, series, order, last).withColumn("new_", new).withColumn(name, F.sum("new_").over(so_far)).drop("new_", *NAMES)

    return by_length(df, series, whole, lambda d: _sessions_cut(d, series, order, new, last, name))


def _sessions_cut(df: DataFrame, series: list[str], order: list[str], new: Column, last: list[str], name: str, slices: int | None = None) -> DataFrame:
    rows = _cut(df, series, order, last, slices).withColumn("new_", new)
    earlier = Window.partitionBy(*series).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*series, "slice_").agg(F.sum("new_").alias("n_"))
    carry = parts.select(*series, "slice_", F.sum("n_").over(earlier).alias("n_")).where("n_ > 0")
    carry = carry.withColumnsRenamed({c: f"c{n}_" for n, c in enumerate(series)}).withColumnRenamed("slice_", "at_")
    here = Window.partitionBy("slice_", *series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col("slice_") == F.col("at_"), *[F.col(c).eqNullSafe(F.col(f"c{n}_")) for n, c in enumerate(series)]]
    met = rows.withColumn(name, F.sum("new_").over(here)).join(F.broadcast(carry), same, "left")
    return met.withColumn(name, F.col(name) + F.coalesce("n_", F.lit(0))).drop("new_", "n_", "at_", *NAMES, *[f"c{n}_" for n in range(len(series))])
