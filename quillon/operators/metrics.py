"""Quality of representations: sparsity, overlap of neighbours in time, and how evenly bits are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import sdr


def summary(df: DataFrame, bits: str, size: int, series: list[str], order: list[str]) -> DataFrame:
    """A row per series: samples; mean, standard deviation (population), least and greatest sparsity; mean, least and greatest overlap with the SDR before."""
    before = F.lag(bits).over(Window.partitionBy(*series).orderBy(*order))
    rows = df.select(*series, sdr.sparsity(F.col(bits), size).alias("s"), sdr.overlap(F.col(bits), before).alias("o"))
    agg = [F.count("*").alias("num_samples"), F.avg("s").alias("sparsity_mean"), F.stddev_pop("s").alias("sparsity_std"), F.min("s").alias("sparsity_min"), F.max("s").alias("sparsity_max")]
    agg += [F.coalesce(F.avg("o"), F.lit(0.0)).alias("overlap_mean"), F.coalesce(F.min("o"), F.lit(0)).alias("overlap_min"), F.coalesce(F.max("o"), F.lit(0)).alias("overlap_max")]
    return rows.groupBy(*series).agg(*agg)


def activation_counts(df: DataFrame, bits: str, series: list[str]) -> DataFrame:
    """(series, bit, n)."""
    return df.select(*series, F.explode(bits).alias("bit")).groupBy(*series, "bit").agg(F.count("*").alias("n"))


def activation_frequencies(df: DataFrame, bits: str, series: list[str]) -> DataFrame:
    """(series, bit, frequency) of the bits that were ever active."""
    n = df.groupBy(*series).agg(F.count("*").alias("samples"))
    counts = activation_counts(df, bits, series)
    both = counts.join(n, series) if series else counts.join(n)
    return both.select(*series, "bit", (F.col("n") / F.col("samples")).alias("frequency"))


def usage(df: DataFrame, bits: str, size: int, series: list[str]) -> DataFrame:
    """A row per series: entropy (bits) of the activations, number and share of bits that were never active."""
    return _usage_of_counts(activation_counts(df, bits, series), size, series)


def _usage_of_counts(counts: DataFrame, size: int, series: list[str]) -> DataFrame:
    total = F.sum("n")
    rows = counts.groupBy(*series).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"), (F.lit(size) - F.count("*")).alias("dead_bits"))
    return rows.withColumn("dead_ratio", F.col("dead_bits") / F.lit(float(size)))


# ---- summaries that merge: of slices of one order, of days, of stream batches

def partial(df: DataFrame, bits: str, size: int, series: list[str], order: list[str], period: Column) -> DataFrame:
    """A summary row for each series and period: (series, period, n, sums of sparsity and its square, least and greatest, overlaps, counts, first, last).

    A period is a part of the series' order, such as a day. merged() of the rows of all periods gives what summary() and
    usage() give over all rows: counts and sums add up, and the first and last SDR give the overlap across each border.
    """
    at = F.struct(*order)
    before = F.lag(bits).over(Window.partitionBy(*series, "period").orderBy(*order))
    rows = df.withColumn("period", period).select(*series, "period", at.alias("at"), F.col(bits).alias("bits"), sdr.sparsity(F.col(bits), size).alias("s"), sdr.overlap(F.col(bits), before).alias("o"))
    parts = rows.groupBy(*series, "period").agg(
        F.count("*").alias("n"), F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.min("s").alias("s_min"), F.max("s").alias("s_max"),
        F.count("o").alias("pairs"), F.sum("o").alias("o1"), F.min("o").alias("o_min"), F.max("o").alias("o_max"),
        F.min(F.struct("at", "bits")).alias("first"), F.max(F.struct("at", "bits")).alias("last"),
    )
    counts = rows.select(*series, "period", F.explode("bits").alias("bit")).groupBy(*series, "period", "bit").agg(F.count("*").alias("n"))
    counts = counts.groupBy(*series, "period").agg(F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("counts"))  # an entry for each bit
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*series, "period"]]
    return parts.alias("p").join(counts.alias("c"), keys, "left").select("p.*", "c.counts")


def merged(parts: DataFrame, size: int, series: list[str]) -> DataFrame:
    """summary() and usage() of each series, from the rows of partial() of its periods, each once and in any order."""
    before = F.lag("last").over(Window.partitionBy(*series).orderBy("first.at"))
    border = parts.withColumn("o", sdr.overlap(F.col("first.bits"), before["bits"]))
    n, pairs = F.sum("n"), F.sum(F.col("pairs") + F.col("o").isNotNull().cast("long"))
    spread = F.greatest(F.sum("s2") / n - (F.sum("s1") / n) * (F.sum("s1") / n), F.lit(0.0))
    out = border.groupBy(*series).agg(
        n.alias("num_samples"), (F.sum("s1") / n).alias("sparsity_mean"), F.sqrt(spread).alias("sparsity_std"), F.min("s_min").alias("sparsity_min"), F.max("s_max").alias("sparsity_max"),
        F.coalesce(F.sum(F.coalesce("o1", F.lit(0)) + F.coalesce("o", F.lit(0))) / F.nullif(pairs, F.lit(0)), F.lit(0.0)).alias("overlap_mean"),
        F.coalesce(F.least(F.min("o_min"), F.min("o")), F.lit(0)).alias("overlap_min"), F.coalesce(F.greatest(F.max("o_max"), F.max("o")), F.lit(0)).alias("overlap_max"),
    )
    counts = parts.select(*series, F.explode("counts").alias("bit", "n")).groupBy(*series, "bit").agg(F.sum("n").alias("n"))
    used = _usage_of_counts(counts, size, series)
    if not series:
        return out.join(used)
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"u.{c}")) for c in series]
    return out.alias("m").join(used.alias("u"), same, "left").select("m.*", "u.entropy", "u.dead_bits", "u.dead_ratio")
