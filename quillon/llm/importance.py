"""Quality selection by importance resampling.

Two multinomials over hashed word n-grams (unigrams and bigrams of ASCII-lower-cased words) are counted: one over the
target texts, one over all texts. A document's log-weight is the sum over its n-grams of the log ratio of the two. Adding
Gumbel noise, drawn from a hash of doc_id, and taking the k largest samples k documents without replacement, in
proportion to their weights. The k-th largest key is found exactly by counting in ever finer bins.

The raw counts cover all documents. The target takes at most ``max_target`` labelled rows, those with the smallest hash
of doc_id, which bounds what is broadcast. Null and empty texts have no n-grams and log-weight 0. Rows that tie with
the k-th key, such as repeated rows, are all selected. No rows give no rows. k is a fraction of the rows, rounded up.
Other columns of docs take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, mix, stage_table, text_chunks, unused

BUCKETS = 10_000
MAX_TARGET = 50_000
SMOOTHING = 1.0
KEEP = 0.85
SEED = 7
#: Keys that the driver may gather to find the k-th.
FEW = 4096


def _buckets(texts: list[bytes | None]):
    """For runs of texts: (from, to, buckets of all n-grams, first n-gram of each text)."""
    for k, j, chunk in text_chunks([x and x.lower() for x in texts]):
        h = chunk.hashes()
        pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
        same = np.ones(len(pair), bool)
        inner = chunk.first[1:-1]
        same[inner[(inner > 0) & (inner < len(h))] - 1] = False  # a pair doesn't cross texts
        both = np.empty(2 * len(h), np.int64)
        both[0::2] = (h % np.uint64(BUCKETS)).astype(np.int64)
        both[1::2] = -1
        if len(pair):
            both[1:-1:2][same] = (pair[same] % np.uint64(BUCKETS)).astype(np.int64)
        counts = np.concatenate([[0], np.cumsum(both >= 0)])
        yield k, j, both[both >= 0], counts[2 * np.minimum(chunk.first, len(h))]


def log_ratios(docs: DataFrame, target: Column, text: str = "text") -> np.ndarray:
    """The log ratio of target to raw for each bucket; ``target`` is a boolean column of docs."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            wanted = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
            for k, j, bucket, first in _buckets(as_bytes(batch.column(0))):
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                mine = np.repeat(wanted[k:j], np.diff(first))
                total[1] += np.bincount(bucket[mine], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    sums = docs.select(F.col(text), target).mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # BUCKETS rows
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["target"]
    if not aim.any():
        return np.zeros(BUCKETS)
    p = (aim + SMOOTHING) / (aim.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p / q)


def weigh(spark: SparkSession, docs: DataFrame, ratios: np.ndarray, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with n_grams and log_weight."""
    shared = spark.sparkContext.broadcast(ratios)
    rows = docs.select(*keep, F.col(text).alias(unused("text", docs.select(*keep).columns)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, w = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, bucket, first in _buckets(as_bytes(batch.column(batch.num_columns - 1))):
                total = np.concatenate([[0.0], np.cumsum(shared.value[bucket])])
                n.append(np.diff(first))
                w.append(np.diff(total[first]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(n)), pa.array(np.concatenate(w))], [*batch.schema.names[:-1], "n_grams", "log_weight"])

    fields = rows.schema.fields[:-1]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())]))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of doc_id; null counts as the empty text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, 1 <= k <= rows; the driver sees bin counts and at most FEW or tied values."""
    low, high, c = *df.agg(F.min(column), F.max(column)).first(), F.col(column)
    while low < high:
        width = (high - low) / FEW
        bins = df.where(c.between(low, high)).groupBy(F.least(F.floor((c - low) / width), F.lit(FEW - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if k <= r["n"]:
                if (r["low"], r["high"]) == (low, high):  # no finer bins than doubles
                    return high
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, keep: float = KEEP, max_target: int = MAX_TARGET, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, selected) for each row of docs (doc_id, text); labels: (doc_id, quality)."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    target = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).withColumn("__target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), "doc_id", "left")  # max_target ids at most
    ratios = log_ratios(marked, F.coalesce("__target", F.lit(False)))
    keyed = weigh(spark, docs, ratios, [F.col("doc_id")]).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    keyed = stage_table(spark, keyed, "importance")
    n = keyed.count()
    least = kth_largest(keyed, "key", max(1, -int(-n * keep // 1))) if n else 0.0
    return keyed.withColumn("selected", F.col("key") >= F.lit(least))
