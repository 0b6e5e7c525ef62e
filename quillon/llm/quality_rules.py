"""Quality rules: counts of a text, and a length-normalised log-likelihood ratio of hashed n-grams. DataFrame functions only.

Two multinomials are counted over hashed n-grams: the words, and the pairs of consecutive words. One covers the trusted
target (all labelled rows of quality 1), the other all texts. A document's ratio is the mean, over its n-grams, of
log(target / raw). A document is kept if it passes the base rules and its mean ratio is at least ``threshold``.

Both counts cover all rows. The target's ids are broadcast if there are at most ``BROADCAST_IDS``, else joined by a
shuffle. The ratios are 2 * BUCKETS numbers, whatever the input's size. Null and empty texts have no words and fail the
base rules. Without target rows all ratios are 0. Repeated rows and null ids are judged row by row: scoring has neither
a join nor a shuffle. Columns of docs that have the name of a result are replaced, all others pass through; names that
begin with "__quality" are the operator's own. A filter on other columns doesn't reach the scan from behind ``judge``
(see ``settled``): filter before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

BUCKETS = 8192
BROADCAST_IDS = 1_000_000
#: In nats an n-gram. On the 0.1 test table no row of quality 1 that passes the base rules is below -0.05, and most rows of
#: quality 0 are below -0.2; in tables of few labels, good texts of a language without any come near to -0.2.
THRESHOLD = -0.2
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def settled(value: Column) -> Column:
    """value, as an expression that the optimizer neither copies into its users nor moves a filter below.

    Else a filter on a result would have the words split again for each word that a lambda function looks at.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def base_columns(text: str, w: str) -> dict[str, Column]:
    """The counts, from a text column without nulls and its array of words."""
    full = F.col(text)
    solid = F.translate(full, SPACES, "")
    lines = F.filter(F.split(full, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def with_repeat_words(df: DataFrame, w: str, hashes: str, name: str, hash_bits: int = 64) -> DataFrame:
    """df with the number of words that lie in a 3-word window found twice or more in the text.

    Each window is a long: its hash above, its position below, so that a sort of primitives brings equal windows
    together. Neighbours with the same upper bits are compared word by word. If they differ, windows of one text clash;
    that text's windows are sorted as strings instead. So the count is exact. Fewer ``hash_bits`` are for tests.
    """
    low = "shiftleft(1L, __quality_bits) - 1L"
    df = df.withColumn("__quality_bits", F.ceil(F.log2(F.size(w) + F.lit(1.0))).cast("int"))
    first = f"slice({hashes}, 1, greatest(size({hashes}) - 2, 0))"
    whole = f"xxhash64(x, get({hashes}, i + 1), get({hashes}, i + 2))"
    key = whole if hash_bits == 64 else f"pmod({whole}, {1 << hash_bits}L)"
    keys = F.expr(f"transform({first}, (x, i) -> shiftleft({key}, __quality_bits) | cast(i as bigint))")
    df = df.withColumn("__quality_keys", settled(F.sort_array(keys)))

    def as_before(x: Column, i: Column) -> Column:
        """0: another hash than the key before, 1: the same window, 2: the same hash of another window."""
        y = F.get(F.col("__quality_keys"), i - 1)
        p, q = (v.bitwiseAND(F.expr(low)).cast("int") for v in (x, y))
        same = F.lit(True)
        for k in range(3):
            same = same & (F.get(F.col(w), p + k) == F.get(F.col(w), q + k))
        near = F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("__quality_bits")) == 0
        return F.when(i == 0, 0).when(~near, 0).when(same, 1).otherwise(2)

    df = df.withColumn("__quality_same", settled(F.transform("__quality_keys", as_before)))
    windows = F.expr(f"sort_array(transform({first}, (x, i) -> struct(concat_ws(' ', get({w}, i), get({w}, i + 1), get({w}, i + 2)) as s, i as p)))")
    df = df.withColumn("__quality_windows", settled(F.when(F.array_contains("__quality_same", 2), windows)))
    plain = F.expr(f"transform(filter(transform(__quality_keys, (x, i) -> if(get(__quality_same, i) = 1 or get(__quality_same, i + 1) = 1, x & ({low}), -1L)), x -> x >= 0), x -> cast(x as int))")
    exact = F.expr("transform(filter(__quality_windows, (x, i) -> coalesce(x.s = get(__quality_windows, i - 1).s, false) or coalesce(x.s = get(__quality_windows, i + 1).s, false)), x -> x.p)")
    df = df.withColumn("__quality_at", settled(F.sort_array(F.when(F.col("__quality_windows").isNull(), plain).otherwise(exact))))
    width = F.expr("transform(__quality_at, (p, i) -> least(3, coalesce(get(__quality_at, i + 1) - p, 3)))")
    return df.withColumn(name, F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__quality_bits", "__quality_keys", "__quality_same", "__quality_windows", "__quality_at")


def _word_bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pair_bucket(h: Column, after: Column) -> Column:
    return (F.pmod(F.xxhash64(h, after), F.lit(BUCKETS)) + BUCKETS).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, add-one smoothed, over all rows of docs (doc_id, text)."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("__quality_target", F.lit(1))
    docs = docs.select("doc_id", "text")
    if good.count() <= BROADCAST_IDS:
        marked = docs.join(F.broadcast(good), "doc_id", "left")
    else:  # null ids have no label, and are kept out of the shuffle
        marked = docs.where("doc_id is not null").join(good, "doc_id", "left").unionByName(docs.where("doc_id is null").withColumn("__quality_target", F.lit(None).cast("int")))
    hashed = marked.select(F.coalesce("__quality_target", F.lit(0)).alias("t"), settled(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("h"))
    pairs = F.zip_with(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))), F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), _pair_bucket)
    grams = hashed.select("t", F.explode(F.concat(F.transform("h", _word_bucket), pairs)).alias("bucket"))
    sums = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # 2 * BUCKETS rows
    raw, aim = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for r in sums:
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["target"]
    if not sum(aim):
        return [0.0] * (2 * BUCKETS)
    out = []
    for k in (0, BUCKETS):
        n, m = sum(raw[k : k + BUCKETS]), sum(aim[k : k + BUCKETS])
        out += [math.log((a + 1) / (m + BUCKETS)) - math.log((b + 1) / (n + BUCKETS)) for a, b in zip(aim[k : k + BUCKETS], raw[k : k + BUCKETS], strict=True)]
    return out


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    A column of docs that has the name of one of these is replaced.
    """
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in log_ratios(docs, labels))), ",").cast("array<double>")
    df = docs.withColumn("__quality_text", F.coalesce("text", F.lit(""))).withColumn("__quality_words", settled(words(F.col("__quality_text"))))
    df = df.withColumn("__quality_hashes", settled(F.transform("__quality_words", lambda w: F.xxhash64(w))))
    df = df.withColumns(base_columns("__quality_text", "__quality_words"))
    df = with_repeat_words(df, "__quality_words", "__quality_hashes", "n_repeat_words")

    def ratio(h: Column, i: Column) -> Column:
        after = F.get(F.col("__quality_hashes"), i + 1)
        return F.get(ratios, _word_bucket(h)) + F.when(after.isNull(), F.lit(0.0)).otherwise(F.get(ratios, _pair_bucket(h, after)))

    total = F.aggregate(F.transform("__quality_hashes", ratio), F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("llr", settled(total / F.greatest(F.lit(1), 2 * F.col("n_words") - 1)))
    df = df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("__quality_text", "__quality_words", "__quality_hashes")
