"""Language identification by bit-sliced Bloom filters of n-grams.

Learning counts the letter n-grams of the texts of each language, over all learning rows. An n-gram belongs to a
language if it makes up at least ``MIN_SHARE`` of that language's n-grams and at least ``MIN_RATIO`` of the greatest
share that it has in any language. The filters of all languages lie side by side: slot s of the table is a bitmask
whose bit l is slot s of the filter of language l. Looking an n-gram up is the AND of its ``HASHES`` slots, which
gives all languages that contain it. A text's n-grams are looked up together; per language the bits are counted, the
count expected from false positives (fill of that filter to the power HASHES) is taken off, and the largest count wins.

Null texts and texts without a letter are ``und`` with score 0. Texts whose n-grams no language contains get the
language with the most learning rows' n-grams and score 0. Ties go to the alphabetically first language. Any number of
languages: each 64 have a word of their own in a slot. With no learning rows every text is ``und``. Rows are never merged,
so repeated rows and null ids are kept as they are. Other columns take no part unless they are named in ``keep``, and
must not be called lang_pred or score.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_table, unused

SIZE = 3
HASHES = 2
#: Slots of each filter: bounds what the driver gathers and broadcasts (8 bytes a slot).
SLOTS = 1 << 18
#: n-grams are told apart by so many bits.
GRAM_BITS = 22
MIN_SHARE = 2e-5
MIN_RATIO = 0.15
#: Characters that one numpy pass takes; and n-grams that a task holds before it passes its counts on.
CHUNK, MERGE = 1 << 21, 1 << 23


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its own number if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def _gram_ids(text: str):
    """Ids below 2**GRAM_BITS of the n-grams of letters, in arrays; what isn't a letter is one boundary character.

    A long text is taken in parts of CHUNK characters; the last characters of a part go before the next one.
    """
    text, before = text.lower(), np.zeros(1, np.uint32)
    for k in range(0, len(text), CHUNK):
        code = _letters()[np.frombuffer(text[k : k + CHUNK].encode("utf-32-le", "replace"), np.uint32)]
        code = np.concatenate([before, code, np.zeros(int(k + CHUNK >= len(text)), np.uint32)])
        code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]].astype(np.uint64)  # one boundary where there are several
        before = code[-(SIZE - 1) :].astype(np.uint32)
        n = len(code) - SIZE + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for j in range(SIZE):
                h = h * np.uint64(0x100000001B3) + code[j : j + n]
            yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    g = gram.astype(np.uint64) + np.uint64(1)
    return [((g * np.uint64(m)) >> np.uint64(20)).astype(np.int64) % SLOTS for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[:HASHES]]


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows of docs; each task adds up its own rows first, MERGE distinct n-grams at a time."""

    def run(batches):
        import pyarrow as pa

        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged():
            for l, own in parts.items():
                ids, at = np.unique(np.concatenate([p[0] for p in own]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in own])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(ids), pa.string()), pa.array(ids), pa.array(n)], ["lang", "gram", "n"])

        size = 0
        for batch in batches:
            by: dict[str, list[str]] = {}
            for x, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(l, []).append(x)
            for l, xs in by.items():
                for ids in _gram_ids("\n".join(xs)):
                    parts.setdefault(l, []).append(np.unique(ids, return_counts=True))
                    size += len(parts[l][-1][0])
                if size > MERGE:
                    yield from merged()
                    parts, size = {}, 0
        yield from merged()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The languages, in order, and the bitmask of each slot: an array (slot, word of 64 languages)."""

    def __init__(self, langs: list[str], mask: np.ndarray, most: int):
        self.langs, self.mask, self.most = langs, mask, most
        fill = [float(((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        counts, n = np.zeros(64 * self.mask.shape[1]), 0
        for gram in _gram_ids(text):
            found = functools.reduce(np.bitwise_and, (self.mask[s] for s in _slots(gram)))
            for word in range(found.shape[1]):
                kinds, times = np.unique(found[:, word], return_counts=True)
                counts[64 * word : 64 * word + 64] += (((kinds[:, None] >> _SHIFT) & np.uint64(1)) * times[:, None]).sum(axis=0)
            n += len(gram)
        if not n:
            return "und", 0.0
        counts = np.maximum(0.0, (counts[: len(self.langs)] - n * self.false) / np.maximum(1e-9, 1 - self.false))
        if not counts.any():
            return self.langs[self.most], 0.0
        best = int(np.argmax(counts))
        return self.langs[best], float(counts[best] / counts.sum())


_SHIFT = np.arange(64, dtype=np.uint64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Learns from all rows of docs with a text and a language. The driver gathers SLOTS bitmasks for each 64 languages."""
    spark = docs.sparkSession
    counts = stage_table(spark, gram_counts(docs, text, lang), "gram-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    langs = sorted(totals)
    mask = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
    if not langs:
        return Filters([], mask, 0)
    known = spark.createDataFrame([(l, k // 64, k % 64, float(totals[l])) for k, l in enumerate(langs)], "lang string, word int, bit int, total double")
    share = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    own = share.join(best, "gram").where((F.col("share") >= MIN_SHARE) & (F.col("share") >= MIN_RATIO * F.col("best")))
    masks = own.groupBy("gram", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

    def to_slots(batches):
        import pyarrow as pa

        for batch in batches:
            for s in _slots(batch.column(0).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1), batch.column(2)], ["slot", "word", "mask"])

    rows = masks.mapInArrow(to_slots, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    mask[rows.column("slot").to_numpy(), rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Filters(langs, mask, max(range(len(langs)), key=lambda k: totals[langs[k]]))


def predict(spark: SparkSession, docs: DataFrame, filters: Filters, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score; one pass without a shuffle."""
    shared = spark.sparkContext.broadcast(filters)
    rows = docs.select(*keep, F.col(text).alias(unused("text", docs.select(*keep).columns)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [shared.value.predict(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = rows.schema.fields[:-1]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
