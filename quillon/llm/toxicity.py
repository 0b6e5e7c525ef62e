"""A counterfactual-regularised toxicity classifier.

Logistic regression on which hashed words (ASCII lower case, outer punctuation off) a text has. For labelled texts,
counterfactuals are made: where a text mentions an identity term, that term is swapped for another one of its list;
where it mentions none, a neutral mention is put in. The loss adds the squared change of the score (as a logit) from
text to counterfactual, so that the model can't lean on the mention of a group. Each word's feature has the size of its
log-odds between the labels (add-one smoothed), so that words without a link to the label hardly get a weight.

Fitting takes at most ``max_rows`` labelled rows with at most ``max_words`` distinct words in all, those with the smallest
hash of doc_id, which bounds what the driver holds: only hashed words travel to it. Scoring covers every row. Labels,
language, source and doc_id are never inputs of a score. Null and empty texts have no words and get the score of the bias
alone. With no labelled rows, or labels of one kind, all scores are that label's smoothed rate. If a doc_id has several
labels, the greatest counts; if it has several texts, the one with the smallest hash is learned. In scoring, rows are
never merged; other columns take no part unless they are named in ``keep``, and must not be called score or predicted.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, stage_table, unused

FEATURES = 1 << 18
MAX_ROWS, MAX_WORDS = 12_000, 20_000_000
#: A feature counts if so many fitted rows have it.
MIN_ROWS = 4
STEPS, RATE, RIDGE, FAIRNESS = 150, 0.1, 5e-4, 1.0
THRESHOLD = 0.3
#: Identity terms that may stand for each other (fixed values; a parameter of fit()).
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "atheist"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("immigrants", "refugees", "foreigners", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
)
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes | None) -> set[bytes]:
    return {w for x in set((text or b"").lower().split()) if (w := x.strip(_EDGE))}


def _ids(words: set[bytes]) -> list[int]:
    return [zlib.crc32(w) % FEATURES for w in words]


def _counterfactual(words: set[bytes], groups: tuple[tuple[str, ...], ...], seed: int) -> tuple[list[int], list[int]]:
    """The features that go and those that come when a group is mentioned in another's place, or is mentioned at all."""
    away, here = set(), set()
    for group in groups:
        terms = [t.encode() for t in group]
        for k, t in enumerate(terms):
            if t in words:
                away.add(t)
                here.add(terms[(k + 1 + seed % (len(terms) - 1)) % len(terms)])
    if not away:
        group = groups[seed % len(groups)]
        here = {group[seed // 7 % len(group)].encode()}
    both = away & here
    return _ids(away - both), _ids(here - both)


class Model:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, text: bytes | None) -> float:
        ids = np.unique(_ids(words_of(text)))
        z = self.bias + (float(self.weight[ids].sum()) if len(ids) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(ids: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Full-batch Adam on the mean log loss, the ridge and the squared change of counterfactuals."""
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (n + 1) if n else 0.0
        return Model(np.zeros(FEATURES, np.float32), float(np.log(max(rate, 1e-6) / (1 - rate))))
    used = np.flatnonzero(np.bincount(np.concatenate(ids), minlength=FEATURES) >= MIN_ROWS)
    terms = np.unique(np.concatenate([np.concatenate(s) for s in swaps])).astype(np.int64)
    used = np.union1d(used, terms)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))

    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        col = place[np.concatenate(lists).astype(np.int64)]
        return row[col >= 0], col[col >= 0]

    row, col = flat(ids)
    off_row, off_col = flat([s[0] for s in swaps])
    on_row, on_col = flat([s[1] for s in swaps])
    m, d = len(swaps), len(used)
    toxic = labels.sum()
    with_word, toxic_word = np.bincount(col, minlength=d), np.bincount(col, labels[row], d)
    size = np.abs(np.log((toxic_word + 1) / (toxic + 2)) - np.log((with_word - toxic_word + 1) / (n - toxic + 2)))
    w, bias = np.zeros(d), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean())))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, STEPS + 1):
        v = w * size
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, v[col], n), -30, 30)))
        e = (p - labels) / n
        change = np.bincount(on_row, v[on_col], m) - np.bincount(off_row, v[off_col], m)
        g = np.bincount(col, e[row], d) + FAIRNESS / m * (np.bincount(on_col, change[on_row], d) - np.bincount(off_col, change[off_row], d))
        g = np.append(size * g + RIDGE * w, e.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weight = np.zeros(FEATURES, np.float32)
    weight[used] = w * size
    return Model(weight, float(bias))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Learns from labelled rows of docs (doc_id, text) and labels (doc_id, toxic)."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
    rows = rows.select("doc_id", "first.text", "toxic")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, off, on = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(x)
                swap = _counterfactual(words, groups, zlib.crc32(str(k).encode()))
                ids.append(np.unique(_ids(words)).astype(np.int32))
                off.append(swap[0])
                on.append(swap[1])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, kind), pa.array(off, kind), pa.array(on, kind)], ["doc_id", "toxic", "ids", "off", "on"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, f"doc_id {kind}, toxic int, ids array<int>, off array<int>, on array<int>")
    made = stage_table(docs.sparkSession, made, "labelled-words")
    so_far = F.sum(F.size("ids").cast("long")).over(Window.orderBy(order, "doc_id"))  # max_rows rows at most
    fits = made.select("doc_id", so_far.alias("words")).where(F.col("words") <= max_words).select("doc_id")
    got = made.join(F.broadcast(fits), "doc_id").toArrow().sort_by("doc_id")

    def lists(name: str) -> list[np.ndarray]:
        c = got.column(name).combine_chunks()
        c = c.chunk(0) if hasattr(c, "chunk") else c
        return np.split(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()[1:-1]) if len(c) else []

    return train(lists("ids"), (got.column("toxic").to_numpy() > 0).astype(float), list(zip(lists("off"), lists("on"), strict=True)))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[Column], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of docs with score and predicted; one pass without a shuffle."""
    shared = spark.sparkContext.broadcast(model)  # FEATURES weights
    rows = docs.select(*keep, F.col(text).alias(unused("text", docs.select(*keep).columns)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = np.array([shared.value.score(x) for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], float)
            made = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "score", "predicted"])

    fields = rows.schema.fields[:-1]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out() -> Column:
    return fold(F.col("doc_id"), 4) == 2
