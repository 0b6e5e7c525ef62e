"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked if they differ in at most ``distance`` bits. The bits are dealt into m partitions,
correlated bits together. If per-partition thresholds t_i >= -1 add up to distance - m + 1, two linked fingerprints
differ in at most t_i bits of some partition i (-1: never). Each distinct fingerprint gets thresholds of its own, by
dynamic programming on the candidates that a histogram of each partition's halves lets expect; it probes all
signatures within t_i of its own, and candidates are verified on the whole fingerprint within the join. So all links
are found, at any size; m only moves cost between probes and candidates.

Copies share a fingerprint and are counted once: only distinct fingerprints are partitioned, probed and joined, and a
document finds its class by its fingerprint.

Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id takes part, but never names a class; a class
with null ids only has a null component. Repeated rows are kept. Empty tables give no rows. Other columns of docs take no
part unless they are named in ``keep``; a kept column must not be called fp, fingerprint, component_id or root.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashable, spread_join, stage_table, unused
from .components import components
from .fingerprint import simhash

BITS, DISTANCE = 64, 4


def fingerprints(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with fp, the fingerprint's bits as a signed long; one pass without a shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([simhash(x) for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    rows = docs.select(*keep, F.col(text).alias(unused("text", docs.select(*keep).columns)))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _sums(fps: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all fingerprints of count(uint64 array) -> int64 array of a fixed size; each task adds up its own."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(size, np.int64)
    for r in fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def bit_matrix(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _products(fp: np.ndarray) -> np.ndarray:
    b = bit_matrix(fp).astype(np.float64)
    return np.rint(b.T @ b).astype(np.int64).ravel()


def correlated_partitions(products: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m lists of bits, of sizes that differ by one at most; each grows by the bit most correlated with it so far."""
    mean = np.diag(products) / n
    cov = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(left, key=lambda b: near[b, left].max())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: near[b, group].mean())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def probes(width: int, t: int) -> int:
    """Signatures within t bits of one of this width."""
    total, ways = 0, 1
    for e in range(t + 1):
        total += ways
        ways = ways * (width - e) // (e + 1)
    return total


def choose_m(n: int, distance: int) -> int:
    """The number of partitions with the fewest probes and, for even bits, expected candidates."""

    def cost(m: int) -> float:
        width, t = BITS // m, distance - m + 1
        each = [t // m + (k < t % m) for k in range(m)]
        return sum(probes(width, x) * (1 + n / 2**width) for x in each)

    return min(range(2, distance + 2), key=cost)


class Plan:
    """The partitions, and for each the counts of fingerprints within e bits of each value of its two halves."""

    def __init__(self, parts: list[list[int]], halves: list[list[list[int]]], within: list[list[np.ndarray]], n: int, distance: int):
        self.parts, self.halves, self.within, self.n, self.distance = parts, halves, within, n, distance

    @staticmethod
    def pick(fp: np.ndarray, bits: list[int]) -> np.ndarray:
        """The value that the bits make, in order."""
        return sum((((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)) for k, b in enumerate(bits)).astype(np.int64)

    def mask(self, k: int) -> np.uint64:
        return np.uint64(sum(1 << b for b in self.parts[k]))

    def candidates(self, fp: np.ndarray, k: int) -> np.ndarray:
        """For t = 0 to distance, the candidates expected within t bits of partition k: rows of (len(fp), distance + 1)."""
        a, b = (w[self.pick(fp, bits)] for w, bits in zip(self.within[k], self.halves[k], strict=True))
        at = np.stack([sum(a[:, e] * b[:, t - e] for e in range(t + 1)) for t in range(self.distance + 1)], axis=1)
        return np.cumsum(at, axis=1) / max(1, self.n)

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint, by dynamic programming over the partitions."""
        m, top = len(self.parts), self.distance - len(self.parts) + 1
        sums = range(-m, top + 1)
        best = {0: np.zeros(len(fp))}
        back: list[dict[int, np.ndarray]] = []
        for k in range(m):
            seen = self.candidates(fp, k)
            cost = {-1: np.zeros(len(fp))} | {t: probes(len(self.parts[k]), t) + seen[:, t] for t in range(self.distance + 1)}
            new: dict[int, np.ndarray] = {}
            choice: dict[int, np.ndarray] = {}
            for s in sums:
                options = [(t, best[s - t] + c) for t, c in cost.items() if s - t in best]
                if options:
                    totals = np.stack([c for _, c in options])
                    at = totals.argmin(axis=0)
                    new[s], choice[s] = totals.min(axis=0), np.array([t for t, _ in options])[at]
            best = new
            back.append(choice)
        out, s = np.zeros((len(fp), m), np.int64), np.full(len(fp), top)
        for k in reversed(range(m)):
            for v in np.unique(s):
                out[s == v, k] = back[k][int(v)][s == v]
            s = s - out[:, k]
        return out

    def probe_rows(self, fp: np.ndarray):
        """(partition, signatures, fingerprints) arrays of all probes."""
        t = self.thresholds(fp)
        for k, bits in enumerate(self.parts):
            for v in range(self.distance + 1):
                if (own := fp[t[:, k] == v]).size:
                    flips = np.array([sum(1 << b for b in c) for e in range(v + 1) for c in combinations(bits, e)], np.uint64)
                    step = max(1, 200_000 // len(flips))
                    for j in range(0, len(own), step):
                        some = own[j : j + step]
                        yield k, ((some & self.mask(k))[:, None] ^ flips).ravel(), np.repeat(some, len(flips))


def plan(fps: DataFrame, n: int, distance: int) -> Plan:
    """Statistics over all distinct fingerprints, of fixed size: 64 x 64 products and 2 x m histograms."""
    m = choose_m(n, distance)
    parts = correlated_partitions(_sums(fps, BITS * BITS, _products).reshape(BITS, BITS).astype(float), n, m)
    halves = [[p[: len(p) // 2], p[len(p) // 2 :]] for p in parts]
    widest = max(len(h) for p in halves for h in p)

    def histograms(fp: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(Plan.pick(fp, h), minlength=1 << widest) for p in halves for h in p])

    hist = _sums(fps, 2 * m << widest, histograms).reshape(m, 2, 1 << widest).astype(float)
    value = np.arange(1 << widest)
    within = []
    for k in range(m):
        pair = []
        for h in range(2):
            rows = [sum(hist[k, h][value ^ sum(1 << b for b in c)] for c in combinations(range(len(halves[k][h])), e)) for e in range(distance + 1)]
            pair.append(np.stack([r if isinstance(r, np.ndarray) else np.zeros(1 << widest) for r in rows], axis=1))
        within.append(pair)
    return Plan(parts, halves, within, n, distance)


def links(spark: SparkSession, fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a > b: all pairs of distinct fingerprints of fps (fp long, no repeats) within the distance."""
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(plan(fps, n, distance))  # some 2**13 counts a partition

    def as_batch(k, signature, fp):
        import pyarrow as pa

        columns = [np.full(len(fp), k, np.int32), signature.view(np.int64), fp.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "signature", "fp"])

    def probing(batches):
        for batch in batches:
            for row in shared.value.probe_rows(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield as_batch(*row)

    def data(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(len(shared.value.parts)):
                yield as_batch(k, fp & shared.value.mask(k), fp)

    schema = "part int, signature long, fp long"
    ask, have = fps.select("fp").mapInArrow(probing, schema).alias("q"), fps.select("fp").mapInArrow(data, schema).alias("d")
    near = F.expr(f"q.part = d.part and q.signature = d.signature and q.fp > d.fp and bit_count(q.fp ^ d.fp) <= {distance}")
    return ask.join(have, near).select(F.col("q.fp").alias("a"), F.col("d.fp").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", distance: int = DISTANCE, keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, the columns keep, fingerprint, component_id, root) for each row of docs.

    component_id is the smallest doc_id reachable; root is a fingerprint (as a long) that stands for the class.
    """
    prints = stage_table(spark, fingerprints(docs, [F.col("doc_id"), *(keep or [])], text), "fingerprints")
    distinct = stage_table(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "distinct-fingerprints")
    roots = components(spark, links(spark, distinct.select("fp"), distance))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = distinct.join(member, distinct.fp == member.node, "left").select("fp", "least_id", "copies", "root")
    rooted = stage_table(spark, rooted, "rooted-fingerprints")
    linked = rooted.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    linked = spread_join(linked, least, "root", "members", by=["fp"])
    alone = rooted.where("root is null").select("fp", F.col("least_id").alias("component_id"), F.col("fp").alias("root"), "copies")
    classes = linked.select("fp", "component_id", "root", "copies").unionByName(alone)
    own = [c for c in prints.columns if c != "fp"]
    met = spread_join(prints, classes, "fp", "copies", by=hashable(prints, own))
    return met.select(*own, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
