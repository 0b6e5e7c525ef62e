"""The best match of each row among any number of patterns, exactly: greatest overlap of bits, or least distance.

Both are searches in a metric space (the symmetric difference of bit sets; weighted sums of absolute differences), so
distances to a few *pivots* bound the distance between any two points by the triangle inequality. Pivots are patterns far
from each other. In the space of distances to pivots, the patterns are dealt into *blocks* by a tree of medians, and each
task deals its block into leaves of LEAF patterns. A row visits the leaves in the order of what they may give at best,
and stops at the first one that can't beat what it has; a leaf's box of pivot distances tells that without a comparison.

A row first searches its own block; the result and the boxes of all blocks tell which others it must visit, and it is
sent to those only. Patterns are never sent to all rows, nor rows to all patterns. A block takes BLOCK patterns; there are
MAX_BLOCKS blocks at most, whose boxes are broadcast. Rows of one block are dealt over as many tasks as their number
needs, so that equal rows don't gather. Pivots and medians come from SAMPLE patterns at most; they only decide what is
compared first, not what is found.

Equal patterns are searched as one. Placed points, first results and visits are stage tables, as several steps read each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.stages import staged

PIVOTS, LEAF = 16, 8
#: Patterns of a block, and rows that meet it in one task, or so.
BLOCK, ROWS = 4096, 1024
MAX_BLOCKS, SAMPLE, CELLS = 1 << 14, 4096, 1024
#: Rows of one numpy pass.
PASS = 256


class Overlap:
    """Sets of bits; the best match shares the most bits."""

    kind = T.IntegerType()

    @staticmethod
    def usable(value: Column) -> Column:
        return value.isNotNull()

    @staticmethod
    def value(column: Column) -> Column:
        return F.array_distinct(F.filter(column, lambda b: b.isNotNull())).cast("array<long>")

    @staticmethod
    def load(arrays, universe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed bits of the universe, and the sizes of the whole sets."""
        size = np.diff(arrays.offsets.to_numpy())
        bits = arrays.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(size), max(1, -(-len(universe) // 64))), np.uint64)
        if len(universe) and len(bits):
            at = np.minimum(np.searchsorted(universe, bits), len(universe) - 1)
            known = universe[at] == bits
            row, at = np.repeat(np.arange(len(size)), size)[known], at[known]
            np.bitwise_or.at(out, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return out, size.astype(np.float64)

    @staticmethod
    def universe(arrays) -> np.ndarray:
        return np.unique(arrays.flatten().to_numpy(zero_copy_only=False))

    @staticmethod
    def gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64).astype(np.float64)

    @classmethod
    def distances(cls, a, size_a: np.ndarray, b, size_b: np.ndarray) -> np.ndarray:
        return size_a[:, None] + size_b[None] - 2 * cls.gain(a[:, None], b[None])

    @staticmethod
    def most(least: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """The greatest possible gain, from the least possible distance and the sizes."""
        return np.minimum(np.minimum(size_a, size_b), np.floor((size_a + size_b - least) / 2))

    @staticmethod
    def result(gain: Column) -> Column:
        return gain.cast("int")


class Distance:
    """Vectors of numbers; the best match has the least sum of absolute differences."""

    kind = T.DoubleType()

    @staticmethod
    def usable(value: Column) -> Column:
        return value.isNotNull() & ~F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    @staticmethod
    def value(column: Column) -> Column:
        return column.cast("array<double>")

    @staticmethod
    def load(arrays, universe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)
        return x, np.abs(x).sum(axis=1)

    @staticmethod
    def universe(arrays) -> np.ndarray:
        return np.zeros(0)

    @staticmethod
    def gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
        for k in range(a.shape[-1]):
            out -= np.abs(a[..., k] - b[..., k])
        return out

    @classmethod
    def distances(cls, a, size_a: np.ndarray, b, size_b: np.ndarray) -> np.ndarray:
        return -cls.gain(a[:, None], b[None])

    @staticmethod
    def most(least: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Sizes are sums of absolute numbers here, which bound the rounding of all sums of differences."""
        return np.minimum(0.0, 1e-12 * (size_a + size_b) - least)

    @staticmethod
    def result(gain: Column) -> Column:
        return -gain


METRICS = {"overlap": Overlap, "distance": Distance}


class Tree:
    """Cells of the space of pivot distances: splits at medians of the widest dimension."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        n = (1 << self.depth) - 1
        self.dimension, self.at = np.zeros(n, np.int64), np.zeros(n)
        groups = [points]
        for node in range(n):
            own = groups[node]
            if len(own):
                self.dimension[node] = np.ptp(own, axis=0).argmax()
                self.at[node] = np.median(own[:, self.dimension[node]])
            left = own[:, self.dimension[node]] < self.at[node]
            groups += [own[left], own[~left]]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dimension[node]] >= self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


class Space:
    """A metric with its pivots and cells."""

    def __init__(self, metric: str, sample, patterns: int):
        self.metric = METRICS[metric]
        self.universe = self.metric.universe(sample)
        x, size = self.metric.load(sample, self.universe)
        at = [0]
        far = self.metric.distances(x, size, x[:1], size[:1])[:, 0]
        while len(at) < PIVOTS and far.max(initial=0) > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, self.metric.distances(x, size, x[at[-1:]], size[at[-1:]])[:, 0])
        self.pivots, self.sizes = x[at], size[at]
        blocks = min(MAX_BLOCKS, -(-patterns // BLOCK))
        self.parts = -(-blocks // CELLS)
        self.tree = Tree(self.distances(x, size), -(-blocks // self.parts))
        self.blocks = self.parts << self.tree.depth

    def distances(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(self.pivots)))
        return np.concatenate([self.metric.distances(x[k : k + PASS], size[k : k + PASS], self.pivots, self.sizes) for k in range(0, len(x), PASS)])

    def place(self, arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances to the pivots, sizes, cells) of points; bits that no pivot has only count in the sizes."""
        x, size = self.metric.load(arrays, self.universe)
        d = self.distances(x, size)
        return d, size, self.tree.cell(d)


def leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Index arrays of up to ``most`` points each, near each other."""
    out, left = [], [np.arange(len(points))]
    while left:
        own = left.pop()
        if len(own) <= most:
            out.append(own)
            continue
        dimension = np.ptp(points[own], axis=0).argmax()
        own = own[np.argsort(points[own, dimension], kind="stable")]
        left += [own[: len(own) // 2], own[len(own) // 2 :]]
    return out


def bounds(metric, d: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """The most that each row can gain in each box."""
    least = np.zeros((len(d), len(low)))
    for k in range(d.shape[1]):
        np.maximum(least, low[None, :, k] - d[:, k, None], out=least)
        np.maximum(least, d[:, k, None] - high[None, :, k], out=least)
    return metric.most(least, size[:, None], largest[None])


def search(metric, rows, d: np.ndarray, best: np.ndarray, patterns, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best gain, patterns compared) of each row, given pivot distances of rows (d) and patterns (e) and gains so far."""
    universe = metric.universe(patterns)
    x, size = metric.load(rows, universe)
    y, size_y = metric.load(patterns, universe)
    own = leaves(e, LEAF)
    low, high = (np.array([f(e[i], axis=0) for i in own]) for f in (np.min, np.max))
    largest = np.array([size_y[i].max() for i in own])
    member = np.array([np.pad(i, (0, LEAF - len(i)), constant_values=-1) for i in own])
    best, compared = best.copy(), np.zeros(len(best), np.int64)
    for k in range(0, len(x), PASS):
        part = slice(k, k + PASS)
        may = bounds(metric, d[part], size[part], low, high, largest)
        order = np.argsort(-may, axis=1, kind="stable")
        active = np.arange(len(may))
        for turn in range(len(own)):
            leaf = order[active, turn]
            on = may[active, leaf] > best[part][active]
            active, leaf = active[on], leaf[on]
            if not len(active):
                break
            # Of the leaf, only patterns whose own distances to the pivots allow more are compared.
            row, of = np.repeat(k + active, LEAF), member[leaf].ravel()
            row, of = row[of >= 0], of[of >= 0]
            least = np.abs(d[row] - e[of]).max(axis=1, initial=0)
            on = metric.most(least, size[row], size_y[of]) > best[row]
            row, of = row[on], of[on]
            np.maximum.at(best, row, metric.gain(x[row], y[of]))
            np.add.at(compared, row, 1)
    return best, compared


def nearest(rows: DataFrame, patterns: DataFrame, keys: list[str], value: str, metric: str) -> DataFrame:
    """(keys, best, compared): for each row of rows with a usable value its best match among all of patterns.

    value names the column of both: arrays of bits for "overlap", arrays of numbers, of one length, for "distance". compared
    is the number of patterns that the row was compared with. No usable patterns give no rows.
    """
    import pyarrow as pa

    kind = METRICS[metric]
    own = patterns.select(value).where(kind.usable(F.col(value))).select(kind.value(F.col(value)).alias("value"))
    own = staged(own.distinct(), "patterns")
    n = own.count()
    made = T.StructType([*[rows.schema[k] for k in keys], T.StructField("best", kind.kind), T.StructField("compared", T.LongType())])
    if not n:
        return rows.sparkSession.createDataFrame([], made)
    sample = own.orderBy(F.xxhash64("value")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(Space(metric, sample, n))
    parts, blocks = shared.value.parts, shared.value.blocks

    def placed(df: DataFrame, names: list[str]) -> DataFrame:
        """df (names, value) with at (distances to the pivots), size and block."""

        def run(batches):
            for batch in batches:
                d, size, cell = shared.value.place(batch.column(len(names)))
                width = d.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, width, dtype=np.int32)), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(size), pa.array(cell)], [*batch.schema.names, "at", "size", "cell"])

        fields = [T.StructField("at", T.ArrayType(T.DoubleType())), T.StructField("size", T.DoubleType()), T.StructField("cell", T.LongType())]
        out = df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
        return out.withColumn("block", F.col("cell") * parts + F.pmod(F.xxhash64(*(names or ["value"])), F.lit(parts))).drop("cell")

    names = [f"k{i}" for i in range(len(keys))]
    points = rows.where(kind.usable(F.col(value))).select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], kind.value(F.col(value)).alias("value"))
    base = staged(placed(own, []), "placed_patterns")
    asking = staged(placed(points, names), "placed_rows").withColumn("best", F.lit(float("-inf")))
    found = met(asking, base, names, kind)
    if blocks > 1:
        found = staged(found, "home")
        boxes = base.select("block", "size", F.posexplode("at").alias("k", "d")).groupBy("block", "k").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("size").alias("largest")).toArrow()
        block, k, low, high, largest = (boxes.column(c).to_numpy() for c in range(5))  # MAX_BLOCKS x PIVOTS rows at most
        known, at = np.unique(block, return_inverse=True)
        box = [np.zeros((len(known), int(k.max()) + 1)) for _ in range(2)]
        box[0][at, k], box[1][at, k] = low, high
        top = np.zeros(len(known))
        top[at] = largest
        told = rows.sparkSession.sparkContext.broadcast((known, *box, top))
        home = found.groupBy(*names).agg(F.max("gain").alias("so_far"))
        same = [asking[c].eqNullSafe(home[c]) for c in names]
        again = asking.join(home, same, "left").select(*[asking[c] for c in names], "value", "at", "size", "block", F.coalesce("so_far", F.lit(float("-inf"))).alias("best"))

        def others(batches):
            known, low, high, top = told.value
            for batch in batches:
                if batch.num_rows:
                    c = {n: batch.column(n) for n in batch.schema.names}
                    d = c["at"].flatten().to_numpy().reshape(batch.num_rows, -1)
                    may = bounds(kind, d, c["size"].to_numpy(), low, high, top)
                    row, to = np.nonzero((may > c["best"].to_numpy()[:, None]) & (known[None] != c["block"].to_numpy()[:, None]))
                    for i in range(0, len(row), 10_000):
                        out = batch.take(pa.array(row[i : i + 10_000]))
                        yield out.set_column(out.schema.names.index("block"), "block", pa.array(known[to[i : i + 10_000]]))

        found = found.unionByName(met(staged(again.mapInArrow(others, again.schema), "visits"), base, names, kind))
    best = found.groupBy(*names).agg(kind.result(F.max("gain")).alias("best"), F.sum("compared").alias("compared")).where("best is not null")
    return best.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], "best", "compared")


def met(asking: DataFrame, base: DataFrame, names: list[str], kind) -> DataFrame:
    """(names, gain, compared): each row of asking after its block, in groups of some ROWS rows by one block."""
    import pyarrow as pa

    counts = asking.groupBy("block").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("groups"))  # MAX_BLOCKS rows at most
    counts = F.broadcast(counts)
    left = asking.join(counts, "block").withColumn("part", F.pmod(F.xxhash64(*names), F.col("groups")).cast("int")).drop("groups")
    right = base.select("block", "value", "at").join(counts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def run(left, right):
        own, patterns = left.combine_chunks(), right.combine_chunks()
        columns = [own.column(c) for c in names]
        if not right.num_rows or not left.num_rows:
            gain, compared = np.full(left.num_rows, float("-inf")), np.zeros(left.num_rows, np.int64)
        else:
            d, e = (t.column("at").chunk(0).flatten().to_numpy().reshape(t.num_rows, -1) for t in (own, patterns))
            gain, compared = search(kind, own.column("value").chunk(0), d, own.column("best").to_numpy(), patterns.column("value").chunk(0), e)
        none = gain == float("-inf")
        return pa.table([*columns, pa.array(gain, mask=none), pa.array(compared)], [*names, "gain", "compared"])

    schema = T.StructType([*[asking.schema[c] for c in names], T.StructField("gain", T.DoubleType()), T.StructField("compared", T.LongType())])
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)
