"""The synapse graph as tables: synapses(segment, presyn, perm) and segments(segment, cell).

Activity is a join of active inputs with synapses, and counts; changes are joins, window ranks and projections that give
a new table. Sequential learners hold a series' graph in arrays of their own (temporal_memory.py, spatial_pooler.py).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocked

EPSILON = 1e-6
#: Synapse tables of so many rows travel to every task, larger ones are joined by a shuffle.
BROADCAST_SYNAPSES = 2_000_000
#: Counts (row, segment) that a task holds at a time; few enough for a core's cache, with a row's keys and lists beside them.
CELLS = 1 << 18
#: Parts in which new segments are numbered.
PARTS = 256


def clamp_permanence(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def active_inputs(df: DataFrame, keys: list[str], bits: str) -> DataFrame:
    """(keys, presyn): a row per active bit."""
    return df.select(*keys, F.explode(bits).alias("presyn"))


def ranges(begin: np.ndarray, of: np.ndarray) -> np.ndarray:
    """All places from begin[k] up to begin[k + 1], for each k of ``of``, one after the other."""
    n = begin[of + 1] - begin[of]
    skip = np.concatenate([[0], np.cumsum(n)])
    return np.arange(skip[-1]) + np.repeat(begin[of] - skip[:-1], n)


class Graph:
    """Synapses as arrays in the order of their inputs, small enough to travel to every task."""

    def __init__(self, segment: np.ndarray, presyn: np.ndarray, perm: np.ndarray):
        order = np.lexsort((segment, presyn))
        self.segment, self.perm = segment[order].astype(np.int64), perm[order]
        self.inputs = int(presyn.max()) + 1 if len(presyn) else 0
        self.begin = np.searchsorted(presyn[order], np.arange(self.inputs + 1))
        self.segments = int(segment.max()) + 1 if len(segment) else 0

    @classmethod
    def gather(cls, synapses: DataFrame, most: int | None = None) -> Graph | None:
        """The graph, if it has at most BROADCAST_SYNAPSES synapses, else None."""
        most = BROADCAST_SYNAPSES if most is None else most
        if synapses.limit(most + 1).count() > most:
            return None
        rows = synapses.select("segment", "presyn", F.col("perm").cast("double")).toArrow()
        return cls(*(rows.column(k).to_numpy() for k in range(3)))

    def counts(self, column, segments: int, threshold: float):
        """For runs of rows of an Arrow column of bit arrays: (from, to, connected, potential), arrays (row, segment)."""
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bits, first = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])
        step = max(1, CELLS // max(1, segments))
        for k in range(0, len(column), step):
            j = min(k + step, len(column))
            own, row = bits[first[k] : first[j]], np.repeat(np.arange(j - k), lengths[k:j])
            known = (own >= 0) & (own < self.inputs)
            own, row = own[known], row[known]
            at = ranges(self.begin, own)
            key = np.repeat(row, self.begin[own + 1] - self.begin[own]) * segments + self.segment[at]
            size = (j - k) * segments
            connected = np.bincount(key[self.perm[at] >= threshold], minlength=size)
            yield k, j, connected.reshape(j - k, -1), np.bincount(key, minlength=size).reshape(j - k, -1)

    def met(self, df: DataFrame, keys: list[str], bits: str, threshold: float) -> DataFrame:
        """(keys, segment, connected, potential) where a row has a synapse of the segment; one pass without a shuffle."""
        shared, rows = df.sparkSession.sparkContext.broadcast(self), df.select(*keys, F.col(bits).alias("__bits"))
        made = [T.StructField("segment", T.IntegerType()), T.StructField("connected", T.LongType()), T.StructField("potential", T.LongType())]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k, _, connected, potential in shared.value.counts(batch.column(len(keys)), max(1, shared.value.segments), threshold):
                    row, segment = np.nonzero(potential)
                    own = [c.take(pa.array(k + row)) for c in batch.columns[: len(keys)]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(segment.astype(np.int32)), pa.array(connected[row, segment]), pa.array(potential[row, segment])], [*keys, *[m.name for m in made]])

        return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], *made]))

    def each(self, df: DataFrame, keys: list[str], bits: str, segments: int, choose, name: str) -> DataFrame:
        """(keys, name): choose() makes arrays of ints of the counts (row, segment) of a run of rows; one pass without a shuffle."""
        shared, rows = df.sparkSession.sparkContext.broadcast(self), df.select(*keys, F.col(bits).alias("__bits"))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                found = [x for _, _, _, potential in shared.value.counts(batch.column(len(keys)), segments, -np.inf) for x in choose(potential)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.list_(pa.int32()))], [*keys, name])

        return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], T.StructField(name, T.ArrayType(T.IntegerType()))]))


def activity(df: DataFrame, synapses: DataFrame, keys: list[str], bits: str, threshold: float) -> DataFrame:
    """(keys, segment, connected, potential): the synapses of each segment on active inputs, at the threshold and in all.

    Up to BROADCAST_SYNAPSES synapses travel to the rows, which are then done without a shuffle; more are multiplied by blocks.
    """
    graph = Graph.gather(synapses)
    if graph is not None:
        return graph.met(df, keys, bits, threshold)
    return blocked.activity(df, synapses, keys, bits, threshold)


def activity_sums(df: DataFrame, synapses: DataFrame, keys: list[str], bits: str, threshold: float, least: int) -> DataFrame:
    """(segment, rows, connected, potential): how many rows reach ``least`` connected synapses of a segment, and the sums over those rows."""
    reached = activity(df, synapses, keys, bits, threshold).where(F.col("connected") >= least)
    return reached.groupBy("segment").agg(F.count("*").alias("rows"), F.sum("connected").alias("connected"), F.sum("potential").alias("potential"))


def lookups(segments: DataFrame, synapses: DataFrame, threshold: float) -> DataFrame:
    """(cell, segment, place, synapses, connected) of each segment: its place among its cell's, and how many synapses it has.

    Other questions are filters: segments of a cell or of an input, inputs of a segment.
    """
    n = synapses.groupBy("segment").agg(F.count("*").alias("synapses"), F.count_if(F.col("perm") >= threshold).alias("connected"))
    return compare(segments).join(n, "segment", "left").select("cell", "segment", "place", F.coalesce("synapses", F.lit(0)).alias("synapses"), F.coalesce("connected", F.lit(0)).alias("connected"))


def update_permanences(synapses: DataFrame, new: DataFrame) -> DataFrame:
    """Sets the permanences of new (segment, presyn, perm), clamped to 0 to 1; pairs without a synapse are left out."""
    wanted = new.groupBy("segment", "presyn").agg(F.max("perm").alias("__new"))
    return synapses.join(wanted, ["segment", "presyn"], "left").select("segment", "presyn", clamp_permanence(F.coalesce("__new", "perm")).alias("perm"))


def create_synapses(synapses: DataFrame, new: DataFrame) -> DataFrame:
    """Adds synapses; a pair that a segment already has keeps the greater permanence."""
    both = synapses.unionByName(new)
    return both.groupBy("segment", "presyn").agg(F.max(clamp_permanence(F.col("perm"))).alias("perm"))


def destroy_segments(segments: DataFrame, synapses: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return segments.join(gone, "segment", "left_anti"), synapses.join(gone, "segment", "left_anti")


def destroy_synapses(synapses: DataFrame, gone: DataFrame) -> DataFrame:
    return synapses.join(gone, ["segment", "presyn"], "left_anti")


def make_room(segments: DataFrame, synapses: DataFrame, most: int) -> DataFrame:
    """(segment): where a cell has most segments or more, those with the fewest synapses, so that one more fits."""
    sizes = segments.join(synapses.groupBy("segment").agg(F.count("*").alias("n")), "segment", "left").fillna(0, ["n"])
    by_cell = Window.partitionBy("cell")
    ranked = sizes.withColumn("have", F.count("*").over(by_cell)).withColumn("rank", F.row_number().over(by_cell.orderBy("n", "segment")))
    return ranked.where(F.col("rank") <= F.col("have") - (most - 1)).select("segment")


def adapt(synapses: DataFrame, active: DataFrame, segments: DataFrame, increment: float, decrement: float, *, prune: bool = False, series: bool = False) -> DataFrame:
    """Raises the synapses of the given segments (segment) on active cells (presyn), lowers the others.

    prune drops synapses that come to 0. With series, synapses have a column change, what was added the last time (0 at
    first, or after ``forget``): a change of the same sign as the last one isn't made, and 0 is noted for it.
    """
    own = synapses.join(segments.select("segment").distinct().withColumn("__own", F.lit(True)), "segment", "left")
    own = own.join(active.select("presyn").distinct().withColumn("__on", F.lit(True)), "presyn", "left")
    step = F.when(F.col("__on"), F.lit(increment)).otherwise(F.lit(-decrement))
    if series:
        step = F.when(F.signum(step) == F.signum("change"), F.lit(0.0)).otherwise(step)
    moved = F.when(F.col("__own"), clamp_permanence(F.col("perm") + step)).otherwise(F.col("perm"))
    last = [F.when(F.col("__own"), step).otherwise(F.col("change")).alias("change")] * series
    out = own.select("segment", "presyn", moved.alias("perm"), *last)
    return out.where(F.col("perm") > EPSILON) if prune else out


def forget(synapses: DataFrame) -> DataFrame:
    """Synapses whose last changes are forgotten: what a reset does to a series."""
    return synapses.withColumn("change", F.lit(0.0))


def weak_segments(segments: DataFrame, synapses: DataFrame, least: int) -> DataFrame:
    """(segment) of those with fewer than least synapses, for destroy_segments()."""
    sizes = segments.join(synapses.groupBy("segment").agg(F.count("*").alias("n")), "segment", "left")
    return sizes.where(F.coalesce("n", F.lit(0)) < least).select("segment")


def create_segments(segments: DataFrame, synapses: DataFrame, cells: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Segments with one more for each of the distinct cells (cell), and synapses; at the maximum, a cell's smallest segments go first."""
    new = cells.select("cell").distinct()
    segments, synapses = destroy_segments(segments, synapses, make_room(segments.join(new, "cell", "left_semi").select("segment", "cell"), synapses, most))
    top = segments.agg(F.coalesce(F.max("segment"), F.lit(-1))).first()[0]
    # places within ranges of cells, so that no task has to see all new cells
    place = F.row_number().over(Window.partitionBy("__part").orderBy("cell"))
    ranged = new.withColumn("__part", F.pmod(F.xxhash64("cell"), F.lit(PARTS)))
    before, at = [], top
    for r in sorted(ranged.groupBy("__part").count().collect()):  # PARTS rows at most
        before.append((r["__part"], at))
        at += r["count"]
    starts = new.sparkSession.createDataFrame(before, "__part long, __before long")
    made = ranged.join(F.broadcast(starts), "__part").select((F.col("__before") + place).cast(segments.schema["segment"].dataType).alias("segment"), "cell")
    return segments.select("segment", "cell").unionByName(made), synapses


def compare(segments: DataFrame) -> DataFrame:
    """segments with their place among those of their cell: their order is (cell, place)."""
    return segments.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("segment")) - 1)


def same_graph(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> bool:
    """Whether two graphs (segments, synapses) have equal segments and synapses, in any order of rows."""
    return all(x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() for x, y in zip(a, b, strict=True))


def bump(synapses: DataFrame, segments: DataFrame, delta: float) -> DataFrame:
    """Adds delta to all synapses of the given segments."""
    own = synapses.join(segments.select("segment").distinct().withColumn("__own", F.lit(True)), "segment", "left")
    return own.select("segment", "presyn", clamp_permanence(F.col("perm") + F.when(F.col("__own"), F.lit(delta)).otherwise(F.lit(0.0))).alias("perm"))


def raise_to_threshold(synapses: DataFrame, threshold: float, connected: int) -> DataFrame:
    """Lifts each segment's strongest unconnected synapses to the threshold until so many are connected."""
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("perm"), "presyn"))
    return synapses.withColumn("__rank", rank).select("segment", "presyn", F.when(F.col("__rank") <= connected, F.greatest("perm", F.lit(threshold))).otherwise(F.col("perm")).alias("perm"))


def compete(synapses: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """Keeps each segment's connected synapses between least and most; those over it go just below the threshold."""
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("perm"), "presyn"))
    perm = F.when(F.col("__rank") <= least, F.greatest("perm", F.lit(threshold))).when(F.col("__rank") > most, F.least("perm", F.lit(threshold - 0.001))).otherwise(F.col("perm"))
    return synapses.withColumn("__rank", rank).select("segment", "presyn", perm.alias("perm"))


def destroy_weakest(synapses: DataFrame, n: int, keep: DataFrame | None = None) -> DataFrame:
    """Drops the n weakest synapses of each segment, leaving those on cells of keep (presyn) alone."""
    safe = synapses.join(keep.select("presyn").distinct().withColumn("__keep", F.lit(True)), "presyn", "left") if keep is not None else synapses.withColumn("__keep", F.lit(None).cast("boolean"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.col("__keep").isNotNull(), "perm", "presyn"))
    return safe.withColumn("__rank", rank).where((F.col("__rank") > n) | F.col("__keep").isNotNull()).select("segment", "presyn", "perm")


def grow(synapses: DataFrame, wanted: DataFrame, initial: float, seed: int = 0, most: int | None = None) -> DataFrame:
    """Adds synapses: wanted(segment, presyn, n) has candidates and how many each segment takes, drawn by a hash.

    With ``most``, a segment that would have more loses its weakest old synapses first, and takes no more than that.
    """
    free = wanted.join(synapses, ["segment", "presyn"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.xxhash64(F.lit(seed), "segment", "presyn"), "presyn"))
    new = free.withColumn("__rank", rank).where(F.col("__rank") <= (F.col("n") if most is None else F.least("n", F.lit(most)))).select("segment", "presyn", F.lit(initial).alias("perm"))
    if most is not None:
        strong = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("perm"), "presyn"))
        more = new.groupBy("segment").agg(F.count("*").alias("__new"))
        ranked = synapses.withColumn("__rank", strong).join(more, "segment", "left")
        synapses = ranked.where(F.col("__new").isNull() | (F.col("__rank") <= F.lit(most) - F.col("__new"))).select("segment", "presyn", "perm")
    return create_synapses(synapses, new)
