"""Spatial pooling: inputs to the columns whose synapses they overlap most.

Inference is relational: overlaps are counts of connected synapses on active inputs, inhibition is a rank. Learning is
sequential, so each series (of its own ``series`` key) runs in one task, in the order of ``seq``, on numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import require

from . import blocked, series, topology
from .connections import Graph, adapt, bump, ranges


@dataclass(frozen=True)
class PoolerParams:
    inputs: tuple[int, ...] = (100,)
    columns: tuple[int, ...] = (2048,)
    potential_radius: int = 16
    potential_share: float = 0.5
    global_inhibition: bool = True
    density: float = 0.05
    active_per_area: int = 0
    stimulus_threshold: int = 0
    decrement: float = 0.008
    increment: float = 0.05
    connected: float = 0.1
    min_share_overlap: float = 0.001
    period: int = 1000
    boost: float = 0.0
    seed: int = 1
    wrap: bool = True
    update_every: int = 50
    inhibition_radius: int = 8

    def __post_init__(self):
        require(bool(self.inputs) and bool(self.columns) and min(self.inputs + self.columns) > 0, "dimensions", "must be positive")
        require(0 < self.potential_share <= 1, "potential_share", "must be in (0, 1]")
        require(0 < self.density <= 0.5, "density", "must be in (0, 0.5]")

    @property
    def num_columns(self) -> int:
        return prod(self.columns)

    @property
    def effective_density(self) -> float:
        return min(0.5, self.active_per_area / self.num_columns) if self.active_per_area else self.density

    @property
    def winners(self) -> int:
        return min(max(1, int(self.num_columns * self.effective_density + 0.5)), self.num_columns)


def initial_synapses(spark: SparkSession, p: PoolerParams) -> DataFrame:
    """(segment, presyn, perm): each column's pool, drawn by hashes, with permanences on both sides of connected."""
    cols = spark.range(p.num_columns).select(F.col("id").cast("int").alias("segment"))
    pool = topology.potential_pool(F.col("segment"), p.columns, p.inputs, p.potential_radius, p.wrap)
    drawn = F.array_sort(F.transform(pool, lambda i: F.struct(F.xxhash64(F.lit(p.seed), F.col("segment"), i).alias("h"), i.alias("i"))))
    share = F.greatest(F.lit(1), F.round(F.size(pool) * p.potential_share).cast("int"))
    rows = cols.select("segment", F.explode(F.transform(F.slice(drawn, 1, share), lambda x: x["i"])).alias("presyn"))

    def uniform(salt: int):
        return F.pmod(F.xxhash64(F.lit(p.seed + salt), "segment", "presyn"), F.lit(1 << 30)) / float(1 << 30)

    perm = F.when(uniform(1) < 0.5, p.connected + uniform(2) * p.increment / 4).otherwise(p.connected * uniform(2))
    return rows.withColumn("perm", perm)


def overlaps(df: DataFrame, synapses: DataFrame, keys: list[str], bits: str, p: PoolerParams) -> DataFrame:
    """(keys, column, overlap) of the columns with an overlap. Few synapses travel to the rows, else they are joined."""
    connected = synapses.where(F.col("perm") >= p.connected)
    graph = Graph.gather(connected)
    if graph is not None:
        found = graph.met(df, keys, bits, -np.inf)
        return found.select(*keys, F.col("segment").alias("column"), F.col("potential").alias("overlap"))
    found = blocked.activity(df, connected, keys, bits, p.connected)
    return found.select(*keys, F.col("segment").alias("column"), F.col("potential").alias("overlap"))


def pool(df: DataFrame, synapses: DataFrame, keys: list[str], bits: str, p: PoolerParams, boosts: DataFrame | None = None) -> DataFrame:
    """(keys, active): the active columns of each row, by the inhibition that p names. Null bits are no bits.

    boosts (column, boost) multiply the overlaps that compete, 1 where there is none; the stimulus threshold is for the
    overlaps themselves. If the synapses are few, each row is done on its own, without a shuffle; else overlaps are
    multiplied by blocks and gathered, and meet their boosts by a join.
    """
    graph = Graph.gather(synapses.where(F.col("perm") >= p.connected))
    boost = np.ones(p.num_columns)
    if boosts is not None and graph is not None:
        got = boosts.select("column", F.col("boost").cast("double")).toArrow()  # a row for each column
        boost[got.column(0).to_numpy()] = got.column(1).to_numpy()
    if graph is None:
        found = overlaps(df, synapses, keys, bits, p)
        if boosts is not None:
            found = found.join(boosts.select("column", F.col("boost").cast("double").alias("boost")), "column", "left")
            found = found.withColumn("strength", F.col("overlap") * F.coalesce("boost", F.lit(1.0))).drop("boost")
        if p.global_inhibition:
            return inhibit_globally(found, df, keys, p)
        near = topology.neighbor_table(df.sparkSession, p.columns, p.inhibition_radius, wrap=p.wrap)
        won = inhibit_locally(found, keys, near, p).groupBy(*keys).agg(F.array_sort(F.collect_list("column")).alias("active"))
        return df.select(*keys).join(won, keys, "left").withColumn("active", F.coalesce("active", F.array().cast("array<int>")))
    near = None if p.global_inhibition else neighbours(p.columns, p.inhibition_radius, p.wrap)

    def winners(overlap: np.ndarray) -> list[np.ndarray]:
        if near is None:
            order = np.argsort(-(overlap * boost), axis=1, kind="stable")[:, : p.winners]
            good = np.take_along_axis(overlap, order, axis=1) >= p.stimulus_threshold
            return [np.sort(o[g]) for o, g in zip(order, good, strict=True)]
        padded = np.pad(overlap * boost, ((0, 0), (0, 1)))  # the last one is that of no neighbour
        stronger = sum((padded[:, of] > padded[:, :-1]).astype(np.int32) for of in near.T)
        room = np.ceil(((near < p.num_columns).sum(axis=1) + 1) * p.effective_density)
        return [np.flatnonzero(x) for x in (overlap >= max(1, p.stimulus_threshold)) & (stronger < room)]

    return graph.each(df, keys, bits, p.num_columns, winners, "active")


def neighbours(dims: tuple[int, ...], radius: int, wrap: bool) -> np.ndarray:
    """The neighbours of each cell of a grid, without itself, in a row each; the number of cells stands for none."""
    at, n = np.stack(np.unravel_index(np.arange(prod(dims)), dims)), prod(dims)
    steps = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * len(dims), indexing="ij")).reshape(len(dims), -1)
    to = at[:, :, None] + steps[:, None, :]
    size = np.array(dims)[:, None, None]
    inside = np.ones(to.shape[1:], bool) if wrap else ((to >= 0) & (to < size)).all(axis=0)
    cell = np.where(inside, np.ravel_multi_index(tuple(to % size), dims), n)
    cell[cell == np.arange(n)[:, None]] = n
    cell.sort(axis=1)
    cell[:, 1:][cell[:, 1:] == cell[:, :-1]] = n  # a wrapped neighbourhood has no repeats
    return cell


def inhibit_globally(found: DataFrame, records: DataFrame, keys: list[str], p: PoolerParams) -> DataFrame:
    """(keys, active): the winners by strength (the overlap, if found has no such column), then by column. Columns without overlap compete too, last and in order."""
    k = p.winners
    found = with_strength(found)
    order = F.array_sort(F.transform("all", lambda x: F.struct((-x["strength"]).alias("o"), x["column"].alias("c"))))
    top = found.where(F.col("overlap") >= p.stimulus_threshold).groupBy(*keys).agg(F.collect_list(F.struct("column", "strength")).alias("all"))
    top = top.select(*keys, F.transform(order, lambda x: x["c"]).alias("ranked"))
    out = records.select(*keys).join(top, keys, "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<int>")))
    if p.stimulus_threshold > 0:
        return out.select(*keys, F.array_sort(F.slice("ranked", 1, k)).alias("active"))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(p.num_columns - 1)), "ranked")
    full = F.when(F.size("ranked") >= k, F.slice("ranked", 1, k)).otherwise(F.concat("ranked", F.slice(rest, 1, F.greatest(F.lit(k) - F.size("ranked"), F.lit(0)))))
    return out.select(*keys, F.array_sort(full).alias("active"))


def with_strength(found: DataFrame) -> DataFrame:
    return found if "strength" in found.columns else found.withColumn("strength", F.col("overlap").cast("double"))


def inhibit_locally(found: DataFrame, keys: list[str], neighbors: DataFrame, p: PoolerParams) -> DataFrame:
    """(keys, column) of the columns with fewer stronger neighbours than their area allows; ties all win."""
    found = with_strength(found)
    area = neighbors.groupBy("cell").agg(F.count("*").alias("area"))
    other = found.select(*keys, F.col("column").alias("nbr"), F.col("strength").alias("theirs"))
    own = found.where(F.col("overlap") >= max(1, p.stimulus_threshold)).join(area, F.col("column") == F.col("cell"), "left").drop("cell")
    near = own.join(neighbors.withColumnRenamed("cell", "column"), "column", "left").join(other, [*keys, "nbr"], "left")
    stronger = near.groupBy(*keys, "column", "area").agg(F.count_if(F.col("theirs") > F.col("strength")).alias("stronger"))
    return stronger.where(F.col("stronger") < F.ceil((F.coalesce("area", F.lit(0)) + 1) * p.effective_density)).select(*keys, "column")


#: A pooler's state: its synapses, and what it knows of each column.
STATE = "segment array<int>, presyn array<int>, perm array<double>, boost array<double>, overlap_duty array<double>, active_duty array<double>, min_duty array<double>, iteration long"


def _drawn(p: PoolerParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, presyn, perm) of the first synapses."""
    draw, pools = np.random.default_rng(p.seed), []
    at, size = np.stack(np.unravel_index(np.arange(p.num_columns), p.columns)), np.array(p.inputs)[:, None]
    centre = np.minimum(((at + 0.5) * size / np.array(p.columns)[:, None]).astype(int), size - 1)
    for c in range(p.num_columns):
        spans = [np.unique(np.arange(x - p.potential_radius, x + p.potential_radius + 1) % d) if p.wrap else np.arange(max(0, x - p.potential_radius), min(d, x + p.potential_radius + 1)) for x, d in zip(centre[:, c], p.inputs, strict=True)]
        cells = np.ravel_multi_index([g.ravel() for g in np.meshgrid(*spans, indexing="ij")], p.inputs)
        pools.append(draw.choice(cells, max(1, int(len(cells) * p.potential_share + 0.5)), replace=False))
    presyn = np.concatenate(pools)
    low, u = draw.random(len(presyn)) < 0.5, draw.random(len(presyn))
    return np.repeat(np.arange(p.num_columns), [len(x) for x in pools]), presyn, np.where(low, p.connected + u * p.increment / 4, p.connected * u)


def _laid_out(p: PoolerParams, segment: np.ndarray, presyn: np.ndarray, perm: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, presyn, perm) in the order of inputs, where each input's synapses begin, their order by column, and where each column's begin in that."""
    order = np.lexsort((segment, presyn))
    segment, presyn, perm = segment[order].astype(np.int64), presyn[order].astype(np.int64), perm[order]
    by_column = np.argsort(segment, kind="stable")
    return segment, presyn, perm, np.searchsorted(presyn, np.arange(prod(p.inputs) + 1)), by_column, np.searchsorted(segment[by_column], np.arange(p.num_columns + 1))


@lru_cache(maxsize=2)
def _first(p: PoolerParams) -> tuple[np.ndarray, ...]:
    """The first synapses: every series begins with the same ones, so that a process draws them once. Only perm changes, in copies."""
    made = _laid_out(p, *_drawn(p))
    for x in made:
        x.setflags(write=False)
    return made


class Pooler:
    """One series' pooler. Its synapses lie in arrays in the order of their inputs; memory goes with their number."""

    def __init__(self, p: PoolerParams, state: dict | None = None):
        self.p = p
        n = p.num_columns
        if state is None:
            self.segment, self.presyn, perm, self.of_input, self.by_column, self.of_column = _first(p)
            self.perm = perm.copy()
            self.boost, self.overlap_duty, self.active_duty, self.min_duty = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
            self.iteration = 0
        else:
            self.segment, self.presyn, self.perm, self.of_input, self.by_column, self.of_column = _laid_out(p, *(np.array(state[k]) for k in ("segment", "presyn", "perm")))
            self.boost, self.overlap_duty, self.active_duty, self.min_duty = (np.array(state[k], float) for k in ("boost", "overlap_duty", "active_duty", "min_duty"))
            self.iteration = state["iteration"]
        self.near = None if p.global_inhibition else self._near(self._radius())

    def _radius(self) -> int:
        """From the average span of connected inputs, scaled to columns."""
        on, n, spans = self.perm >= self.p.connected, self.p.num_columns, []
        for x in np.unravel_index(self.presyn[on], self.p.inputs):
            least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(least, self.segment[on], x)
            np.maximum.at(most, self.segment[on], x)
            spans.append(np.where(most >= 0, most - np.minimum(least, most) + 1, 0))
        ratio = prod(c / i for c, i in zip(self.p.columns, self.p.inputs, strict=False))
        return max(1, int((np.mean(spans) * ratio - 1) / 2 + 0.5))

    def _near(self, radius: int) -> np.ndarray:
        return neighbours(self.p.columns, min(radius, max(self.p.columns)), self.p.wrap)

    def _area(self) -> np.ndarray:
        return (self.near < self.p.num_columns).sum(axis=1)

    def _of_near(self, values: np.ndarray, none: float) -> np.ndarray:
        """The values of each column's neighbours, and none where there is none."""
        return np.append(values, none)[self.near]

    def overlap(self, bits: np.ndarray) -> np.ndarray:
        """The connected synapses on active inputs of each column: only those inputs' synapses are looked at."""
        at = ranges(self.of_input, bits)
        return np.bincount(self.segment[at[self.perm[at] >= self.p.connected]], minlength=self.p.num_columns)

    def compute(self, bits: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """(active columns, overlaps)."""
        p = self.p
        if (bits[1:] <= bits[:-1]).any():
            bits = np.unique(bits)
        overlap = self.overlap(bits)
        boosted = overlap * self.boost
        if p.global_inhibition:
            order = np.argsort(-boosted, kind="stable")[: p.winners]
            active = np.sort(order[overlap[order] >= p.stimulus_threshold])
        else:
            stronger = (self._of_near(boosted, -np.inf) > boosted[:, None]).sum(axis=1)
            active = np.flatnonzero((overlap >= max(1, p.stimulus_threshold)) & (stronger < np.ceil((self._area() + 1) * p.effective_density)))
        if learn:
            self._learn(bits, overlap, active)
        return active, overlap

    def _learn(self, bits: np.ndarray, overlap: np.ndarray, active: np.ndarray) -> None:
        p = self.p
        self.iteration += 1
        on = np.zeros(prod(p.inputs), bool)
        on[bits] = True
        at = self.by_column[ranges(self.of_column, active)]
        self.perm[at] = np.minimum(np.maximum(self.perm[at] + np.where(on[self.presyn[at]], p.increment, -p.decrement), 0), 1)
        won = np.zeros(p.num_columns)
        won[active] = 1
        self.overlap_duty = (self.overlap_duty * (p.period - 1) + (overlap > 0)) / p.period
        self.active_duty = (self.active_duty * (p.period - 1) + won) / p.period
        weak = np.flatnonzero(self.overlap_duty < self.min_duty)
        if len(weak):
            at = self.by_column[ranges(self.of_column, weak)]
            self.perm[at] = np.minimum(np.maximum(self.perm[at] + p.connected / 10, 0), 1)
        if p.boost > 0:
            target = p.effective_density if self.near is None else self._of_near(self.active_duty, 0.0).sum(axis=1) / np.maximum(1, self._area())
            self.boost = np.exp(p.boost * (target - self.active_duty))
        if self.iteration % p.update_every == 0:
            if self.near is None:
                self.min_duty[:] = p.min_share_overlap * self.overlap_duty.max()
            else:
                self.near = self._near(self._radius())
                self.min_duty = p.min_share_overlap * np.maximum(self._of_near(self.overlap_duty, 0.0).max(axis=1), self.overlap_duty)

    def synapses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, presyn, perm), column by column."""
        return self.segment[self.by_column], self.presyn[self.by_column], self.perm[self.by_column]

    def export(self) -> tuple:
        arrays = (self.segment, self.presyn, self.perm, self.boost, self.overlap_duty, self.active_duty, self.min_duty)
        return *(x.tolist() for x in arrays), self.iteration


FIELDS = "active array<int>, max_overlap int"


class _Series:
    """A pooler as series.run takes it: rows have bits."""

    def __init__(self, p: PoolerParams, learn: bool, state: dict | None):
        self.pooler, self.learn = Pooler(p, state), learn

    def step(self, row: dict) -> tuple:
        active, overlap = self.pooler.compute(np.asarray(row["bits"] or [], np.int64), self.learn)
        return active.tolist(), int(overlap.max())

    def export(self) -> tuple:
        return self.pooler.export()


def run_series(df: DataFrame, p: PoolerParams, learn: bool = True, state: DataFrame | None = None) -> DataFrame:
    """(series, seq, active, max_overlap): df has series, seq and bits. One series is one task's work, in order.

    A series goes on from its row of ``state``, if that is given.
    """
    return series.run(df.select("series", "seq", "bits"), lambda s: _Series(p, learn, s), FIELDS, STATE, state)


def train(df: DataFrame, p: PoolerParams, state: DataFrame | None = None) -> DataFrame:
    """The state of each series (series, STATE) after its rows, for run_series, synapses or model_io.save."""
    return series.run(df.select("series", "seq", "bits"), lambda s: _Series(p, True, s), FIELDS, STATE, state, final=True)


def synapses(state: DataFrame) -> DataFrame:
    """(series, segment, presyn, perm) of states: of one series, what overlaps() takes."""
    return state.select("series", F.inline(F.arrays_zip("segment", "presyn", "perm")))


def columns(state: DataFrame) -> DataFrame:
    """(series, column, boost, overlap_duty, active_duty, min_duty) of states."""
    each = F.arrays_zip(F.sequence(F.lit(0), F.size("boost") - 1).alias("column"), "boost", "overlap_duty", "active_duty", "min_duty")
    return state.select("series", F.inline(each))


def winners_by_rank(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, column, overlap) of the k greatest overlaps, ties to the lower column: the exploded form."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("overlap"), "column"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


# ---- one step of learning, on tables ---------------------------------------------------------------------------------


def adapt_columns(synapses: DataFrame, active: DataFrame, columns: DataFrame, p: PoolerParams) -> DataFrame:
    """Synapses after a record: those of active columns (column) rise on active inputs (presyn) and fall elsewhere."""
    return adapt(synapses, active, columns.select(F.col("column").alias("segment")), p.increment, p.decrement)


def duty_cycles(df: DataFrame, keys: list[str], order: list[str], active: str, period: int) -> DataFrame:
    """(keys, column, duty) of the columns active in any row: their moving averages after all rows of each key, from 0.

    A row makes duty ((period - 1) * duty + x) / period, where x is 1 for active columns. Written out, a row that is i
    rows before the last one has the weight ((period - 1) / period) ** i / period: a window and a sum, in any number of tasks.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])) - 1
    rows = df.select(*keys, active, (F.pow(F.lit((period - 1) / period), back) / period).alias("__weight"))
    return rows.select(*keys, F.explode(active).alias("column"), "__weight").groupBy(*keys, "column").agg(F.sum("__weight").alias("duty"))


def boost_factors(duty: Column, target: Column, strength: float) -> Column:
    return F.exp(F.lit(float(strength)) * (target - duty))


def minimum_duty(columns: DataFrame, p: PoolerParams) -> DataFrame:
    """columns (column, overlap_duty) with min_duty, a share of the greatest one: of all, or with local inhibition of the neighbourhood."""
    if p.global_inhibition:
        return columns.join(F.broadcast(columns.agg((F.max("overlap_duty") * p.min_share_overlap).alias("min_duty"))))  # one row
    near = topology.neighbor_table(columns.sparkSession, p.columns, p.inhibition_radius, wrap=p.wrap, with_centre=True)
    most = near.join(columns.select(F.col("column").alias("nbr"), "overlap_duty"), "nbr").groupBy(F.col("cell").alias("column")).agg((F.max("overlap_duty") * p.min_share_overlap).alias("min_duty"))
    return columns.join(most, "column")


def bump_weak(synapses: DataFrame, columns: DataFrame, p: PoolerParams) -> DataFrame:
    """Synapses after columns (column, overlap_duty, min_duty) below their minimum got connected / 10 on all of theirs."""
    weak = columns.where("overlap_duty < min_duty").select(F.col("column").alias("segment"))
    return bump(synapses, weak, p.connected / 10)


def inhibition_radius(synapses: DataFrame, p: PoolerParams) -> DataFrame:
    """One row (radius): from the average span of each column's connected inputs, over columns and dimensions; 1 at least."""
    on, spans = synapses.where(F.col("perm") >= p.connected), []
    for d, n in enumerate(p.inputs):
        x = F.floor(F.col("presyn") / prod(p.inputs[d + 1 :])) % n
        spans.append((F.max(x) - F.min(x) + 1).alias(f"s{d}"))
    each = on.groupBy("segment").agg(*spans)
    total = each.agg(F.coalesce(F.sum(sum(F.col(f"s{d}") for d in range(len(p.inputs)))), F.lit(0)).alias("t"))
    ratio = prod(c / i for c, i in zip(p.columns, p.inputs, strict=False))
    span = F.col("t") / (p.num_columns * len(p.inputs))
    return total.select(F.greatest(F.lit(1), F.floor((span * ratio - 1) / 2 + 0.5).cast("int")).alias("radius"))
