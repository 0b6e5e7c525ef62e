"""Temporal memory: learns sequences of active columns, one series at a time, and says how unexpected each tick is."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require

from . import series
from .series import generator_state, restored_generator


@dataclass(frozen=True)
class MemoryParams:
    columns: tuple[int, ...] = (2048,)
    cells_per_column: int = 32
    activation: int = 13
    initial: float = 0.21
    connected: float = 0.5
    min_threshold: int = 10
    max_synapses: int = 255
    max_segments: int = 255
    max_new: int = 20
    increment: float = 0.1
    decrement: float = 0.1
    predicted_decrement: float = 0.0
    reinforce_on: str = "winner"
    seed: int = 42

    def __post_init__(self):
        require(bool(self.columns) and min(self.columns) > 0, "columns", "must be positive")
        require(self.cells_per_column > 0, "cells_per_column", "must be positive")
        require(self.reinforce_on in ("winner", "active"), "reinforce_on", "winner or active")

    @property
    def num_cells(self) -> int:
        return prod(self.columns) * self.cells_per_column


#: A memory's state: the cell of each segment (-1: gone), the synapses, the last tick, and the generator of random choices.
STATE = "cell_of array<int>, segment array<int>, presyn array<int>, perm array<double>, active array<int>, winners array<int>, draw string"


class Memory:
    """One series' memory. A segment is a row of presyn and perm, with its synapses at the left and -1 behind them."""

    def __init__(self, p: MemoryParams, state: dict | None = None):
        self.p = p
        self.draw = np.random.default_rng(p.seed)
        self.cells, self.free = np.full(64, -1, np.int64), []
        self.size = np.zeros(64, np.int64)
        self.presyn, self.perm = np.full((64, 8), -1, np.int64), np.zeros((64, 8))
        self.used, self.mark, self.place = 0, np.zeros(p.num_cells, bool), np.full(p.num_cells + 1, -1)
        self.segments_of: dict[int, list[int]] = {}
        self.segments_on = np.zeros(p.num_cells, np.int64)
        self.reset()
        if state is not None:
            self._restore(state)

    def reset(self) -> None:
        """Forgets the last tick, not what was learned."""
        self.active = self.winners = np.zeros(0, np.int64)

    # ---- state

    def export(self) -> tuple:
        at = np.arange(self.presyn.shape[1]) < self.size[: self.used, None]
        segment = np.nonzero(at)[0]
        parts = (self.cells[: self.used], segment, self.presyn[: self.used][at], self.perm[: self.used][at], self.active, self.winners)
        return *(x.tolist() for x in parts), generator_state(self.draw)

    def _restore(self, state: dict) -> None:
        cells = state["cell_of"]
        self._room(len(cells), int(np.bincount(state["segment"] or [0]).max()))
        self.used = len(cells)
        self.cells[: self.used] = cells
        self.free = [s for s, c in enumerate(cells) if c < 0]
        for s, c in enumerate(cells):
            if c >= 0:
                self.segments_of.setdefault(c, []).append(s)
                self.segments_on[c] += 1
        for s, x, v in zip(state["segment"], state["presyn"], state["perm"], strict=True):
            self.presyn[s, self.size[s]], self.perm[s, self.size[s]] = x, v
            self.size[s] += 1
        self.active, self.winners = (np.array(state[k], np.int64) for k in ("active", "winners"))
        self.draw = restored_generator(state["draw"])

    # ---- graph

    def _room(self, segments: int, synapses: int) -> None:
        """Makes room for so many segments and synapses of a segment, the latter in eights."""
        n, m = self.presyn.shape
        if segments <= n and synapses <= m:
            return
        wide = max(m, min(self.p.max_synapses, 2 * synapses) if synapses > m else 0, synapses)
        more = (max(n, 2 * segments if segments > n else 0), -(-wide // 8) * 8)
        if more != (n, m):
            grown = ((0, more[0] - n), (0, more[1] - m))
            self.presyn, self.perm = np.pad(self.presyn, grown, constant_values=-1), np.pad(self.perm, grown)
            self.cells, self.size = np.pad(self.cells, grown[0], constant_values=-1), np.pad(self.size, grown[0])

    def synapses_of(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(presyn, perm) of a segment, as views."""
        return self.presyn[s, : self.size[s]], self.perm[s, : self.size[s]]

    def _keep(self, s: int, stays: np.ndarray) -> None:
        presyn, perm = (x[stays] for x in self.synapses_of(s))
        self.presyn[s], self.perm[s] = -1, 0
        self.presyn[s, : len(presyn)], self.perm[s, : len(perm)] = presyn, perm
        self.size[s] = len(presyn)

    def destroy_segment(self, s: int) -> None:
        self._keep(s, np.zeros(self.size[s], bool))
        self.segments_of[int(self.cells[s])].remove(s)
        self.segments_on[self.cells[s]] -= 1
        self.cells[s] = -1
        self.free.append(s)

    def create_segment(self, cell: int) -> int:
        """A new segment of the cell; at the maximum, those with the fewest synapses go first. Ids of the gone are used again."""
        own = self.segments_of.setdefault(cell, [])
        while len(own) >= self.p.max_segments:
            self.destroy_segment(min(own, key=lambda s: (self.size[s], s)))
        if not self.free:
            self._room(self.used + 1, 0)
            self.free.append(self.used)
            self.used += 1
        s = self.free.pop()
        self.cells[s] = cell
        self.segments_on[cell] += 1
        own.append(s)
        return s

    def grow(self, s: int, candidates: np.ndarray, count: int) -> None:
        """Synapses on count of the distinct candidates that have none; over the maximum, the weakest old ones go."""
        old = self.synapses_of(s)[0]
        self.mark[old] = True
        new = candidates[~self.mark[candidates]]
        self.mark[old] = False
        self._put(s, self._drawn(new, count))

    def _drawn(self, new: np.ndarray, count: int) -> np.ndarray:
        return (self.draw.permutation(new)[:count] if len(new) > count else new)[: self.p.max_synapses]

    def _put(self, s: int, new: np.ndarray) -> None:
        """Adds synapses on new cells; over the maximum, the weakest old ones go."""
        over = self.size[s] + len(new) - self.p.max_synapses
        if over > 0:
            stays = np.ones(self.size[s], bool)
            stays[np.argsort(self.synapses_of(s)[1], kind="stable")[:over]] = False
            self._keep(s, stays)
        n = int(self.size[s])
        self._room(0, n + len(new))
        self.presyn[s, n : n + len(new)], self.perm[s, n : n + len(new)] = new, self.p.initial
        self.size[s] = n + len(new)

    def _grow_on(self, segments: np.ndarray, counts: np.ndarray, before: np.ndarray) -> None:
        """grow() for distinct segments, in order."""
        self.place[before] = np.arange(len(before))
        known = np.zeros((len(segments), len(before) + 1), bool)  # the last column is that of other cells
        known[np.arange(len(segments))[:, None], self.place[self.presyn[segments]]] = True
        self.place[before] = -1
        into, made = [], []
        for s, own, n, count in zip(segments.tolist(), ~known[:, :-1], self.size[segments].tolist(), counts.tolist(), strict=True):
            new = self._drawn(before[own], count)
            if n + len(new) > self.p.max_synapses:
                self._put(s, new)
            elif len(new):
                into.append(s)
                made.append(new)
        if into:
            into, more = np.array(into), np.array([len(x) for x in made])
            first = self.size[into]
            self._room(0, int((first + more).max()))
            row, at = np.repeat(into, more), np.arange(more.sum()) + np.repeat(first - np.cumsum(more) + more, more)
            self.presyn[row, at], self.perm[row, at] = np.concatenate(made), self.p.initial
            self.size[into] += more

    def _create_on(self, cells: np.ndarray, before: np.ndarray) -> None:
        """create_segment() for distinct cells, in order, each grown on max_new cells."""
        p = self.p
        if (self.segments_on[cells] >= p.max_segments).any():
            for cell in cells.tolist():
                self.grow(self.create_segment(cell), before, p.max_new)
            return
        self._room(self.used + len(cells), min(p.max_new, len(before), p.max_synapses))
        made = [self.create_segment(cell) for cell in cells.tolist()]
        new = np.tile(before, (len(made), 1))
        if len(before) > p.max_new:
            new = self.draw.permuted(new, axis=1)[:, : p.max_new]  # as a permutation of each row in turn
        new = new[:, : p.max_synapses]
        n = new.shape[1]
        self.presyn[made, :n], self.perm[made, :n], self.size[made] = new, p.initial, n

    def adapt(self, segments: np.ndarray, on: np.ndarray) -> None:
        """Raises the synapses of the segments on cells that are on (by cell), lowers the others; places without a synapse stay 0."""
        moved = self.perm[segments] + np.where(on[self.presyn[segments]], self.p.increment, -self.p.decrement)
        self.perm[segments] = np.minimum(np.maximum(moved, 0), 1)

    def _on(self, cells: np.ndarray) -> np.ndarray:
        on = np.zeros(self.p.num_cells + 1, bool)  # the last one is that of -1
        on[cells] = True
        return on

    def _potential(self, cells: np.ndarray) -> np.ndarray:
        """The synapses on active cells of each segment."""
        hit = self._on(cells).take(self.presyn[: self.used], mode="wrap")
        return np.bitwise_count(hit.view(np.uint64)).sum(axis=1, dtype=np.int64)  # eight at a time

    def _connected(self, segments: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (self._on(cells)[self.presyn[segments]] & (self.perm[segments] >= self.p.connected)).sum(axis=1)

    def activity(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(connected, potential) synapses on active cells of each segment."""
        return self._connected(np.arange(self.used), cells), self._potential(cells)

    # ---- a tick

    def predicted(self) -> np.ndarray:
        """Cells that the last tick predicts for the next one."""
        connected, _ = self.activity(self.active)
        return np.unique(self.cells[: self.used][(connected >= self.p.activation) & (self.cells[: self.used] >= 0)])

    def compute(self, columns: np.ndarray, learn: bool = True) -> dict:
        p, k = self.p, self.p.cells_per_column
        before, last, cells = self.winners, self.active, self.cells[: self.used]
        potential = self._potential(last)
        near = np.flatnonzero(potential >= min(p.activation, p.min_threshold))
        near = near[cells[near] >= 0]
        matching, active_segments = near[potential[near] >= p.min_threshold], near[potential[near] >= p.activation]
        if len(active_segments):  # a connected synapse is one of the potential ones
            active_segments = active_segments[self._connected(active_segments, last) >= p.activation]
        predicted = np.unique(cells[active_segments]) if len(active_segments) else active_segments
        if (columns[1:] <= columns[:-1]).any():
            columns = np.unique(columns)
        lit, foreseen = np.zeros((2, prod(p.columns)), bool)
        lit[columns], foreseen[predicted // k] = True, True
        hits, burst = columns[foreseen[columns]], columns[~foreseen[columns]]
        own = predicted[lit[predicted // k]]
        # A bursting column's winner is the cell of its best matching segment, else the one with the fewest segments.
        alone = lit & ~foreseen
        best = matching[alone[cells[matching] // k]]
        if len(best) > 1:
            best = best[np.lexsort((best, cells[best], -potential[best], cells[best] // k))]
            of = cells[best] // k
            best = best[np.r_[True, of[1:] != of[:-1]]]
        alone[cells[best] // k] = False
        made = np.flatnonzero(alone)
        made = made * k + self.segments_on.reshape(-1, k)[made].argmin(axis=1)
        active = np.sort(np.concatenate([own, (burst[:, None] * k + np.arange(k)).ravel()]))
        winners = np.sort(np.concatenate([own, cells[best], made]))
        if learn:
            adapted = np.concatenate([active_segments[lit[cells[active_segments] // k]], best])
            if len(adapted):
                self.adapt(adapted, self._on(before if p.reinforce_on == "winner" else last))
            if p.predicted_decrement > 0:
                wrong = matching[~lit[cells[matching] // k]]
                self.perm[wrong] = np.maximum(0, self.perm[wrong] - p.predicted_decrement)
            if len(before):
                more = p.max_new - potential[best]
                if (more > 0).any():
                    self._grow_on(best[more > 0], more[more > 0], before)
                if len(made):
                    self._create_on(made, before)
        self.active, self.winners = active, winners
        anomaly = 1 - len(hits) / len(columns) if len(columns) else 0.0
        return {
            "active_cells": active.tolist(), "winner_cells": winners.tolist(), "predicted_cells": predicted.tolist(), "anomaly": anomaly,
            "n_segments": self.used - len(self.free), "n_synapses": int(self.size[: self.used].sum()),
        }


FIELDS = "active_cells array<int>, winner_cells array<int>, predicted_cells array<int>, anomaly double, n_segments long, n_synapses long"
SCHEMA = "series string, seq long, " + FIELDS


class _Series:
    """A memory as series.run takes it: rows have cols and reset."""

    def __init__(self, p: MemoryParams, learn: bool, state: dict | None):
        self.memory, self.learn = Memory(p, state), learn

    def step(self, row: dict) -> tuple:
        if row["reset"]:
            self.memory.reset()
        return tuple(self.memory.compute(np.asarray(row["cols"] or [], np.int64), self.learn).values())

    def export(self) -> tuple:
        return self.memory.export()


def _rows(df: DataFrame) -> DataFrame:
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in df.columns else F.lit(False)
    return df.select("series", "seq", "cols", reset.alias("reset"))


def run_series(df: DataFrame, p: MemoryParams, learn: bool = True, state: DataFrame | None = None) -> DataFrame:
    """One row per tick: df has series, seq, cols (active columns) and optionally reset (before the tick).

    predicted_cells are those that were expected for this tick. One series is one task's work, in the order of seq; it
    goes on from its row of ``state``, if that is given.
    """
    return series.run(_rows(df), lambda s: _Series(p, learn, s), FIELDS, STATE, state)


def train(df: DataFrame, p: MemoryParams, state: DataFrame | None = None) -> DataFrame:
    """The state of each series (series, STATE) after its rows, for run_series, synapses or model_io.save."""
    return series.run(_rows(df), lambda s: _Series(p, True, s), FIELDS, STATE, state, final=True)


def segments(state: DataFrame) -> DataFrame:
    """(series, segment, cell) of states."""
    return state.select("series", F.posexplode("cell_of").alias("segment", "cell")).where("cell >= 0")


def synapses(state: DataFrame) -> DataFrame:
    """(series, segment, presyn, perm) of states."""
    return state.select("series", F.inline(F.arrays_zip("segment", "presyn", "perm")))


def column_of(cell, cells_per_column: int):
    """The column of a cell, as an expression."""
    return F.floor(cell / F.lit(cells_per_column)).cast("int")


def cells_of(column, cells_per_column: int):
    return F.sequence(column * F.lit(cells_per_column), column * F.lit(cells_per_column) + F.lit(cells_per_column - 1))
