"""Stateful streaming forms of the sequential operators, one state per series.

Each is a learner class with a step; a micro-batch's rows of a series are taken in the order of seq, the learner is
restored from the state store, run, and stored again. Rows that arrive after later ones of the same series have been
taken are dropped and counted in the column late of the next output row, so that results don't depend on restarts.
Without a ``timeout`` states are kept for ever. With one (in seconds; the input needs a watermark on its column ts), a state
goes when the watermark has passed its newest row by that time; late rows that are still uncounted then come in a last
row, whose seq is that of the last row taken and whose other fields are null.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import spatial_pooler, temporal_memory
from quillon.operators.anomaly import ERFC, Likelihood
from quillon.operators.classifier import Classifier


def keyed(df: DataFrame, make: Callable, step: Callable, fields: str, timeout: float | None = None) -> DataFrame:
    """Runs step(learner, row) -> tuple over the rows of each series; df has series, seq and whatever step reads.

    fields is the schema of the tuple. Output: series, seq, the fields, late.
    """
    names = [x.strip().split()[0] for x in _split(fields)]

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            _, last, late = pickle.loads(zlib.decompress(state.get[0]))
            state.remove()
            if late:
                yield pd.DataFrame([(key[0], last, *[None] * len(names), late)], columns=["series", "seq", *names, "late"])
            return
        learner, last, late = pickle.loads(zlib.decompress(state.get[0])) if state.exists else (make(), None, 0)
        rows = [r for f in frames for r in f.itertuples(index=False)]
        out = []
        for r in sorted(rows, key=lambda r: r.seq):
            if last is not None and r.seq <= last:
                late += 1
                continue
            out.append((key[0], r.seq, *step(learner, r), late))
            last, late = r.seq, 0
        state.update((zlib.compress(pickle.dumps((learner, last, late))),))
        if timeout is not None:
            newest = max([state.getCurrentWatermarkMs(), *(r.newest for r in rows if r.newest == r.newest)])
            state.setTimeoutTimestamp(int(newest) + int(1000 * timeout) + 1)
        yield pd.DataFrame(out, columns=["series", "seq", *names, "late"])

    kind = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.EventTimeTimeout
    if timeout is not None:
        df = df.withColumn("newest", F.unix_millis("ts"))
    return df.groupBy("series").applyInPandasWithState(run, f"series string, seq long, {fields}, late long", "model binary", "append", kind)


def _split(fields: str) -> list[str]:
    """Fields of a schema at its top level."""
    out, depth, now = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


class _Last:
    value: float | None = None


def delta(df: DataFrame, timeout: float | None = None) -> DataFrame:
    """delta: value minus the one before it, 0 at first. df may have a column reset: the value before is forgotten, as at the start of a session."""

    def step(last: _Last, row) -> tuple[float]:
        if getattr(row, "reset", None):
            last.value = None
        change = 0.0 if last.value is None else float(row.value) - last.value
        last.value = float(row.value)
        return (change,)

    return keyed(df, _Last, step, "delta double", timeout)


def _erfc(x: float) -> float:
    t = 1 / (1 + 0.5 * abs(x))
    tau = t * np.exp(-x * x + np.polyval(ERFC[::-1], t))
    return float(tau if x >= 0 else 2 - tau)


class LikelihoodState:
    """The sequential form of anomaly.Likelihood."""

    def __init__(self, p: Likelihood):
        self.p, self.i, self.last, self.mean, self.var, self.scores = p, 0, 0, 0.5, 1e-4, []

    def step(self, score: float) -> float:
        self.i += 1
        self.scores = [*self.scores, score][-self.p.samples :]
        if self.i >= self.p.learning and self.i - self.last >= self.p.every:
            if len(self.scores) >= 2:
                self.mean, self.var = float(np.mean(self.scores)), max(float(np.var(self.scores)), 1e-4)
            self.last = self.i
        return 0.5 if self.i < self.p.learning else 1 - 0.5 * _erfc((score - self.mean) / np.sqrt(self.var) / np.sqrt(2))


def likelihood(df: DataFrame, p: Likelihood, timeout: float | None = None) -> DataFrame:
    """df may have a column reset: all that was learned is forgotten before the row, as at the start of a session."""

    def step(s: LikelihoodState, row) -> tuple[float]:
        if getattr(row, "reset", None):
            s.__init__(p)
        return (s.step(float(row.value)),)

    return keyed(df, lambda: LikelihoodState(p), step, "likelihood double", timeout)


def pooler(df: DataFrame, p: spatial_pooler.PoolerParams, learn: bool = True, timeout: float | None = None) -> DataFrame:
    def step(s: spatial_pooler.Pooler, row) -> tuple:
        active, overlap = s.compute(np.asarray(row.bits if row.bits is not None else [], np.int64), learn)
        return active.tolist(), int(overlap.max())

    return keyed(df, lambda: spatial_pooler.Pooler(p), step, spatial_pooler.FIELDS, timeout)


def memory(df: DataFrame, p: temporal_memory.MemoryParams, learn: bool = True, timeout: float | None = None) -> DataFrame:
    """df may have a column reset: the last tick is forgotten before the row."""

    def step(s: temporal_memory.Memory, row) -> tuple:
        if getattr(row, "reset", None):
            s.reset()
        return tuple(s.compute(np.asarray(row.cols if row.cols is not None else [], np.int64), learn).values())

    return keyed(df, lambda: temporal_memory.Memory(p), step, temporal_memory.FIELDS, timeout)


def classifier(df: DataFrame, alpha: float = 0.001, steps: tuple[int, ...] = (1,), timeout: float | None = None) -> DataFrame:
    """probabilities of the first step's buckets before each row is learned; df may have a column reset, as in batch."""

    def step(c: Classifier, row) -> tuple:
        if getattr(row, "reset", None):
            c.reset()
        bits = np.asarray(row.bits, np.int64)
        p = c.infer(bits, steps[0]).tolist()
        c.learn(bits, int(row.bucket))
        return (p,)

    return keyed(df, lambda: Classifier(alpha, steps), step, "p array<double>", timeout)
