"""Softmax classification of SDRs into buckets, some steps ahead."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import series

#: Weights of so many rows travel to every task, more are joined by a shuffle.
BROADCAST_WEIGHTS = 2_000_000
#: Rows that a task learns at a time, fewer if they may have more than CHUNK_WEIGHTS weights; and weights that it gathers before it passes them on.
CHUNK_ROWS, CHUNK_WEIGHTS, OUTPUT_WEIGHTS = 8192, 1 << 22, 1 << 16


class Classifier:
    """One series' weights: for each step an array (bits, buckets) that grows as needed."""

    def __init__(self, alpha: float = 0.001, steps: tuple[int, ...] = (1,)):
        self.alpha, self.steps = alpha, steps
        self.weights = {s: np.zeros((0, 1)) for s in steps}
        self.history: deque[np.ndarray] = deque(maxlen=max(steps) + 1)

    def reset(self) -> None:
        self.history.clear()

    def _room(self, bits: int, buckets: int) -> None:
        for s, w in self.weights.items():
            if bits > w.shape[0] or buckets > w.shape[1]:
                self.weights[s] = np.pad(w, ((0, max(0, bits - w.shape[0])), (0, max(0, buckets - w.shape[1]))))

    def infer(self, bits: np.ndarray, step: int) -> np.ndarray:
        """The probability of each bucket."""
        w = self.weights[step]
        z = w[bits[bits < w.shape[0]]].sum(axis=0)
        e = np.exp(z - z.max())
        return e / e.sum()

    @staticmethod
    def best(p: np.ndarray) -> int:
        """The likeliest bucket; of equals the last."""
        return len(p) - 1 - int(np.argmax(p[::-1]))

    def learn(self, bits: np.ndarray, bucket: int) -> None:
        self._room(int(bits.max()) + 1 if len(bits) else 0, bucket + 1)
        self.history.append(bits)
        for s in self.steps:
            if len(self.history) > s:
                past = self.history[-1 - s]
                error = -self.infer(past, s)
                error[bucket] += 1
                self.weights[s][past] += self.alpha * error


#: A classifier's state: its weights other than 0, how many bits and buckets it knows, and the patterns it remembers.
STATE = "step array<int>, bit array<int>, bucket array<int>, w array<double>, n_bits int, n_buckets int, history array<array<int>>"


class _Open:
    """A series' classifier between chunks: weights (bits, steps, buckets) of the bits that it met, and the patterns it remembers."""

    def __init__(self, steps: tuple[int, ...], state: dict | None = None):
        self.bits, self.w = np.zeros(0, np.int64), np.zeros((0, len(steps), 1))
        self.n_bits, self.n_buckets, self.history = 0, 1, []
        if state is not None:
            of, bit, bucket = (np.array(state[x], np.int64) for x in ("step", "bit", "bucket"))
            self.n_bits, self.n_buckets = state["n_bits"], max(1, state["n_buckets"])
            self.bits, place = np.unique(bit, return_inverse=True)
            self.w = np.zeros((len(self.bits), len(steps), self.n_buckets))
            for j, s in enumerate(steps):
                self.w[place[of == s], j, bucket[of == s]] = np.array(state["w"], np.float64)[of == s]
            self.history = [np.array(x, np.int64) for x in state["history"]][-max(steps) - 1 :]

    def found(self, steps: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        """(step, bit, bucket, w) of the weights other than 0."""
        w = self.w.transpose(1, 0, 2)
        j, b, k = np.nonzero(w)
        return np.array(steps, np.int32)[j], self.bits[b].astype(np.int32), k.astype(np.int32), w[j, b, k]


def _learn(opened: list[_Open], of: np.ndarray, sizes: np.ndarray, bits: np.ndarray, bucket: np.ndarray, reset: np.ndarray, alpha: float, steps: tuple[int, ...]) -> None:
    """What Classifier.learn() does with rows of many series, sorted by ``of``, their place in opened: the k-th rows of all at once."""
    count, old, knew = len(opened), [x for o in opened for x in o.history], np.array([o.n_buckets for o in opened])
    # The patterns that a series remembers go before its rows.
    of = np.concatenate([np.repeat(np.arange(count), [len(o.history) for o in opened]), of])
    order = np.argsort(of, kind="stable")
    size = np.concatenate([[len(x) for x in old], sizes]).astype(np.int64)
    start, of, size = (np.cumsum(size) - size)[order], of[order], size[order]
    first = np.cumsum(size) - size
    flat = np.concatenate([*old, bits]).astype(np.int64)[np.repeat(start - first, size) + np.arange(size.sum())]
    learns = np.concatenate([np.zeros(len(old), bool), np.ones(len(bucket), bool)])[order]
    target = np.concatenate([np.zeros(len(old), np.int64), bucket])[order]
    here, begin = np.arange(len(of)), np.searchsorted(of, np.arange(count))
    since = np.concatenate([np.zeros(len(old), bool), reset])[order] | (here == begin[of])
    since = np.maximum.accumulate(np.where(since, here, 0))  # the first pattern that a row may look back to
    # A series knows the buckets of its rows so far.
    buckets = max(int(knew.max()), int(target.max()) + 1)
    known = np.maximum.accumulate(of * (buckets + 1) + np.maximum(knew[of], np.where(learns, target + 1, 0))) - of * (buckets + 1)
    target = np.where(target < 0, target + known, target)

    # A slot for each bit of each series, and those of its weights so far.
    had = np.array([len(o.bits) for o in opened])
    value = np.concatenate([*[o.bits for o in opened], flat])
    low = int(value.min(initial=0))
    span = int(value.max(initial=0)) - low + 1
    slots, at = np.unique(np.concatenate([np.repeat(np.arange(count), had), np.repeat(of, size)]) * span + (value - low), return_inverse=True)
    w = np.zeros((len(slots), len(steps), buckets))
    done = np.concatenate([[0], np.cumsum(had)])
    for k, o in enumerate(opened):
        w[at[done[k] : done[k + 1]], :, : o.w.shape[2]] = o.w
    at = at[done[-1] :]

    turn = here - begin[of]
    by_turn = np.argsort(turn, kind="stable")
    for now in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
        for j, s in enumerate(steps):
            rows = now[learns[now] & (now - s >= since[now])]
            rows = rows[size[rows - s] > 0]
            if not len(rows):
                continue
            n = size[rows - s]
            edge = np.cumsum(n) - n
            slot = at[np.repeat(first[rows - s] - edge, n) + np.arange(n.sum())]
            z = np.add.reduceat(w[slot, j], edge, axis=0)
            z[np.arange(buckets) >= known[rows, None]] = -np.inf
            e = np.exp(z - z.max(axis=1, keepdims=True))
            error = -e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), target[rows]] += 1
            w[slot, j] += np.repeat(alpha * error, n, axis=0)  # once for a bit that a pattern has twice

    edges, ends = np.searchsorted(slots, np.arange(count + 1) * span), np.append(begin[1:], len(of))
    for k, o in enumerate(opened):
        if ends[k] > begin[k]:
            a, b = max(since[ends[k] - 1], ends[k] - max(steps) - 1), ends[k]
            o.history = [flat[first[i] : first[i] + size[i]].copy() for i in range(a, b)]
            o.n_bits = max(o.n_bits, int(flat[first[begin[k]] : first[b - 1] + size[b - 1]].max(initial=-1)) + 1)
            o.n_buckets = int(known[b - 1])
        o.bits, o.w = slots[edges[k] : edges[k + 1]] - k * span + low, w[edges[k] : edges[k + 1], :, : o.n_buckets].copy()


def _trained(df: DataFrame, alpha: float, steps: tuple[int, ...], state: DataFrame | None, made: str, columns: Callable) -> DataFrame:
    """The rows (of type ``made``) that columns(names, learners) gives of series and their learners after the rows of df."""
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in df.columns else F.lit(False)
    rows = df.where("bits is not null and bucket is not null").select("series", "seq", "bits", F.col("bucket").cast("int").alias("bucket"), reset.alias("reset"))
    out, resumed = T._parse_datatype_string(made), state is not None

    def task(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, names, learners, weights = to_arrow_schema(out), [], [], 0

        def flush():
            nonlocal names, learners, weights
            given, names, learners, weights = columns(names, learners), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(given, kinds, strict=True)], schema=kinds)

        last = None  # (name, learner) of the series that may go on
        for batch in batches:
            bits, top = batch.column("bits"), batch.column("bucket").fill_null(0).to_numpy(zero_copy_only=False).max(initial=0) + 1
            each = max(1, len(bits.flatten()) // max(1, batch.num_rows)) * len(steps) * int(top)
            most = max(1, min(CHUNK_ROWS, CHUNK_WEIGHTS // each))
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                series, seq = part.column("series"), part.column("seq")
                code = series.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                begins = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
                opened = []
                for i in begins.tolist():
                    name = series[i].as_py()
                    if i == 0 and last is not None and last[0] == name:
                        opened.append(last)
                    else:
                        opened.append((name, _Open(steps, part.column("__state")[i].as_py() if resumed else None)))
                        if i == 0 and last is not None:
                            names.append(last[0])
                            learners.append(last[1])
                own = part.filter(seq.is_valid())
                if own.num_rows:
                    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(code))))[seq.is_valid().to_numpy(zero_copy_only=False)]
                    bit, bucket, fresh = (own.column(c) for c in ("bits", "bucket", "reset"))
                    sizes = bit.value_lengths().to_numpy(zero_copy_only=False)
                    values = [c.to_numpy(zero_copy_only=False) for c in (bit.flatten(), bucket, fresh)]
                    _learn([o for _, o in opened], of, sizes, values[0], values[1].astype(np.int64), values[2], alpha, steps)
                last = opened.pop()
                names += [n for n, _ in opened]
                learners += [o for _, o in opened]
                weights += sum(o.w.size for _, o in opened)
                if weights >= OUTPUT_WEIGHTS:
                    yield flush()
        if last is not None:
            names.append(last[0])
            learners.append(last[1])
        if names:
            yield flush()

    return series.dealt(rows, STATE, state).mapInArrow(task, out)


def train(df: DataFrame, alpha: float = 0.001, steps: tuple[int, ...] = (1,), state: DataFrame | None = None) -> DataFrame:
    """The state of each series (series, STATE) after its rows (series, seq, bits, bucket and optionally reset), in order.

    reset forgets the patterns before the row, not the weights. Rows without bits or bucket take no part.
    """

    def columns(names: list, learners: list[_Open]) -> list:
        found = zip(*[o.found(steps) for o in learners], strict=True)
        return [names, *map(list, found), [o.n_bits for o in learners], [o.n_buckets for o in learners], [[x.astype(np.int32) for x in o.history] for o in learners]]

    return _trained(df, alpha, steps, state, f"series string, {STATE}", columns)


def weights(state: DataFrame) -> DataFrame:
    """(series, step, bit, bucket, w) of states."""
    return state.select("series", F.inline(F.arrays_zip("step", "bit", "bucket", "w")))


def learn_series(df: DataFrame, alpha: float = 0.001, steps: tuple[int, ...] = (1,), state: DataFrame | None = None) -> DataFrame:
    """weights() of train(), a row for each weight from the start: (series, step, bit, bucket, w)."""

    def columns(names: list, learners: list[_Open]) -> list:
        import pyarrow as pa

        found = [o.found(steps) for o in learners]
        of = np.repeat(np.arange(len(names)), [len(f[0]) for f in found])
        return [pa.array(names, pa.string()).take(pa.array(of)), *[np.concatenate(c) for c in zip(*found, strict=True)]]

    return _trained(df, alpha, steps, state, "series string, step int, bit int, bucket int, w double", columns)


def infer(df: DataFrame, weights: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """(keys, step, bucket, p): df has keys and bits; weights (step, bit, bucket, w), of each series if ``by`` names its column.

    Bits without weights count 0; every bucket that the weights know gets a probability. Up to BROADCAST_WEIGHTS weights
    of all rows alike travel to the rows, which are then done without a shuffle; others are joined.
    """
    if by is None and weights.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS:
        return _infer_rows(df, weights, keys)
    on = [by] if by else []
    grid = weights.select(*on, "step", "bucket").distinct()
    summed = df.select(*keys, F.explode("bits").alias("bit")).join(weights, [*on, "bit"]).groupBy(*keys, "step", "bucket").agg(F.sum("w").alias("z"))
    if on:
        every = df.select(*keys).join(grid, on)
    else:  # as many rows as there are probabilities
        each = grid.agg(F.collect_set(F.struct("step", "bucket")).alias("grid")).first()["grid"]
        every = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(r["step"]).alias("step"), F.lit(r["bucket"]).alias("bucket")) for r in each])))
    z = every.join(summed, [*keys, "step", "bucket"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    own = Window.partitionBy(*keys, "step")
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(own)))
    return e.select(*keys, "step", "bucket", (F.col("e") / F.sum("e").over(own)).alias("p"))


def _infer_rows(df: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    got = weights.select("step", "bit", "bucket", F.col("w").cast("double")).toArrow()
    step, bit, bucket, w = (got.column(k).to_numpy() for k in range(4))
    tables = []
    for s in np.unique(step).tolist():
        own = step == s
        known, place = np.unique(bucket[own], return_inverse=True)
        dense = np.zeros((int(bit.max()) + 2, len(known)))  # the last row is that of unknown bits
        np.add.at(dense, (bit[own], place), w[own])
        tables.append((s, known, dense))
    shared, rows = df.sparkSession.sparkContext.broadcast(tables), df.select(*keys, "bits")
    made = [T.StructField("step", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("p", T.DoubleType())]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column, n = batch.column(len(keys)), batch.num_rows
            bits = column.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for s, known, dense in shared.value:
                of = np.where((bits >= 0) & (bits < len(dense)), bits, len(dense) - 1)
                z = np.stack([np.bincount(row, dense[of, k], n) for k in range(len(known))], axis=1)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                own = [c.take(pa.array(np.repeat(np.arange(n), len(known)))) for c in batch.columns[: len(keys)]]
                columns = [np.full(e.size, s, np.int32), np.tile(known, n).astype(np.int32), e.ravel()]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns)], [*keys, *[m.name for m in made]])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], *made]))


def best(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, bucket): the likeliest; of equals the last."""
    return probabilities.groupBy(*keys, "step").agg(F.max_by("bucket", F.struct("p", "bucket")).alias("bucket"))
