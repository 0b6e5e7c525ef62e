"""Ticks of many records on a graph that is small enough to travel to every task: one pass over the records, without a shuffle.

A task holds the graph as arrays and counts a run of records at a time, at most CELLS pairs of record and segment. What
ticks.py says by joins of records and segments is said here by masks over (record, segment) and (record, column), so that
nothing that grows with the records leaves its task but the result.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import draws

from . import connections
from .connections import ranges
from .temporal_memory import MemoryParams

#: Counts that a task holds at a time, of records by segments or by inputs.
CELLS = 1 << 20
DELTA = T.StructType([
    T.StructField("segment", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("presyn", T.IntegerType()),
    T.StructField("was", T.DoubleType()), T.StructField("perm", T.DoubleType()), T.StructField("new", T.BooleanType()),
])


def begins(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow column of int lists, and the row of each; nulls among the values are left out."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, values = np.repeat(np.arange(len(column)), lengths), column.flatten()
    if values.null_count:
        row = row[values.is_valid().to_numpy(zero_copy_only=False)]
        values = values.drop_null()
    return values.to_numpy(zero_copy_only=False).astype(np.int64), row


class Tick:
    """What a run of records counts on each segment, and the masks that follow; segments are in the order (column, cell, segment)."""

    def __init__(self, graph: TickGraph, before, cols=None):
        p, self.rows = graph.p, len(before)
        bits, row = flat(before)
        self.bits, self.bit_row = bits, row
        known = (bits >= 0) & (bits < graph.inputs)
        own, of = bits[known], row[known]
        key = np.repeat(of, graph.begin[own + 1] - graph.begin[own]) * graph.size
        at = ranges(graph.begin, own)
        key += graph.local[at]
        shape, cells = (self.rows, graph.size), self.rows * graph.size
        self.potential = np.bincount(key, minlength=cells).reshape(shape)
        self.connected = np.bincount(key[graph.connected[at]], minlength=cells).reshape(shape)
        if cols is None:
            return
        self.active = (self.connected >= p.activation) & (self.potential > 0)
        self.matching = (self.potential >= p.min_threshold) & (self.potential > 0)
        # By column: whether one of its segments is active, and the best of the matching ones (-1: none).
        place = graph.size - 1 - np.arange(graph.size)
        rank = np.where(self.matching, self.potential * graph.size + place, -1)
        if graph.size:
            self.predicted = np.logical_or.reduceat(self.active, graph.first_of, axis=1)
            top = np.maximum.reduceat(rank, graph.first_of, axis=1)
            self.known = np.logical_or.reduceat(self.active | self.matching, graph.first_of, axis=1)
        else:
            self.predicted = self.known = np.zeros((self.rows, 0), bool)
            top = np.zeros((self.rows, 0), np.int64)
        self.best = np.where(top >= 0, graph.size - 1 - top % max(1, graph.size), -1)
        # The columns that are active now: (row, column) once each, and as a mask over the columns with segments.
        col, row = flat(cols)
        low = int(col.min(initial=0))
        span = int(col.max(initial=low)) - low + 1
        pairs = np.unique(row * span + (col - low))
        self.col_row, self.col = pairs // span, pairs % span + low
        self.col_at = graph.column_places(self.col)
        self.on = np.zeros(self.predicted.shape, bool)
        have = self.col_at >= 0
        self.on[self.col_row[have], self.col_at[have]] = True

    def of_column(self, values: np.ndarray, none) -> np.ndarray:
        """values (row, column with segments) of each active column."""
        out = np.full(len(self.col), none)
        have = self.col_at >= 0
        out[have] = values[self.col_row[have], self.col_at[have]]
        return out

    def changes(self, graph: TickGraph):
        """(row, segment's place, adapt, grow) of the segments that learning would change."""
        on, predicted = self.on[:, graph.column_of], self.predicted[:, graph.column_of]
        burst = on & ~predicted & (self.best[:, graph.column_of] == np.arange(graph.size))
        adapt = (on & self.active) | burst
        row, at = np.nonzero(adapt | (~on & self.matching))
        grow = np.where(burst[row, at], np.maximum(0, graph.p.max_new - self.potential[row, at]), 0)
        return row, at, adapt[row, at], grow


class TickGraph:
    """The graph's tables as arrays, and what each tick asks of them."""

    def __init__(self, segments, synapses, p: MemoryParams):
        self.p = p
        segment, cell = (segments.column(k).to_numpy().astype(np.int64) for k in range(2))
        order = np.lexsort((segment, cell, cell // p.cells_per_column))
        self.segment, self.cell = segment[order], cell[order]
        self.size, self.next = len(order), int(segment.max(initial=-1)) + 1
        self.columns, self.first_of, self.column_of = np.unique(self.cell // p.cells_per_column, return_index=True, return_inverse=True)
        own, presyn, perm = (synapses.column(k).to_numpy() for k in range(3))
        by_id = np.argsort(self.segment)
        at = np.minimum(np.searchsorted(self.segment, own, sorter=by_id), max(0, self.size - 1))
        known = self.segment[by_id[at]] == own if self.size else np.zeros(len(own), bool)
        local, presyn, perm = (by_id[at[known]] if self.size else np.zeros(0, np.int64)), presyn[known].astype(np.int64), perm[known]
        # By input, as they are; by segment, a row for each pair with its greatest permanence.
        order = np.lexsort((local, presyn))
        self.local, self.connected = local[order], perm[order] >= p.connected
        self.inputs = int(presyn.max(initial=-1)) + 1
        self.begin = np.searchsorted(presyn[order], np.arange(self.inputs + 1))
        order = np.lexsort((-perm, presyn, local))
        local, presyn, perm = local[order], presyn[order], perm[order]
        once = np.r_[True, (local[1:] != local[:-1]) | (presyn[1:] != presyn[:-1])] if len(local) else np.zeros(0, bool)
        self.own_segment, self.own_presyn, self.own_perm = local[once], presyn[once], perm[once]
        self.own_begin = np.searchsorted(self.own_segment, np.arange(self.size + 1))
        # Of each column the cell with the fewest segments.
        counts = np.bincount(cell, minlength=p.num_cells)[: p.num_cells].reshape(-1, p.cells_per_column)
        self.least = counts.argmin(axis=1) + np.arange(len(counts)) * p.cells_per_column

    @classmethod
    def gather(cls, segments: DataFrame, synapses: DataFrame, p: MemoryParams) -> TickGraph | None:
        """The graph, if it has at most BROADCAST_SYNAPSES segments and synapses each, else None."""
        most = connections.BROADCAST_SYNAPSES
        if any(x.limit(most + 1).count() > most for x in (segments, synapses)):
            return None
        return cls(segments.select("segment", "cell").toArrow(), synapses.select("segment", "presyn", F.col("perm").cast("double")).toArrow(), p)

    def column_places(self, col: np.ndarray) -> np.ndarray:
        """The place of each column among those with segments, -1 for others."""
        at = np.minimum(np.searchsorted(self.columns, col), max(0, len(self.columns) - 1))
        return np.where(self.columns[at] == col, at, -1) if len(self.columns) else np.full(len(col), -1)

    def run(self, df: DataFrame, keys: list[str], columns: list[Column], fields: list[T.StructField], work, cells: int = CELLS) -> DataFrame:
        """(keys, fields): work(graph, columns of a run of records) gives the record of each row and the Arrow columns of fields."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        rows = df.select(*keys, *[c.alias(f"__c{n}") for n, c in enumerate(columns)])
        names = [*keys, *[f.name for f in fields]]

        def task(batches):
            import pyarrow as pa

            graph, n = shared.value, len(keys)
            step = max(1, cells // max(1, graph.size, graph.inputs, graph.p.num_cells))
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    some = batch.slice(k, step)
                    row, made = work(graph, some.columns[n:])
                    own = some.columns[:n] if row is None else [c.take(pa.array(row)) for c in some.columns[:n]]
                    yield pa.RecordBatch.from_arrays([*own, *made], names)

        return rows.mapInArrow(task, T.StructType([*[rows.schema[k] for k in keys], *fields]))


def lists(row: np.ndarray, values: np.ndarray, rows: int):
    """An Arrow column of int lists, ascending, from (row, value)."""
    import pyarrow as pa

    order = np.lexsort((values, row))
    return pa.ListArray.from_arrays(pa.array(begins(np.bincount(row, minlength=rows)).astype(np.int32)), pa.array(values[order].astype(np.int32)))


def activity(graph: TickGraph, df: DataFrame, keys: list[str], before: str, deltas: str | None = None) -> DataFrame:
    """ticks.segment_activity() in one pass; deltas is a column of arrays as learned() gives them."""

    def work(graph: TickGraph, columns):
        import pyarrow as pa

        p, tick = graph.p, Tick(graph, columns[0])
        row, at = np.nonzero(tick.potential)
        segment, cell, connected, potential = graph.segment[at], graph.cell[at], tick.connected[row, at], tick.potential[row, at]
        if len(columns) > 1:
            own = columns[1]
            lengths = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            d_row, d = np.repeat(np.arange(len(own)), lengths), own.flatten()
            d_segment, d_cell, presyn = (d.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            was, perm = (d.field(k).to_numpy(zero_copy_only=False) for k in (3, 4))  # NaN for null
            wide = max(int(tick.bits.max(initial=-1)), int(presyn.max(initial=-1))) + 1
            times = np.bincount(tick.bit_row * wide + tick.bits, minlength=tick.rows * wide)[d_row * wide + presyn]
            more = ((~np.isnan(perm)).astype(np.int64) - ~np.isnan(was)) * times
            linked = ((perm >= p.connected).astype(np.int64) - (was >= p.connected)) * times
            met = times > 0
            all_ = [np.concatenate(x) for x in ((row, d_row[met]), (segment, d_segment[met]), (cell, d_cell[met]), (connected, linked[met]), (potential, more[met]))]
            order = np.lexsort((all_[2], all_[1], all_[0]))
            row, segment, cell, connected, potential = (x[order] for x in all_)
            if len(row):
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(segment) != 0) | (np.diff(cell) != 0)])
                connected, potential = np.add.reduceat(connected, first), np.add.reduceat(potential, first)
                some = potential > 0
                row, segment, cell, connected, potential = row[first][some], segment[first][some], cell[first][some], connected[some], potential[some]
        made = [segment.astype(np.int32), cell.astype(np.int32), connected, potential, connected >= p.activation, potential >= p.min_threshold]
        return row, [pa.array(c) for c in made]

    kinds = zip(("segment", "cell", "connected", "potential", "active", "matching"), (T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType(), T.BooleanType(), T.BooleanType()), strict=True)
    return graph.run(df, keys, [F.col(c) for c in (before, deltas) if c], [T.StructField(*k) for k in kinds], work, CELLS // 8 if deltas else CELLS)


def compute(graph: TickGraph, df: DataFrame, keys: list[str], before: str, cols: str) -> DataFrame:
    """ticks.compute() in one pass."""

    def work(graph: TickGraph, columns):
        import pyarrow as pa

        k, tick = graph.p.cells_per_column, Tick(graph, *columns)
        row, at = np.nonzero(tick.active)
        span = int(max(graph.cell.max(initial=0), tick.col.max(initial=0) * k + k)) + 1
        predicted = np.unique(row * span + graph.cell[at])
        row, cell = predicted // span, predicted % span
        in_on = tick.on[row, graph.column_places(cell // k)]
        own = tick.of_column(tick.predicted, False)
        burst_row, burst_col = tick.col_row[~own], tick.col[~own]
        best = tick.of_column(tick.best, -1)[~own]
        won = np.where(best >= 0, graph.cell[best] if graph.size else -1, graph.least[burst_col])
        active = lists(np.r_[row[in_on], np.repeat(burst_row, k)], np.r_[cell[in_on], (burst_col[:, None] * k + np.arange(k)).ravel()], tick.rows)
        winners = lists(np.r_[row[in_on], burst_row], np.r_[cell[in_on], won], tick.rows)
        n = np.bincount(tick.col_row, minlength=tick.rows)
        anomaly = np.where(n > 0, 1 - np.bincount(tick.col_row[own], minlength=tick.rows) / np.maximum(n, 1), 0.0)
        return None, [active, winners, lists(row, cell, tick.rows), pa.array(anomaly)]

    cells = T.ArrayType(T.IntegerType())
    fields = [T.StructField(c, cells) for c in ("active_cells", "winner_cells", "predicted_cells")]
    return graph.run(df, keys, [F.col(before), F.col(cols)], [*fields, T.StructField("anomaly", T.DoubleType())], work)


def changes(graph: TickGraph, df: DataFrame, keys: list[str], before: str, cols: str) -> DataFrame:
    """ticks.changes() in one pass."""

    def work(graph: TickGraph, columns):
        import pyarrow as pa

        row, at, adapt, grow = Tick(graph, *columns).changes(graph)
        change = pa.DictionaryArray.from_arrays(pa.array(adapt.astype(np.int8)), pa.array(["punish", "adapt"])).cast(pa.string())
        return row, [pa.array(graph.segment[at].astype(np.int32)), change, pa.array(grow)]

    fields = [T.StructField("segment", T.IntegerType()), T.StructField("change", T.StringType()), T.StructField("grow", T.LongType())]
    return graph.run(df, keys, [F.col(before), F.col(cols)], fields, work)


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """values as Spark's round() gives them, by their shortest decimals and half up, without a negative zero; NaN and numbers without a fraction stay."""
    if digits is None:
        return values
    each, at = np.unique(values, return_inverse=True)
    unit = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) + 0.0 if abs(x) < 1 << 53 else x for x in each.tolist()], float)[at]


class Lessons:
    """What records with equal cells, winners and columns learn: the rows that are sure, and the choices that each record's own draws decide.

    Both are in the order of the records that they were made from, whose parts begin at sure_begin and choice_begin. A choice takes so
    many of its candidates, which are ascending; tails are the ends of the texts that they are drawn by.
    """

    def __init__(self, graph: TickGraph, before, winners, cols, digits: int | None = None):
        p, tick = graph.p, Tick(graph, before, cols)
        row, at, adapt, grow = tick.changes(graph)
        w_bits, w_row = flat(winners)
        r_bits, r_row = (w_bits, w_row) if p.reinforce_on == "winner" else (tick.bits, tick.bit_row)
        wide = max(graph.inputs, int(w_bits.max(initial=-1)) + 1, int(r_bits.max(initial=-1)) + 1)
        reward, former = np.zeros((tick.rows, wide), bool), np.zeros((tick.rows, wide), bool)
        reward[r_row, r_bits], former[w_row, w_bits] = True, True

        # Growing segments: best ones of bursting columns, and new ones where no segment matches, numbered by their columns.
        alone = ~tick.of_column(tick.known, False) & (np.bincount(w_row, minlength=tick.rows) > 0)[tick.col_row] & (tick.col >= 0) & (tick.col < len(graph.least))
        new_row, new_col = tick.col_row[alone], tick.col[alone]  # in the order (row, column)
        number = np.arange(len(new_row)) - np.searchsorted(new_row, new_row)
        g_row, g_grow = np.r_[row[grow > 0], new_row], np.r_[grow[grow > 0], np.full(len(new_row), p.max_new)]
        g_at = np.r_[at[grow > 0], np.full(len(new_row), -1)]
        g_segment, g_cell = np.r_[graph.segment[at[grow > 0]], graph.next + number], np.r_[graph.cell[at[grow > 0]], graph.least[new_col]]
        w_begin, (f_row, f_bits) = begins(former.sum(axis=1)), np.nonzero(former)
        free = np.repeat(np.arange(len(g_row)), (w_begin[1:] - w_begin[:-1])[g_row])
        presyn = f_bits[ranges(w_begin, g_row)]
        pair = graph.own_segment * wide + graph.own_presyn  # ascending
        key = g_at[free] * wide + presyn  # negative for new segments
        has = pair[np.minimum(np.searchsorted(pair, key), len(pair) - 1)] == key if len(pair) else np.zeros(len(key), bool)
        free, presyn = free[~has], presyn[~has]
        n_free = np.bincount(free, minlength=len(g_row))
        take = np.clip(np.minimum(g_grow, p.max_synapses), 0, n_free)
        drawn = (take > 0) & (take < n_free)

        # Old synapses, of which the weakest go where a segment would have too many.
        more = np.zeros((tick.rows, graph.size), np.int64)
        old = g_at >= 0
        more[g_row[old], g_at[old]] = take[old]
        if p.predicted_decrement <= 0:
            row, at, adapt = row[adapt], at[adapt], adapt[adapt]
        n = graph.own_begin[at + 1] - graph.own_begin[at]
        of, place = np.repeat(np.arange(len(row)), n), ranges(graph.own_begin, at)
        input_, was = graph.own_presyn[place], graph.own_perm[place]
        step = np.where(adapt[of], np.where(reward[row[of], input_], p.increment, -p.decrement), -p.predicted_decrement)
        perm = np.clip(was + step, 0.0, 1.0)
        over = (n + more[row, at] - p.max_synapses)[of]
        full = (more[row, at][of] > 0) & (over > 0)
        if full.any():
            some = np.flatnonzero(full)
            some = some[np.lexsort((input_[some], perm[some], of[some]))]
            weak = np.arange(len(some)) - np.searchsorted(of[some], of[some]) + 1
            perm[some[weak <= over[some]]] = np.nan
        moved = perm != was
        of, input_, was, perm = of[moved], input_[moved], was[moved], perm[moved]
        at, row = at[of], row[of]

        whole = (take > 0) & ~drawn  # segments that take all that is free
        own = free[whole[free]]
        all_row = np.r_[row, g_row[own]]
        order = np.argsort(all_row, kind="stable")
        numbers = [np.r_[graph.segment[at], g_segment[own]], np.r_[graph.cell[at], g_cell[own]], np.r_[input_, presyn[whole[free]]]]
        self.initial = float(rounded(np.array([p.initial], float), digits)[0])
        values = [np.r_[rounded(was, digits), np.full(len(own), np.nan)], np.r_[rounded(perm, digits), np.full(len(own), self.initial)], np.r_[np.zeros(len(row), bool), g_at[own] < 0]]
        self.sure = [c[order].astype(np.int32) for c in numbers] + [c[order] for c in values]
        self.sure_begin = begins(np.bincount(all_row, minlength=tick.rows))

        chosen = np.flatnonzero(drawn)
        chosen = chosen[np.argsort(g_row[chosen], kind="stable")]
        self.choice = [g_segment[chosen].astype(np.int32), g_cell[chosen].astype(np.int32), g_at[chosen] < 0, take[chosen]]
        self.choice_begin = begins(np.bincount(g_row[chosen], minlength=tick.rows))
        self.candidates = presyn[ranges(begins(n_free), chosen)].astype(np.int32)
        self.candidates_begin = begins(n_free[chosen])
        self.tails = draws.tails(np.repeat(g_segment[chosen], n_free[chosen]), self.candidates)

    def add(self, other: Lessons) -> None:
        """Puts other's records behind the own ones."""
        self.sure, self.choice = ([np.concatenate(c) for c in zip(a, b, strict=True)] for a, b in ((self.sure, other.sure), (self.choice, other.choice)))
        self.candidates, self.tails = np.concatenate([self.candidates, other.candidates]), np.concatenate([self.tails, other.tails])
        for name in ("sure_begin", "choice_begin", "candidates_begin"):
            a, b = getattr(self, name), getattr(other, name)
            setattr(self, name, np.r_[a, b[1:] + a[-1]])

    def rows(self, of: np.ndarray, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The record of each row, and the columns of DELTA, of records that learn as those at of and are drawn by texts."""
        at = ranges(self.sure_begin, of)
        choice = ranges(self.choice_begin, of)
        row = np.repeat(np.arange(len(of)), np.diff(self.choice_begin)[of])
        candidate, n = ranges(self.candidates_begin, choice), np.diff(self.candidates_begin)[choice]
        group = np.repeat(np.arange(len(choice)), n)
        draw = draws.upper(texts, row[group], self.tails, candidate)
        begin, place = begins(n), np.arange(len(group))
        place = place - begin[group]
        bits, wide = int(place.max(initial=0)).bit_length(), len(choice).bit_length()
        if bits + wide + 32 <= 64:  # a number says the choice, the draw and the place
            place = np.sort((group.astype(np.uint64) << np.uint64(32 + bits)) | (draw.astype(np.uint64) << np.uint64(bits)) | place.astype(np.uint64))
            place = (place & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            place = place[np.lexsort((place, draw, group))]
        take = self.choice[3][choice]
        group = np.repeat(np.arange(len(choice)), take)
        first = begins(take)
        place = place[np.arange(len(group)) - first[group] + begin[group]]
        choice = choice[group]
        segment, cell, new = (c[choice] for c in self.choice[:3])
        made = [segment, cell, self.candidates[self.candidates_begin[choice] + place], np.full(len(choice), np.nan), np.full(len(choice), self.initial), new]
        sure_row = np.repeat(np.arange(len(of)), np.diff(self.sure_begin)[of])
        return np.r_[sure_row, row[group]], [np.r_[a[at], b] for a, b in zip(self.sure, made, strict=True)]


class Taught:
    """Lessons of the distinct records that a task has met, at most so many; beyond that it starts again with those of the run at hand."""

    def __init__(self, most: int, digits: int | None = None):
        self.most, self.digits, self.at, self.lessons = most, digits, {}, None

    def rows(self, graph: TickGraph, texts: list[str], columns) -> tuple[np.ndarray, list[np.ndarray]]:
        """(record, columns of DELTA) of a run of records: columns are their before, winners and cols."""
        parts = []
        for values, row in map(flat, columns):
            begin, data = (begins(np.bincount(row, minlength=len(texts))) * values.itemsize).tolist(), values.tobytes()
            parts.append([data[a:b] for a, b in zip(begin, begin[1:], strict=False)])
        keys = list(zip(*parts, strict=True))
        fresh = dict.fromkeys(k for k in keys if k not in self.at)
        if fresh and len(self.at) + len(fresh) > self.most:
            self.at, self.lessons = {}, None
            fresh = dict.fromkeys(keys)
        if fresh or self.lessons is None:
            import pyarrow as pa

            first = {k: n for n, k in reversed(list(enumerate(keys)))}
            some = pa.array([first[k] for k in fresh], pa.int64())
            made = Lessons(graph, *[c.take(some) for c in columns], self.digits)
            if self.lessons is None:
                self.lessons = made
            else:
                self.lessons.add(made)
            self.at |= {k: n for n, k in enumerate(fresh, len(self.at))}
        return self.lessons.rows(np.fromiter((self.at[k] for k in keys), np.int64, len(keys)), texts)


def delta_columns(columns: list[np.ndarray]) -> list:
    import pyarrow as pa

    return [pa.array(c, from_pandas=True) for c in columns]  # NaN is null


def draw_text(keys: list[str]) -> Column:
    """What draws.uniform("grow", keys, ...) begins with."""
    return F.concat_ws(":", F.lit("grow"), *[F.col(k).cast("string") for k in keys])


def most_taught(graph: TickGraph) -> int:
    return max(1, CELLS // max(1, graph.size, graph.inputs, graph.p.num_cells))


def deltas(graph: TickGraph, df: DataFrame, keys: list[str], before: str, winners: str, cols: str, digits: int | None = None) -> DataFrame:
    """ticks.deltas() in one pass."""
    taught = Taught(most_taught(graph), digits)

    def work(graph: TickGraph, columns):
        row, made = taught.rows(graph, columns[0].to_pylist(), columns[1:])
        return row, delta_columns(made)

    return graph.run(df, keys, [draw_text(keys), *[F.col(c) for c in (before, winners, cols)]], DELTA.fields, work, CELLS // 8)  # a record has many deltas


def learned(graph: TickGraph, df: DataFrame, keys: list[str], before: str, winners: str, cols: str, name: str = "deltas", drawn_by: list[str] | None = None) -> DataFrame:
    """(keys, name): what ticks.deltas() says of each record, as an array of structs. Draws are by the keys drawn_by, all if not given."""
    taught = Taught(most_taught(graph))

    def work(graph: TickGraph, columns):
        import pyarrow as pa

        row, made = taught.rows(graph, columns[0].to_pylist(), columns[1:])
        order = np.argsort(row, kind="stable")
        structs = pa.StructArray.from_arrays(delta_columns([c[order] for c in made]), DELTA.fieldNames())
        return None, [pa.ListArray.from_arrays(pa.array(begins(np.bincount(row, minlength=len(columns[0]))).astype(np.int32)), structs)]

    return graph.run(df, keys, [draw_text(drawn_by or keys), *[F.col(c) for c in (before, winners, cols)]], [T.StructField(name, T.ArrayType(DELTA))], work, CELLS // 8)  # a record has many deltas
