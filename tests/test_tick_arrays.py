"""Ticks in one pass against ticks by joins, and what their plans move."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import draws
from quillon.operators import connections, tick_arrays, ticks
from quillon.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, sf):
    records, segments, synapses = catalog.learning_ticks(spark, sf)
    odd = spark.createDataFrame([(-1, None, [1], []), (-2, [3, 3, 9, 16], [], [4]), (-3, [], [2, 2, 63], [300, 2]), (-4, [250], None, None)], "event_id long, before array<int>, cols array<int>, winners array<int>")
    return records.limit(12).unionByName(odd), segments, synapses


def forms(tables, p):
    keys = ["event_id"]
    taught = ticks.learned(*tables, keys, p)
    return {
        "compute": ticks.compute(*tables, keys, p),
        "changes": ticks.changes(*tables, keys, p),
        "deltas": ticks.deltas(*tables, keys, p),
        "next": ticks.segment_activity(taught, *tables[1:], keys, p, deltas="deltas"),
    }


@pytest.mark.parametrize("more", [{"reinforce_on": "active"}, {"predicted_decrement": 0.0, "max_synapses": 25, "max_new": 30}])
def test_arrays_and_joins_agree(tables, monkeypatch, more):
    p = replace(catalog.LEARNING_TICK, **more)
    rows = {k: sorted(map(repr, d.select(*sorted(d.columns)).collect())) for k, d in forms(tables, p).items()}
    monkeypatch.setattr(connections, "BROADCAST_SYNAPSES", 10)
    for k, d in forms(tables, p).items():
        assert rows[k] and rows[k] == sorted(map(repr, d.select(*sorted(d.columns)).collect())), k


@pytest.mark.parametrize("name", ["tm_changes", "tm_deltas", "tm_next_tick", "tm_tick"])
def test_no_joins_of_records(spark, sf, name):
    """The sides of those joins are larger than the records' file by far, so that broadcasts filled the driver."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_larger_graphs_merge(tables, monkeypatch):
    monkeypatch.setattr(connections, "BROADCAST_SYNAPSES", 10)
    plan = ticks.changes(*tables, ["event_id"], catalog.LEARNING_TICK)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3


def test_equal_records_are_learned_once(tables, monkeypatch):
    """A task learns what its records share once, in any of its runs; only the draws are each record's own."""
    records, segments, synapses = tables
    graph, met, init = tick_arrays.TickGraph.gather(segments, synapses, catalog.LEARNING_TICK), [], tick_arrays.Lessons.__init__

    def counted(self, graph, before, *more):
        met.append(len(before))
        init(self, graph, before, *more)

    monkeypatch.setattr(tick_arrays.Lessons, "__init__", counted)
    some = records.select("before", "winners", "cols").toArrow().combine_chunks()
    columns = [some.column(k).chunk(0) for k in range(3)]
    taught, n, got = tick_arrays.Taught(100), len(some), []
    for run in range(3):
        row, made = taught.rows(graph, [f"grow:{run}-{k}" for k in range(n)], columns)
        sure = ~np.isnan(made[3])
        got.append(([c[sure].tolist() for c in made[:3]], np.bincount(row, minlength=n).tolist(), made[2].tolist()))
    assert sum(met) == len(set(map(repr, zip(*[c.to_pylist() for c in columns], strict=True)))) <= n
    assert got[0][:2] == got[1][:2] == got[2][:2] and got[0][2] != got[1][2] != got[2][2]


def test_many_kinds_of_records_are_forgotten(tables, monkeypatch):
    """A task that starts its lessons again and again gives the same rows, as do joins; digits are the same in both."""
    records, segments, synapses = tables
    many = records.crossJoin(records.sparkSession.range(30)).coalesce(1).select(F.concat_ws("-", "event_id", F.expr("repeat('9', cast(id as int) * 2)")).alias("event_id"), "before", "cols", "winners")
    form = lambda: sorted(map(repr, ticks.deltas(many, segments, synapses, ["event_id"], catalog.LEARNING_TICK, digits=1).collect()))
    got = form()
    monkeypatch.setattr(tick_arrays, "most_taught", lambda graph: 3)
    assert got and got == form()
    monkeypatch.setattr(connections, "BROADCAST_SYNAPSES", 10)
    assert got == form()


def test_draws_of_arrays(spark):
    """The same as draws.uniform(), for one block of MD5 and for longer texts."""
    keys = ["", "7", "é" * 9, *["x" * n for n in range(30, 60)], "y" * 200]
    rows = [(k, s, b) for k in keys for s, b in ((0, 5), (160, 7), (123456789, 255))]
    df = spark.createDataFrame(rows, "k string, s int, b int")
    theirs = [r.u for r in df.select(draws.uniform("grow", "k", "s", "b").alias("u")).collect()]
    heads, ends = [f"grow:{k}" for k, _, _ in rows], draws.tails(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    at = np.arange(len(rows))[::-1]
    mine = (draws.upper(heads, at, ends, at) + 0.5) / 2.0**32
    assert mine[::-1].tolist() == theirs


def test_rounded_as_spark_does(spark):
    values = [0.1 + 0.2, 1.0000005, 2.5e-7, 5e-7, -5e-7, -1e-9, 0.1234565, 0.1234575, 1 / 3, 123456.7890125, 1e22, float("nan")]
    theirs = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(catalog.r6(F.col("v")).alias("v")).collect()]
    assert list(map(repr, tick_arrays.rounded(np.array(values), 6).tolist())) == list(map(repr, theirs))
