"""Long series in slices, nearest patterns, and joins by ranges, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import anomaly, metrics, nearest, ranges, slices, windows


def series_rows(n=400, seed=3):
    """One long series, several short ones, and one without a name; many equal times."""
    draw = random.Random(seed)
    names = ["long"] * n + ["a"] * 7 + ["b"] + [None] * 30
    return [(s, draw.randrange(40), k, draw.uniform(-1, 1)) for k, s in enumerate(names)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "series string, t long, id long, value double").repartition(5)


def by_series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


# ---- slices

def test_slices_are_even_and_ordered(spark):
    got = slices.sliced(frame(spark, series_rows(4000)), ["series"], ["t", "id"], 16).collect()
    sizes = {}
    for r in got:
        sizes[r.slice_] = sizes.get(r.slice_, 0) + 1
    assert len(sizes) == 16 and max(sizes.values()) < 2 * len(got) / 16
    order = sorted(got, key=lambda r: (r.series is not None, r.series or "", r.t, r.id))
    assert [r.slice_ for r in order] == sorted(r.slice_ for r in order)


def test_all_events_are_even_slices(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    sizes = [r["count"] for r in slices.sliced(events, [], ["ts", "event_id"], 8).groupBy("slice_").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


@pytest.mark.parametrize("n", [1, 2, 13, 60])
def test_carried(spark, n):
    rows = series_rows(120)
    got = {r.id: r for r in slices.carried(frame(spark, rows), ["series"], ["t", "id"], ["value", "id"], n).collect()}
    for own in by_series(rows).values():
        for k, r in enumerate(own):
            assert got[r[2]].place_ == k
            assert (got[r[2]].before_ is None) if k == 0 else (got[r[2]].before_.v0, got[r[2]].before_.v1) == (own[k - 1][3], own[k - 1][2])


def test_carried_nulls_and_nothing(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, 5.0), ("s", 3, None), ("s", None, 1.0)], "series string, t long, value double")
    got = {r.t: r for r in slices.carried(df, ["series"], ["t"], ["value"], 4).collect()}
    assert [got[t].place_ for t in (None, 1, 2, 3)] == [0, 1, 2, 3]
    assert got[None].before_ is None and got[1].before_.v0 == 1.0 and got[2].before_.v0 is None and got[3].before_.v0 == 5.0
    assert slices.carried(df.limit(0), ["series"], ["t"], ["value"], 4).count() == 0


@pytest.mark.parametrize("n", [1, 9])
def test_slices_give_the_rows_of_windows(spark, n):
    df = frame(spark, series_rows()).withColumn("bits", F.array((F.col("id") % 3).cast("int"), (F.col("id") % 5 + 3).cast("int")))

    def same(a, b):
        key = lambda r: [str(type(v)) + (f"{v:.9f}" if isinstance(v, float) else str(v)) for v in r]
        assert a.columns == b.columns and sorted(map(key, a.collect())) == sorted(map(key, b.collect()))

    rule = anomaly.Likelihood(20, 15, 10)
    cols = ["id", "likelihood"]
    same(slices.likelihood(df, "value", ["series"], ["t", "id"], rule, slices=n).select(cols), rule.add(df, "value", ["series"], ["t", "id"]).select(cols))
    short = anomaly.Likelihood(1, 7, 2)
    same(slices.likelihood(df, "value", ["series"], ["t", "id"], short, slices=n).select(cols), short.add(df, "value", ["series"], ["t", "id"]).select(cols))
    same(slices.summary(df, "bits", 50, ["series"], ["t", "id"], n), metrics.summary(df, "bits", 50, ["series"], ["t", "id"]))
    same(slices.count_windows(df, ["series"], ["t", "id"], "value", 8, n), windows.count_windows(df, ["series"], ["t", "id"], "value", 8))
    d = {r.id: r.delta for r in slices.delta(df, "value", ["series"], ["t", "id"], slices=n).collect()}
    for own in by_series(series_rows()).values():
        assert [d[r[2]] for r in own] == [0.0] + [b[3] - a[3] for a, b in zip(own, own[1:])]


@pytest.mark.parametrize("n", [1, 11])
def test_sessions(spark, n):
    rows = series_rows()
    starts = (F.col("t") - F.col("before_.v0") > 0) & (F.col("t") % 4 == 0)
    got = {r.id: r.session for r in slices.sessions(frame(spark, rows), ["series"], ["t", "id"], starts, ["t"], slices=n).collect()}
    for own in by_series(rows).values():
        now = 0
        for k, r in enumerate(own):
            now += k == 0 or (r[1] > own[k - 1][1] and r[1] % 4 == 0)
            assert got[r[2]] == now


@pytest.mark.parametrize("least", [100, 1000])
def test_only_long_series_are_cut(spark, monkeypatch, least):
    monkeypatch.setattr(slices, "WHOLE_ROWS", least)
    rows, keys, cut = series_rows(), (["series"], ["t", "id"]), []
    plain = slices._cut
    monkeypatch.setattr(slices, "_cut", lambda df, *rest: cut.append({r.series for r in df.select("series").distinct().collect()}) or plain(df, *rest))
    df = frame(spark, rows)
    starts = (F.col("t") - F.col("before_.v0") > 0) & (F.col("t") % 4 == 0)
    session = {r.id: r.session for r in slices.sessions(df, *keys, starts, ["t"]).collect()}
    delta = {r.id: r.delta for r in slices.delta(df, "value", *keys).collect()}
    rule = anomaly.Likelihood(20, 15, 10)
    got = {r.id: r.likelihood for r in slices.likelihood(df, "value", *keys, rule).collect()}
    want = {r.id: r.likelihood for r in rule.add(df, "value", *keys).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(session) == len(delta) == len(rows)
    for own in by_series(rows).values():
        now = 0
        for k, r in enumerate(own):
            now += k == 0 or (r[1] > own[k - 1][1] and r[1] % 4 == 0)
            assert session[r[2]] == now and delta[r[2]] == (r[3] - own[k - 1][3] if k else 0.0)
    assert cut == ([{"long"}] * 3 if least == 100 else [])


@pytest.mark.parametrize("name", ["session_delta", "session_likelihood"])
def test_session_queries_make_sessions_once(spark, sf, name):
    """Sessions are read, not made again, and short ones need neither carries nor joins."""
    from quillon.plans import catalog

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "Join" not in plan


def test_summaries_merge(spark):
    """Days, merged in two ways, give the metrics of all rows."""
    df = frame(spark, series_rows(200)).withColumn("bits", F.when(F.col("id") % 9 != 0, F.array((F.col("id") % 3).cast("int"), (F.col("id") % 5 + 3).cast("int"))).otherwise(F.array().cast("array<int>")))
    order = ["t", "id"]
    got = {r.series: r for r in metrics.merged(metrics.partial(df, "bits", 50, ["series"], order, F.floor(F.col("t") / 10)), 50, ["series"]).collect()}
    usage = {r.series: r for r in metrics.usage(df, "bits", 50, ["series"]).collect()}
    want = metrics.summary(df, "bits", 50, ["series"], order).collect()
    assert len(got) == len(want)
    for r in want:
        for c in want[0].asDict():
            assert got[r.series][c] == (pytest.approx(r[c], abs=1e-9) if isinstance(r[c], float) else r[c])
        for c in ("entropy", "dead_bits", "dead_ratio"):
            assert got[r.series][c] == (pytest.approx(usage[r.series][c], abs=1e-9) if r.series in usage else None)


# ---- nearest patterns

def nearest_brute(rows, patterns, gain):
    return {k: max((gain(v, p) for p in patterns), default=None) for k, v in rows}


@pytest.mark.parametrize("block, rows_each, cells", [(4096, 1024, 1024), (16, 20, 1024), (16, 20, 2)])
def test_nearest_overlap(spark, monkeypatch, block, rows_each, cells):
    """Sets of different sizes, empty ones, equal ones, and bits that no pattern has; nulls take no part."""
    for name, v in (("BLOCK", block), ("ROWS", rows_each), ("CELLS", cells)):
        monkeypatch.setattr(nearest, name, v)
    draw = random.Random(block)
    one = lambda top: sorted(draw.sample(range(top), draw.choice([0, 1, 3, 10, 12])))
    patterns, rows = [one(60) for _ in range(150)] + [[1, 2, 3]] * 40, [(k, one(90)) for k in range(200)] + [(500 + k, [1, 2, 3]) for k in range(60)]
    r = spark.createDataFrame(rows + [(999, None)], "k long, v array<int>")
    p = spark.createDataFrame([(x,) for x in [*patterns, None]], "v array<int>")
    got = {x.k: x.best for x in nearest.nearest(r, p, ["k"], "v", "overlap").collect()}
    assert got == nearest_brute(rows, patterns, lambda a, b: len(set(a) & set(b)))


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_distance(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    draw = np.random.default_rng(block)
    patterns = [*draw.normal(0, [1, 100, 1e6], (140, 3)).tolist(), [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    rows = list(enumerate([*draw.normal(0, [2, 100, 1e6], (160, 3)).tolist(), *patterns[:20]]))
    r = spark.createDataFrame([*rows, (900, [math.nan, 1.0, 1.0]), (901, [None, 1.0, 1.0]), (902, None)], "k long, v array<double>")
    p = spark.createDataFrame([(x,) for x in [*patterns, [math.nan] * 3, None]], "v array<double>")
    got = {x.k: x.best for x in nearest.nearest(r, p, ["k"], "v", "distance").collect()}
    want = nearest_brute(rows, patterns, lambda a, b: -sum(abs(x - y) for x, y in zip(a, b)))
    assert set(got) == set(want) and all(abs(got[k] + want[k]) <= 1e-9 * (1 + abs(want[k])) for k in got)
    assert nearest.nearest(r, p.limit(0), ["k"], "v", "distance").count() == 0


def test_nearest_compares_few(spark, sf):
    """The counter of comparisons, on the windows of the events."""
    from quillon.plans import catalog

    w = catalog.scored_windows(spark, sf.replace("sf0.001", "sf0.1"))
    features = F.array(*[F.col(f"f.{k}").cast("double") * x for k, x in windows.WEIGHTS.items()])
    base = w.where("win = 0")
    pairs = w.count() * base.count()
    for name, value in (("overlap", F.col("bits")), ("distance", features)):
        found = nearest.nearest(w.select("user_id", "win", value.alias("v")), base.select(value.alias("v")), ["user_id", "win"], "v", name)
        assert found.agg(F.sum("compared")).first()[0] < 0.05 * pairs


def test_nearest_searches_equal_patterns_once(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    patterns, rows = [[1, 2, 3], [4, 5, 6], [7, 8]] * 60, [(k, [k % 9, 20 + k % 4]) for k in range(50)]
    r, p = spark.createDataFrame(rows, "k long, v array<int>"), spark.createDataFrame([(x,) for x in patterns], "v array<int>")
    found = nearest.nearest(r, p, ["k"], "v", "overlap").collect()
    assert {x.k: x.best for x in found} == nearest_brute(rows, patterns, lambda a, b: len(set(a) & set(b)))
    assert max(x.compared for x in found) <= 3


def test_hybrid_score_makes_its_windows_once(spark, sf):
    """Searches and statistics read the windows; none makes them again."""
    from quillon.plans import catalog

    plan = catalog.hybrid_score(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "Window" not in plan


# ---- joins by ranges

def test_dyadic_nodes(spark):
    spans = [(a, b) for a in range(-9, 20) for b in range(a - 1, 24)]
    df = spark.createDataFrame(spans, "low long, high long").select("low", "high", ranges.dyadic_nodes(F.col("low"), F.col("high"), 6).alias("n"))
    for r in df.collect():
        held = [v for n in r.n for v in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(held) == list(range(r.low, r.high + 1)) and len(r.n) <= 12


def test_overlaps(spark):
    draw = random.Random(8)
    rows = [(k, draw.choice("xy"), a, a + draw.choice([-1, 0, 0, 1, 5, 40])) for k, a in enumerate(draw.choices(range(-50, 60), k=150))] + [(500, "x", None, 4), (501, None, 1, 2), (502, "z", 1, 1)]
    got = {r.id: (r.overlapping, r.greatest) for r in ranges.overlaps(spark.createDataFrame(rows, "id long, g string, low long, high long"), ["g"], "low", "high", ["id"]).collect()}
    for k, g, a, b in rows:
        near = [min(b, d) - max(a, c) + 1 for j, h, c, d in rows if j != k and g is not None and h == g and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b]
        assert got[k] == (len(near), max(near, default=None))


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ranges, "CELL_ROWS", 10)
    draw = random.Random(9)
    rows = [(k, draw.gauss(0, 4), draw.choice([0.0, 1.0, draw.uniform(-9, 9)])) for k in range(300)] + [(900, None, 1.0), (901, math.nan, 1.0), (902, math.inf, 1.0)]
    got = {r.id: r.neighbours for r in ranges.neighbours(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 1.5).collect()}
    assert len(got) == len(rows)
    for k, x, y in rows:
        want = sum(j != k and v is not None and x is not None and (x - v) * (x - v) + (y - w) * (y - w) <= 2.25 for j, v, w in rows)
        assert got[k] == want


@pytest.mark.parametrize("strip, cell", [(40, 1000), (15, 30)])
def test_neighbours_in_strips_and_tiles(spark, monkeypatch, strip, cell):
    """Crowded points are sent to a few tiles each, not to as many tasks as their cell has neighbours."""
    monkeypatch.setattr(ranges, "STRIP_ROWS", strip)
    monkeypatch.setattr(ranges, "CELL_ROWS", cell)
    draw = random.Random(10)
    rows = [(k, draw.choice([0.0, 3.0, draw.gauss(0, 9)]), float(draw.choice([draw.randrange(40), draw.uniform(0, 4)]))) for k in range(300)]
    got = {r.id: r.neighbours for r in ranges.neighbours(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 1.5).collect()}
    assert got == {k: sum(j != k and (x - v) * (x - v) + (y - w) * (y - w) <= 2.25 for j, v, w in rows) for k, x, y in rows}


@pytest.mark.parametrize("group_rows", [3, 1000])
def test_overlaps_send_a_row_once(spark, group_rows):
    """Groups of a task are swept, without a row for each bucket or pair; larger ones are spelled out and give the same."""
    draw = random.Random(11)
    rows = [(k, draw.choice("aabcdefghi"), draw.randrange(3), a, a + draw.choice([-1, 0, 1, 5, 40])) for k, a in enumerate(draw.choices(range(-50, 60), k=200))] + [(k, None, 1, 0, 9) for k in (700, 701)]
    df = spark.createDataFrame(rows, "id long, g string, h int, low long, high long")
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    out = ranges.overlaps(df, ["g", "h"], "low", "high", ["id"], group_rows=group_rows)
    got = {r.id: (r.overlapping, r.greatest) for r in out.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    assert len(got) == len(rows)
    for k, g, h, a, b in rows:
        near = [min(b, d) - max(a, c) + 1 for j, i, m, c, d in rows if j != k and g is not None and (i, m) == (g, h) and a <= b and c <= d and a <= d and c <= b]
        assert got[k] == (len(near), max(near, default=None))
    assert ("Generate" in out._jdf.queryExecution().optimizedPlan().toString()) == (group_rows == 3)
