"""Small exact expectations of the operators."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.errors import DimensionMismatch, InvalidDimensions, SdrError
from quillon.functions import kernels, sdr, sql
from quillon.operators import anomaly, blocked, classifier, connections, encoders, metrics, nearest, ranges, slices, spatial_pooler, temporal_memory, ticks, topology, windows
from quillon.operators.encoders import finance, probability, signal, spatial, text, vision
from quillon.sources import model_io


def value(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def bits(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def test_algebra(spark):
    a, b = bits(1, 2, 3, 4, 5), bits(3, 4, 5, 6, 7)
    v = value(spark, sdr.overlap(a, b), sdr.union(a, b), sdr.intersection(a, b), sdr.difference(a, b), sdr.concatenate((a, 100), (b, 100)), sdr.sparsity(a, 100), sdr.zero(), sdr.show(bits(1, 4), sdr.Shape((2, 3))))
    assert list(v) == [3, [1, 2, 3, 4, 5, 6, 7], [3, 4, 5], [1, 2], [1, 2, 3, 4, 5, 103, 104, 105, 106, 107], 0.05, [], "SDR( 2, 3 ) 1, 4"]


def test_random_algebra(spark):
    draw = random.Random(3)
    rows = [(k, sorted(draw.sample(range(50), draw.randint(0, 20))), sorted(draw.sample(range(50), draw.randint(0, 20)))) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", sdr.union(a, b).alias("u"), sdr.intersection(a, b).alias("i"), sdr.from_dense(sdr.to_dense(a, 50)).alias("d")).collect():
        assert r.u == sorted(set(r.a) | set(r.b)) and r.i == sorted(set(r.a) & set(r.b)) and r.d == r.a


def test_shapes(spark):
    s = sdr.Shape((2, 3, 4))
    v = value(spark, s.coordinates(bits(13)), s.from_coordinates(s.coordinates(bits(3, 13))), s.at(bits(13), F.lit(1), F.lit(0), F.lit(1)))
    assert list(v) == [[[1], [0], [1]], [3, 13], True]
    with pytest.raises(InvalidDimensions):
        sdr.Shape((2, 0))
    with pytest.raises(DimensionMismatch):
        s.reshape(5, 5)


def test_checked_bits(spark):
    assert value(spark, sdr.checked(bits(1, 5), 10))[0] == [1, 5]
    with pytest.raises(Exception, match="ascending"):
        value(spark, sdr.checked(bits(5, 1), 10))


def test_noise_keeps_the_sum(spark):
    r = sdr.randomize(F.col("id"), 200, 0.1, 1)
    for x in spark.range(20).select(r.alias("a"), sdr.add_noise(r, F.col("id"), 200, 0.5, 2).alias("b")).collect():
        assert len(set(x.a)) == 20 == len(set(x.b)) and len(set(x.a) & set(x.b)) == 10


def test_murmur_seeds(spark):
    def reference(x, seed):
        k = (x & 0xFFFFFFFF) * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
        h = seed ^ k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    for seed in (0, 1, 42, 99, 123456789, 0xFFFFFFFF):
        rows = spark.range(-3, 5).select("id", kernels.murmur3(F.col("id"), seed).alias("h")).collect()
        assert [r.h for r in rows] == [reference(r.id, seed) for r in rows]


def test_periodic_scalar(spark):
    e = encoders.ScalarEncoder(0.0, 360.0, 360, 21, periodic=True)
    v = value(spark, e.encode(F.lit(0.0)), e.encode(F.lit(360.0)), sdr.overlap(e.encode(F.lit(355.0)), e.encode(F.lit(5.0))))
    assert v[0] == v[1] and v[2] == 11


def test_encoder_sizes(spark):
    e = encoders
    for kind, n in [(e.HrvEncoder, 160), (e.EcgEncoder, 560), (e.MacAddressEncoder, 256), (e.PitchEncoder, 192), (e.ColorEncoder, 220), (e.PriceEncoder, 150), (e.OrderBookEncoder, 260), (e.IpAddressEncoder, 128)]:
        assert kind().size == n
    assert len(value(spark, e.PriceEncoder().encode(F.lit(50.0)))[0]) == 21
    assert len(value(spark, e.PriceEncoder().encode(F.lit(50.0), F.lit(2.0)))[0]) == 31
    assert len(value(spark, e.IpAddressEncoder(ipv6=True).encode(F.lit("2001:db8::1")))[0]) == 64


def test_encoder_errors(spark):
    e = encoders
    for make in (lambda: e.ScalarEncoder(5, 1), lambda: e.LogEncoder(0), lambda: e.CategoryEncoder(["a", "a"]), lambda: e.RandomDistributedScalarEncoder(100), lambda: e.DateEncoder(), lambda: e.GridCellEncoder(cells_per_module=15), lambda: e.MultiEncoder([])):
        with pytest.raises(SdrError):
            make()
    with pytest.raises(Exception, match="unknown category"):
        value(spark, e.CategoryEncoder(["a"]).encode(F.lit("b")))
    assert value(spark, e.CategoryEncoder(["a"], strict=False).encode(F.lit("b")))[0] is None


@pytest.mark.parametrize(
    ("encoder", "kind"),
    [
        (encoders.ScalarEncoder(), "double"), (encoders.LogEncoder(), "double"), (encoders.BooleanEncoder(), "boolean"),
        (encoders.OrdinalEncoder(), "string"), (encoders.NGramEncoder(), "string"), (encoders.SimHashDocumentEncoder(), "string"),
        (encoders.IpAddressEncoder(), "string"), (encoders.MacAddressEncoder(), "string"), (encoders.HierarchicalCategoryEncoder(), "string"),
        (encoders.DateEncoder(season_width=5), "timestamp"), (encoders.RandomDistributedScalarEncoder(400, 21, resolution=1.0), "double"), (encoders.CharacterEncoder(), "string"),
    ],
)
def test_null_gives_null(spark, encoder, kind):
    assert value(spark, encoder.encode(F.lit(None).cast(kind)))[0] is None


def test_similar_values_overlap(spark):
    e = encoders.RandomDistributedScalarEncoder(2048, 40, resolution=1.0)
    near, far = value(spark, sdr.overlap(e.encode(F.lit(10.0)), e.encode(F.lit(12.0))), sdr.overlap(e.encode(F.lit(10.0)), e.encode(F.lit(500.0))))
    assert near > 30 and far < 8
    s = encoders.SimHashDocumentEncoder(400, 21)
    near, far = value(spark, sdr.overlap(s.encode(F.lit("the quick brown fox jumps over it")), s.encode(F.lit("the quick brown fox jumps over them"))), sdr.overlap(s.encode(F.lit("the quick brown fox jumps over it")), s.encode(F.lit("entirely other words stand here now"))))
    assert near > far


def test_hash_encoders_by_hand(spark):
    def fnv(data, h=0xCBF29CE484222325):
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    def pick(state, n, size):
        out = []
        while len(out) < n:
            state = (state * 6364136223846793005 + 1) % 2**64
            if state % size not in out:
                out.append(state % size)
        return out

    assert value(spark, encoders.SetEncoder().encode(F.array(F.lit("x"), F.lit("y"))))[0] == sorted(set(pick(fnv(b"x"), 5, 2048) + pick(fnv(b"y"), 5, 2048)))
    h, want = fnv(b"abc"), []
    for i in range(3):
        h = (h * 0x100000001B3 + i) % 2**64
        want.append(h % 2048)
    assert value(spark, encoders.NGramEncoder().encode(F.lit("abc")))[0] == sorted(set(want))
    assert value(spark, encoders.NGramEncoder().encode(F.lit("ab")))[0] == []
    level = fnv(b"a", (0xCBF29CE484222325 ^ 0) * 0x100000001B3 % 2**64)
    assert value(spark, encoders.HierarchicalCategoryEncoder().encode(F.lit("a")))[0] == sorted(pick(level, 10, 50))
    state, seen = 0xCBF29CE484222325, []
    for index in range(100):
        state = (0xCBF29CE484222325 ^ index) * 0x100000001B3 % 2**64
        for c in (3, -4):
            state = (state ^ c % 2**64) * 0x100000001B3 % 2**64
        if state % 1000 not in seen:
            seen.append(state % 1000)
        if len(seen) == 21:
            break
    assert value(spark, encoders.CoordinateEncoder().encode(F.lit(3.2), F.lit(-4.1)))[0] == sorted(seen)


def test_embeddings(spark):
    v = np.random.default_rng(0).normal(size=64)
    for e in (text.WordEmbeddingEncoder(64), text.PatchEncoder(), text.GraphNodeEncoder()):
        assert len(value(spark, e.encode(F.array(*[F.lit(float(x)) for x in v])))[0]) == 41
    for strategy in ("full", "strided", "chunked"):
        e = text.LlmEmbeddingEncoder(strategy=strategy, stride=2, magnitude_bits=64)
        out = value(spark, e.encode(F.array(*[F.lit(float(x)) for x in v])))[0]
        assert out == sorted(set(out)) and len(out) <= 41


def test_pitch_and_color(spark):
    f = signal.frequency_of_note
    v = value(spark, signal.midi(F.lit(440.0)), signal.midi(f(F.lit("C#5"))), signal.midi(f(F.lit("Bb3"))), f(F.lit("H2")))
    assert [round(x, 6) for x in v[:3]] == [69, 73, 58] and v[3] is None
    h = vision.hsv(F.lit(0.2), F.lit(0.6), F.lit(0.4))
    assert [round(x, 9) for x in value(spark, *vision.rgb(*h))] == [0.2, 0.6, 0.4]


def test_signals(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    m = value(spark, signal.hrv_metrics(arr(800, 900, 820)))[0]
    assert math.isclose(m.mean_rr, 840) and math.isclose(m.pnn50, 100) and math.isclose(m.sdnn, np.std([800, 900, 820], ddof=1))
    assert len(value(spark, encoders.SpectrogramEncoder(4, log_scale=False, minimum=0.01).encode(arr(0.5, 0, 1, 0.25)))[0]) == 15
    assert len(value(spark, encoders.WaveformEncoder(4).encode(arr(0, 1, -1, 0.5)))[0]) == 16
    d = value(spark, probability.entropy(arr(0.25, 0.25, 0.25, 0.25)), probability.mode(arr(0.1, 0.45, 0.45)), probability.mean(arr(0, 0, 1)))
    assert math.isclose(d[0], math.log(4)) and list(d[1:]) == [2, 2.0]


def test_places_and_pairs(spark):
    v = value(spark, spatial.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), *finance.parse_pair(F.lit("eurusd")), finance.inverse_pair(F.lit("EUR/USD")), probability.interval_overlap(F.lit(0), F.lit(5), F.lit(3), F.lit(9)))
    assert abs(v[0] - math.pi / 2 * 6_371_000) < 1 and list(v[1:4]) == ["EUR", "USD", "USD/EUR"] and v[4] == 2


def test_dates(spark):
    e = encoders.DateEncoder(season_width=5, day_of_week_width=2, weekend_width=2, time_of_day_width=4)
    v = value(spark, *[F.size(e.encode(F.lit(x).cast("timestamp"))) for x in ("2020-01-01 00:00:00", "2020-01-03 20:00:00")], e.values(F.lit("2020-01-03 20:00:00").cast("timestamp"))["weekend"], e.values(F.lit("2020-01-03 10:00:00").cast("timestamp"))["weekend"])
    assert list(v) == [13, 13, 1.0, 0.0]
    h = encoders.DateEncoder(holiday_width=2).holiday
    assert list(value(spark, *[h(F.lit(x).cast("timestamp")) for x in ("2021-12-25 05:00:00", "2021-12-24 12:00:00", "2021-12-26 12:00:00", "2021-07-01 00:00:00")])) == [1.0, 0.5, 1.5, 0.0]


def test_topology(spark):
    n = lambda c, **k: value(spark, topology.neighborhood(F.lit(c), (10,), 2, **k))[0]
    assert n(5) == [3, 4, 5, 6, 7] and n(0) == [0, 1, 2] and n(0, wrap=True) == [0, 1, 2, 8, 9]
    assert value(spark, topology.map_column_to_input(F.lit(4), (5,), (10,)))[0] == 9


def test_connections(spark):
    syn = spark.createDataFrame([(10, 50, 0.6), (10, 51, 0.4), (10, 52, 0.6)], "segment int, presyn int, perm double")
    df = spark.createDataFrame([(1, [50, 51])], "id int, bits array<int>")
    r = connections.activity(df, syn, ["id"], "bits", 0.5).first()
    assert (r.connected, r.potential) == (1, 2)
    new = connections.create_synapses(syn, spark.createDataFrame([(10, 51, 0.9), (10, 50, 0.1)], syn.schema))
    assert {x.presyn: x.perm for x in new.collect()} == {50: 0.6, 51: 0.9, 52: 0.6}
    adapted = connections.adapt(syn, spark.createDataFrame([(50,)], "presyn int"), spark.createDataFrame([(10,)], "segment int"), 0.1, 0.1)
    assert {x.presyn: round(x.perm, 6) for x in adapted.collect()} == {50: 0.7, 51: 0.3, 52: 0.5}
    assert {x.presyn for x in connections.destroy_weakest(syn, 1).collect()} == {50, 52}
    assert {x.presyn: x.perm for x in connections.raise_to_threshold(syn, 0.5, 3).collect()}[51] == 0.5
    wanted = spark.createDataFrame([(10, p, 2) for p in range(60, 70)], "segment int, presyn int, n int")
    assert connections.grow(syn, wanted, 0.21).count() == 5
    segs = spark.createDataFrame([(10, 1), (11, 1)], "segment int, cell int")
    assert [r.segment for r in connections.make_room(segs, syn, 2).collect()] == [11]


def test_pooler(spark):
    p = spatial_pooler.PoolerParams(inputs=(100,), columns=(200,), potential_radius=100)
    a, b = spatial_pooler.Pooler(p), spatial_pooler.Pooler(p)
    x = np.array([1, 5, 10, 20, 30])
    for _ in range(30):
        a.compute(x, True)
    first, overlap = a.compute(x, False)
    assert len(first) == p.winners == 10 and overlap.max() == 5 and (b.compute(x, False)[1].max() <= overlap.max())
    segment, presyn, perm = b.synapses()
    syn = spark.createDataFrame(list(zip(segment.tolist(), presyn.tolist(), perm.tolist(), strict=True)), "segment int, presyn int, perm double")
    e = spark.createDataFrame([(1, x.tolist()), (2, [10, 20, 30, 40, 50])], "id int, bits array<int>")
    out = spatial_pooler.inhibit_globally(spatial_pooler.overlaps(e, syn, ["id"], "bits", p), e, ["id"], p)
    for r in out.join(e, "id").collect():
        assert r.active == b.compute(np.array(r.bits), False)[0].tolist()
    assert spatial_pooler.initial_synapses(spark, p).count() > 200
    local = spatial_pooler.Pooler(spatial_pooler.PoolerParams(inputs=(100,), columns=(64,), potential_radius=30, global_inhibition=False))
    for _ in range(55):
        local.compute(x, True)


def test_memory_bursts_and_learns():
    m = temporal_memory.Memory(temporal_memory.MemoryParams(columns=(10,), cells_per_column=4))
    assert len(m.compute(np.array([0, 1, 2]))["active_cells"]) == 12
    p = temporal_memory.MemoryParams(columns=(100,), cells_per_column=4, activation=3, min_threshold=2, initial=0.5)
    m, steps = temporal_memory.Memory(p), [np.arange(k, k + 5) for k in (0, 20, 40, 60)]
    for _ in range(10):
        m.reset()
        scores = [m.compute(s)["anomaly"] for s in steps]
    assert scores == [1.0, 0.0, 0.0, 0.0]
    assert set(m.predicted() // 4) <= set(range(100))


def test_memory_by_series(spark):
    rows = [(s, k, list(range(k % 4 * 20, k % 4 * 20 + 5))) for s in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "series string, seq long, cols array<int>")
    out = temporal_memory.run_series(df, temporal_memory.MemoryParams(columns=(100,), cells_per_column=4, activation=3, min_threshold=2, initial=0.5)).collect()
    late = [r.anomaly for r in out if r.seq > 30]
    assert len(out) == 80 and max(late) == 0.0


def spark_hash(*values):
    """Spark's xxhash64 of (width in bytes, number) pairs, as a signed number."""
    h = 42
    for width, v in values:
        h = xxhash.xxh64_intdigest((v % 2 ** (8 * width)).to_bytes(width, "little"), h)
    return (h + 2**63) % 2**64 - 2**63


def test_random_bits_by_hand(spark):
    keys = [3, 8, -5, 10**12]
    df = spark.createDataFrame([(k, [1, 4, 9, 16, 25, 36]) for k in keys], "k long, bits array<int>")
    got = df.select("k", sdr.randomize(F.col("k"), 50, 0.1, 7).alias("r"), sdr.add_noise(F.col("bits"), F.col("k"), 50, 0.5, 7).alias("n")).collect()
    for r in got:
        drawn = lambda pool, n, seed: sorted(pool, key=lambda b: (spark_hash((4, seed), (8, r.k), (4, b)), b))[:n]  # noqa: E731, B023
        assert r.r == sorted(drawn(range(50), 5, 7))
        old = [1, 4, 9, 16, 25, 36]
        assert r.n == sorted([b for b in old if b not in drawn(old, 3, 7)] + drawn([b for b in range(50) if b not in old], 3, 8))


class PlainMemory:
    """A temporal memory by dictionaries and loops, for as many new synapses as there are candidates."""

    def __init__(self, p):
        self.p, self.graph, self.cell, self.next = p, {}, {}, 0
        self.active = self.winners = frozenset()

    def tick(self, columns):
        p, k = self.p, self.p.cells_per_column
        connected = {s: sum(c in self.active and v >= p.connected for c, v in own.items()) for s, own in self.graph.items()}
        potential = {s: sum(c in self.active for c in own) for s, own in self.graph.items()}
        on = sorted(s for s in self.graph if connected[s] >= p.activation)
        matching = sorted(s for s in self.graph if potential[s] >= p.min_threshold)
        predicted = {self.cell[s] for s in on}
        reward, before = self.winners, sorted(self.winners)
        active, winners = set(), set()

        def adapt(s):
            for c in self.graph[s]:
                self.graph[s][c] = min(1.0, max(0.0, self.graph[s][c] + (p.increment if c in reward else -p.decrement)))

        def grow(s, n):
            new = [c for c in before if c not in self.graph[s]]
            assert len(new) <= n or n <= 0
            for c in new if n > 0 else []:
                self.graph[s][c] = p.initial

        for col in sorted(columns):
            cells = range(col * k, col * k + k)
            own = predicted & set(cells)
            if own:
                active |= own
                winners |= own
                for s in on:
                    if self.cell[s] in own:
                        adapt(s)
                continue
            active |= set(cells)
            near = [s for s in matching if self.cell[s] in cells]
            if near:
                best = min(near, key=lambda s: (-potential[s], self.cell[s], s))
                winners.add(self.cell[best])
                adapt(best)
                grow(best, p.max_new - potential[best])
            else:
                cell = min(cells, key=lambda c: (sum(x == c for x in self.cell.values()), c))
                winners.add(cell)
                if before:
                    self.graph[self.next], self.cell[self.next] = {}, cell
                    grow(self.next, p.max_new)
                    self.next += 1
        for s in matching:
            if self.cell[s] // k not in columns:
                for c in self.graph[s]:
                    self.graph[s][c] = max(0.0, self.graph[s][c] - p.predicted_decrement)
        score = 1 - len({c // k for c in predicted} & set(columns)) / len(columns) if columns else 0.0
        self.active, self.winners = frozenset(active), frozenset(winners)
        return sorted(active), sorted(winners), sorted(predicted), score


MEMORY = temporal_memory.MemoryParams(columns=(30,), cells_per_column=3, activation=3, min_threshold=2, initial=0.45, max_new=40, predicted_decrement=0.02)


def column_series(n, seed):
    draw = random.Random(seed)
    steps = [sorted(draw.sample(range(30), 5)) for _ in range(6)]
    return [steps[k % 6] if draw.random() < 0.8 else sorted(draw.sample(range(30), draw.randint(0, 6))) for k in range(n)]


def test_memory_against_plain_loops():
    m, plain = temporal_memory.Memory(MEMORY), PlainMemory(MEMORY)
    for cols in column_series(150, 1):
        tick = m.compute(np.array(cols, np.int64))
        assert (sorted(tick["active_cells"]), sorted(tick["winner_cells"]), tick["predicted_cells"], tick["anomaly"]) == plain.tick(cols)
        assert tick["n_segments"] == len(plain.graph) and tick["n_synapses"] == sum(map(len, plain.graph.values()))
    for s, own in plain.graph.items():
        presyn, perm = m.synapses_of(s)
        assert {c: round(v, 9) for c, v in zip(presyn.tolist(), perm.tolist(), strict=True)} == {c: round(v, 9) for c, v in own.items()}


def test_memory_limits():
    p = temporal_memory.MemoryParams(columns=(20,), cells_per_column=1, max_segments=2, max_synapses=4, max_new=3, activation=1, min_threshold=1, connected=0.2)
    m = temporal_memory.Memory(p)
    for s in range(3):
        m.grow(m.create_segment(5), np.arange(6, 9 + s), 9)
    assert sorted(m.size[: m.used].tolist()) == [4, 4] and m.used == 2  # the smallest went, its id is used again
    m.perm[0, :2] = 0.9
    m.grow(0, np.array([15, 16]), 9)
    assert m.size[0] == 4 and {15, 16} < set(m.synapses_of(0)[0].tolist()) and (m.synapses_of(0)[1] == 0.9).sum() == 2


def test_ticks_against_the_learner(spark):
    """What one tick gives on a learner's graph, as tables."""
    m = temporal_memory.Memory(MEMORY)
    data = column_series(60, 4)
    for cols in data:
        m.compute(np.array(cols, np.int64))
    state = dict(zip([f.split()[0] for f in temporal_memory.STATE.split(", ")], m.export(), strict=True))
    graph = spark.createDataFrame([("s", *m.export())], "series string, " + temporal_memory.STATE)
    segments, synapses = temporal_memory.segments(graph).drop("series"), temporal_memory.synapses(graph).drop("series")
    records = [(k, sorted(random.Random(k).sample(range(90), 15)), data[k]) for k in range(40)]
    df = spark.createDataFrame(records, "id int, before array<int>, cols array<int>")
    got = {r.id: r for r in ticks.compute(df, segments, synapses, ["id"], MEMORY).collect()}
    change = ticks.changes(df, segments, synapses, ["id"], MEMORY).collect()
    for k, before, cols in records:
        one = temporal_memory.Memory(MEMORY, state)
        one.active = np.array(before)
        tick = one.compute(np.array(cols, np.int64), learn=False)
        assert (got[k].active_cells, got[k].winner_cells, got[k].predicted_cells) == (sorted(tick["active_cells"]), sorted(tick["winner_cells"]), tick["predicted_cells"])
        assert abs(got[k].anomaly - tick["anomaly"]) < 1e-12
        _, potential = temporal_memory.Memory(MEMORY, state).activity(np.array(before))
        own = {r.segment: (r.change, r.grow) for r in change if r.id == k}
        assert {s for s, (c, _) in own.items() if c == "punish"} == {s for s in np.flatnonzero(potential >= 2).tolist() if m.cells[s] // 3 not in cols}


@pytest.mark.parametrize("limit", [10**6, 20])
def test_deltas_against_the_learner(spark, limit):
    """What records learn in a tick on one graph, and their next tick on the graph and its deltas, are those of learners with a copy each."""
    p = replace(MEMORY, max_synapses=limit, reinforce_on="winner" if limit > 20 else "active")
    m = temporal_memory.Memory(p)
    data = column_series(60, 4)
    for cols in data:
        m.compute(np.array(cols, np.int64))
    state = dict(zip([f.split()[0] for f in temporal_memory.STATE.split(", ")], m.export(), strict=True))
    graph = spark.createDataFrame([("s", *m.export())], "series string, " + temporal_memory.STATE)
    segments, synapses = temporal_memory.segments(graph).drop("series").cache(), temporal_memory.synapses(graph).drop("series").cache()
    draw = random.Random(2)
    records = []
    for k in range(25):
        before = sorted(draw.sample(range(90), 15))
        records.append((k, before, [] if k == 3 else before[::3], data[k] if k != 4 else [], data[k + 1]))
    df = spark.createDataFrame(records, "id int, before array<int>, winners array<int>, cols array<int>, then array<int>")
    made = ticks.deltas(df, segments, synapses, ["id"], p).cache()
    rows, learners, first = made.collect(), {}, []
    for k, before, winners, cols, then in records:
        one = learners[k] = temporal_memory.Memory(p, state)
        one.active, one.winners = np.array(before, np.int64), np.array(winners, np.int64)
        first.append((k, one.compute(np.array(cols, np.int64))["active_cells"], then))
        graph, cell = {}, {}
        for s in range(m.used):
            graph[s], cell[s] = dict(zip(*(x.tolist() for x in m.synapses_of(s)), strict=True)), int(m.cells[s])
        for r in (r for r in rows if r.id == k):
            assert graph.setdefault(r.segment, {}).get(r.presyn) == r.was and r.perm != r.was and r.new == (r.segment >= m.used)
            graph[r.segment][r.presyn], cell[r.segment] = r.perm, r.cell
        mine = sorted((cell[s], sorted((c, round(v, 9)) for c, v in own.items() if v is not None)) for s, own in graph.items() if cell[s] >= 0)
        theirs = sorted((int(one.cells[s]), sorted((c, round(v, 9)) for c, v in zip(*(x.tolist() for x in one.synapses_of(s)), strict=True))) for s in range(one.used) if one.cells[s] >= 0)
        if limit > 20:
            assert mine == theirs
        else:  # which of many take part is drawn
            assert [(c, len(x)) for c, x in mine] == [(c, len(x)) for c, x in theirs]
    if limit > 20:
        again = spark.createDataFrame(first, "id int, before array<int>, cols array<int>")
        got = {r.id: r for r in ticks.compute(again, segments, synapses, ["id"], p, deltas=made).collect()}
        for k, _, then in first:
            tick = learners[k].compute(np.array(then, np.int64), learn=False)
            assert (got[k].active_cells, got[k].winner_cells, got[k].predicted_cells) == (sorted(tick["active_cells"]), sorted(tick["winner_cells"]), tick["predicted_cells"])


def test_memory_goes_on(spark, tmp_path):
    """Learning in two halves, saved and loaded between them, gives the rows of learning at once."""
    p = temporal_memory.MemoryParams(columns=(30,), cells_per_column=3, activation=3, min_threshold=2, initial=0.45, max_new=4)
    rows = [(s, k, cols, k in (40, 70)) for s in "abc" for k, cols in enumerate(column_series(100, ord(s)))]
    df = spark.createDataFrame(rows, "series string, seq long, cols array<int>, reset boolean")
    at_once = temporal_memory.run_series(df, p).where("seq >= 50").collect()
    for kind in ("parquet", "json"):
        model_io.save({"memory": temporal_memory.train(df.where("seq < 50"), p)}, f"{tmp_path}/{kind}", {"columns": [30]}, kind)
        tables, params = model_io.load(spark, f"{tmp_path}/{kind}")
        assert params == {"columns": [30]}
        assert sorted(temporal_memory.run_series(df.where("seq >= 50"), p, state=tables["memory"]).collect()) == sorted(at_once)
    rest = temporal_memory.train(df.where("seq >= 50"), p, tables["memory"])
    assert sorted(rest.collect()) == sorted(temporal_memory.train(df, p).collect())
    assert temporal_memory.synapses(rest).count() > 0 and temporal_memory.train(df.limit(0), p, tables["memory"]).count() == 3


def plain_pooler(p, synapses, rows):
    """(active, overlaps) by loops over (segment, presyn) -> perm, with global inhibition."""
    perm, n = dict(synapses), p.num_columns
    boost, seen, won, least = [1.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for t, bits in enumerate(rows, 1):
        overlap = [sum(perm.get((c, i), -1) >= p.connected for i in bits) for c in range(n)]
        active = sorted(sorted(range(n), key=lambda c: (-overlap[c] * boost[c], c))[: p.winners])
        yield active, overlap
        for (c, i), v in list(perm.items()):
            if c in active:
                perm[c, i] = min(1.0, max(0.0, v + (p.increment if i in bits else -p.decrement)))
        for c in range(n):
            seen[c] = (seen[c] * (p.period - 1) + (overlap[c] > 0)) / p.period
            won[c] = (won[c] * (p.period - 1) + (c in active)) / p.period
        for (c, i), v in list(perm.items()):
            if seen[c] < least[c]:
                perm[c, i] = min(1.0, v + p.connected / 10)
        boost = [math.exp(p.boost * (p.effective_density - d)) for d in won]
        if t % p.update_every == 0:
            least = [p.min_share_overlap * max(seen)] * n


POOLER = spatial_pooler.PoolerParams(inputs=(60,), columns=(40,), potential_radius=20, boost=3.0, density=0.1, period=20, update_every=7, min_share_overlap=0.9, increment=0.03)


def bit_rows(n, seed):
    draw = random.Random(seed)
    return [sorted(draw.sample(range(60), draw.randint(0, 12))) for _ in range(n)]


def test_pooler_against_plain_loops():
    s = spatial_pooler.Pooler(POOLER)
    first = {(c, i): v for c, i, v in zip(*(x.tolist() for x in s.synapses()), strict=True)}
    for bits, (active, overlap) in zip(bit_rows(60, 2), plain_pooler(POOLER, first, bit_rows(60, 2)), strict=True):
        got = s.compute(np.array(bits, np.int64), True)
        assert (got[0].tolist(), got[1].tolist()) == (active, overlap)


@pytest.mark.parametrize("wrap", [False, True])
def test_local_pooler_by_hand(wrap):
    """Neighbours, inhibition, boost and least duty with local inhibition, by loops over a grid."""
    p = replace(POOLER, inputs=(6, 10), columns=(5, 8), potential_radius=2, global_inhibition=False, wrap=wrap, update_every=4)
    s = spatial_pooler.Pooler(p)
    for bits in bit_rows(12, 5):
        radius = s._radius() if s.iteration % 4 == 0 else radius
        gap = lambda a, b, d: min(abs(a - b), d - abs(a - b)) if wrap else abs(a - b)
        near = {c: [x for x in range(40) if x != c and gap(c // 8, x // 8, 5) <= radius and gap(c % 8, x % 8, 8) <= radius] for c in range(40)}
        boost = s.boost.tolist()
        active, overlap = s.compute(np.array(bits, np.int64), True)
        o = overlap.tolist()
        assert active.tolist() == [c for c in range(40) if o[c] >= 1 and sum(o[x] * boost[x] > o[c] * boost[c] for x in near[c]) < math.ceil((len(near[c]) + 1) * 0.1)]
        for c in range(40):
            target = sum(s.active_duty[x] for x in near[c]) / max(1, len(near[c]))
            assert abs(s.boost[c] - math.exp(3.0 * (target - s.active_duty[c]))) < 1e-12
        if s.iteration % 4 == 0:
            radius = s._radius()
            near = {c: [x for x in range(40) if gap(c // 8, x // 8, 5) <= radius and gap(c % 8, x % 8, 8) <= radius] for c in range(40)}
            assert all(abs(s.min_duty[c] - 0.9 * max(s.overlap_duty[x] for x in near[c])) < 1e-12 for c in range(40))


@pytest.mark.parametrize("local", [False, True])
def test_pooler_goes_on(spark, tmp_path, local):
    p = replace(POOLER, global_inhibition=not local)
    rows = [(s, k, bits) for s in "ab" for k, bits in enumerate(bit_rows(40, ord(s)))]
    df = spark.createDataFrame(rows, "series string, seq long, bits array<int>")
    at_once = spatial_pooler.run_series(df, p).where("seq >= 20").collect()
    model_io.save({"pooler": spatial_pooler.train(df.where("seq < 20"), p)}, f"{tmp_path}/m")
    state = model_io.load(spark, f"{tmp_path}/m")[0]["pooler"]
    if not local:  # a local pooler's radius is taken anew from its synapses
        assert sorted(spatial_pooler.run_series(df.where("seq >= 20"), p, state=state).collect()) == sorted(at_once)
    one = state.where("series = 'a'")
    e = df.where("series = 'a'").select("seq", "bits")
    trained = spatial_pooler.Pooler(p, one.first().asDict())
    want = {k: trained.overlap(np.array(b, np.int64)).tolist() for s, k, b in rows if s == "a"}
    got = {k: [0] * 40 for k in want}
    for r in spatial_pooler.overlaps(e, spatial_pooler.synapses(one), ["seq"], "bits", p).collect():
        got[r.seq][r.column] = r.overlap
    assert got == want and spatial_pooler.columns(state).count() == 80


@pytest.mark.parametrize("limit", [10**6, 10])
def test_pooling_with_and_without_a_join(spark, monkeypatch, limit):
    """Synapses that travel to the rows and synapses that are joined give the same."""
    monkeypatch.setattr(connections, "BROADCAST_SYNAPSES", limit)
    p = replace(POOLER, inhibition_radius=4, boost=0.0)
    s = spatial_pooler.Pooler(p)
    syn = spark.createDataFrame(list(zip(*(x.tolist() for x in s.synapses()), strict=True)), "segment int, presyn int, perm double")
    rows = bit_rows(30, 7) + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, bits array<int>")
    got = {r.id: r.active for r in spatial_pooler.pool(df, syn, ["id"], "bits", p).collect()}
    assert got == {k: s.compute(np.array(b or [], np.int64), False)[0].tolist() for k, b in enumerate(rows)}
    boost = [1.0 + (c * 7 % 5) / 4 for c in range(40)]
    boosts = spark.createDataFrame(list(enumerate(boost)), "column int, boost double").where("boost <> 1")
    got = {r.id: r.active for r in spatial_pooler.pool(df, syn, ["id"], "bits", p, boosts).collect()}
    for k, bits in enumerate(rows):
        o = s.overlap(np.array(bits or [], np.int64))
        assert got[k] == sorted(sorted(range(40), key=lambda c: (-o[c] * boost[c], c))[: p.winners])  # noqa: B023
    for wrap in (False, True):
        q = replace(p, global_inhibition=False, wrap=wrap)
        got = {r.id: r.active for r in spatial_pooler.pool(df, syn, ["id"], "bits", q).collect()}
        for k, bits in enumerate(rows):
            o = s.overlap(np.array(bits or [], np.int64)).tolist()
            near = lambda c: [x for x in range(40) if x != c and (min(abs(c - x), 40 - abs(c - x)) if wrap else abs(c - x)) <= 4]  # noqa: E731, B023
            assert got[k] == [c for c in range(40) if o[c] > 0 and sum(o[x] > o[c] for x in near(c)) < math.ceil((len(near(c)) + 1) * 0.1)]
    act = {(r.id, r.segment): (r.connected, r.potential) for r in connections.activity(df, syn, ["id"], "bits", p.connected).collect()}
    own = {(c, i): v for c, i, v in zip(*(x.tolist() for x in s.synapses()), strict=True)}
    want = {}
    for k, bits in enumerate(rows):
        for c in range(40):
            hit = [own[c, i] for i in bits or [] if (c, i) in own]
            if hit:
                want[k, c] = (sum(v >= p.connected for v in hit), len(hit))
    assert act == want


@pytest.mark.parametrize("synapses_each, rows_each", [(7, 4), (40, 1000), (10**6, 3)])
def test_blocked_products(spark, monkeypatch, synapses_each, rows_each):
    """Blocks, parts of a hot input, and groups of rows; bits and inputs that the other side lacks."""
    monkeypatch.setattr(blocked, "BLOCK_SYNAPSES", synapses_each)
    monkeypatch.setattr(blocked, "GROUP_ROWS", rows_each)
    monkeypatch.setattr(blocked, "CELLS", 20)
    draw = random.Random(synapses_each)
    syn = {(c, draw.choice([5, 5, *range(0, 300, 7)])): draw.random() for c in range(0, 90, 3) for _ in range(6)}
    rows = [(k, draw.choice("ab"), sorted(draw.sample(range(310), 40)) if k % 5 else []) for k in range(20)] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "id int, s string, bits array<int>")
    got = blocked.activity(df, spark.createDataFrame([(c, i, p) for (c, i), p in syn.items()], "segment int, presyn int, perm double"), ["s", "id"], "bits", 0.5)
    want = {}
    for k, s, bits in rows:
        for (c, i), p in syn.items():
            if i in (bits or []):
                a, b = want.get((s, k, c), (0, 0))
                want[s, k, c] = (a + (p >= 0.5), b + 1)
    assert {(r.s, r.id, r.segment): (r.connected, r.potential) for r in got.collect()} == want


def test_classifier_goes_on(spark):
    draw = random.Random(5)
    rows = [(s, k, sorted(draw.sample(range(50), 6)), draw.randrange(4), k == 13) for s in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "series string, seq long, bits array<int>, bucket int, reset boolean")
    w = {}  # independent loops
    for s in "ab":
        past, buckets = [], 1
        for _, _, bits, bucket, reset in (r for r in rows if r[0] == s):
            past, buckets = ([] if reset else past) + [bits], max(buckets, bucket + 1)
            for step in (0, 2):
                if len(past) > step:
                    z = [sum(w.get((s, step, b, k), 0.0) for b in past[-1 - step]) for k in range(buckets)]
                    e = [math.exp(v - max(z)) for v in z]
                    for b in past[-1 - step]:
                        for k in range(buckets):
                            w[s, step, b, k] = w.get((s, step, b, k), 0.0) + 0.1 * ((k == bucket) - e[k] / sum(e))
    got = {(r.series, r.step, r.bit, r.bucket): r.w for r in classifier.learn_series(df, 0.1, (0, 2)).collect()}
    assert all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in w.items()) and got.keys() <= w.keys()
    half = classifier.train(df.where("seq < 20"), 0.1, (0, 2))
    again = {(r.series, r.step, r.bit, r.bucket): r.w for r in classifier.learn_series(df.where("seq >= 20"), 0.1, (0, 2), half).collect()}
    assert again.keys() == got.keys() and all(abs(again[k] - v) < 1e-12 for k, v in got.items())


@pytest.mark.parametrize("rows_each", [8192, 7])
def test_classifier_learns_series_together(spark, monkeypatch, rows_each):
    """Series of any length, cut by chunks or not, have the weights of a Classifier; no row carries a state that there isn't."""
    monkeypatch.setattr(classifier, "CHUNK_ROWS", rows_each)
    draw, rows = random.Random(6), []
    for s, n in [(None, 9), ("a", 40), ("b", 1), ("c", 3), *[(f"s{k}", draw.randrange(1, 12)) for k in range(20)]]:
        rows += [(s, k, draw.choices(range(30), k=draw.choice([0, 1, 5, 6])), draw.choice([-1, 0, 1, 2, 6]), draw.random() < 0.1) for k in range(n)]
    df = spark.createDataFrame(rows, "series string, seq long, bits array<int>, bucket int, reset boolean")
    made = {}
    for s, _, bits, bucket, reset in rows:
        c = made.setdefault(s, classifier.Classifier(0.1, (0, 2)))
        if reset:
            c.reset()
        c.learn(np.array(bits, np.int64), bucket)
    want = {(s, step, int(b), int(k)): w[b, k] for s, c in made.items() for step, w in c.weights.items() for b, k in zip(*np.nonzero(w))}
    out = classifier.learn_series(df, 0.1, (0, 2))
    got = {(r.series, r.step, r.bit, r.bucket): r.w for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    first = classifier.train(df.where("seq < 4"), 0.1, (0, 2))
    again = {(r.series, r.step, r.bit, r.bucket): r.w for r in classifier.learn_series(df.where("seq >= 4"), 0.1, (0, 2), first).collect()}
    assert again.keys() == want.keys() and all(abs(again[k] - v) < 1e-12 for k, v in want.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__state" not in plan and "Generate" not in plan


@pytest.mark.parametrize("limit", [10**6, 0])
def test_infer(spark, monkeypatch, limit):
    monkeypatch.setattr(classifier, "BROADCAST_WEIGHTS", limit)
    w = {(s, b, k): ((b * 13 + k * 7 + s) % 50) / 20 - 1 for s in (0, 3) for b in range(20) for k in (1, 2, 5)}
    weights = spark.createDataFrame([(*k, v) for k, v in w.items()], "step int, bit int, bucket int, w double")
    rows = [(1, [0, 3, 19]), (2, [25, 4]), (3, []), (4, None)]
    got = {(r.id, r.step, r.bucket): r.p for r in classifier.infer(spark.createDataFrame(rows, "id int, bits array<int>"), weights, ["id"]).collect()}
    assert len(got) == 4 * 6
    for (i, s, k), v in got.items():
        z = {x: sum(w.get((s, b, x), 0.0) for b in dict(rows)[i] or []) for x in (1, 2, 5)}
        assert abs(v - math.exp(z[k]) / sum(map(math.exp, z.values()))) < 1e-12


def test_graph_operations(spark):
    syn = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.02), (0, 3, 0.4), (1, 1, 0.9)], "segment int, presyn int, perm double").withColumn("change", F.lit(0.1))
    active, segs = spark.createDataFrame([(1,)], "presyn int"), spark.createDataFrame([(0,)], "segment int")
    once = connections.adapt(syn, active, segs, 0.1, 0.05, series=True, prune=True)
    assert {(r.segment, r.presyn): (round(r.perm, 9), r.change) for r in once.collect()} == {(0, 1): (0.5, 0.0), (0, 3): (0.35, -0.05), (1, 1): (0.9, 0.1)}
    again = connections.adapt(connections.forget(once), active, segs, 0.1, 0.05, series=True)
    assert {(r.segment, r.presyn): round(r.perm, 9) for r in again.collect()} == {(0, 1): 0.6, (0, 3): 0.3, (1, 1): 0.9}
    plain = syn.drop("change")
    wanted = spark.createDataFrame([(0, c, 2) for c in (3, 7, 8, 9)], "segment int, presyn int, n int")
    grown = {(r.segment, r.presyn): r.perm for r in connections.grow(plain, wanted, 0.2, most=3).collect()}
    assert len(grown) == 4 and grown[0, 1] == 0.5 and (0, 2) not in grown and sum(v == 0.2 for v in grown.values()) == 2
    table = spark.createDataFrame([(0, 5), (1, 5)], "segment int, cell int")
    more, left = connections.create_segments(table, plain, spark.createDataFrame([(5,), (6,), (5,)], "cell int"), 2)
    assert sorted((r.cell, r.segment == 0) for r in more.collect()) == [(5, False), (5, True), (6, False)] and left.count() == 3
    assert connections.same_graph((table, plain), (table.orderBy("cell"), plain)) and not connections.same_graph((table, plain), (table, left))


def test_classifier(spark):
    c = classifier.Classifier(0.1, (0,))
    a, b = np.arange(5), np.arange(50, 55)
    for _ in range(100):
        c.learn(a, 0)
        c.learn(b, 1)
    assert c.best(c.infer(a, 0)) == 0 and c.best(c.infer(b, 0)) == 1
    rows = [("s", 2 * k + j, (a if j == 0 else b).tolist(), j) for k in range(20) for j in (0, 1)]
    w = classifier.learn_series(spark.createDataFrame(rows, "series string, seq long, bits array<int>, bucket int"), 0.1, (0,))
    df = spark.createDataFrame([(1, a.tolist()), (2, b.tolist())], "id int, bits array<int>")
    p = classifier.infer(df, w.drop("series"), ["id"])
    assert {r.id: r.bucket for r in classifier.best(p, ["id"]).collect()} == {1: 0, 2: 1}


def test_anomaly(spark):
    v = value(spark, anomaly.score_of_cells(bits(0, 1, 2), bits(0, 4), 4), anomaly.score(bits(), bits(1)))
    assert math.isclose(v[0], 1 / 3) and v[1] == 0
    rows = [("s", k, 0.1) for k in range(20)] + [("s", 20, 0.1), ("s", 21, 0.9)]
    out = anomaly.Likelihood(10, 50, 10).add(spark.createDataFrame(rows, "series string, seq long, x double"), "x", ["series"], ["seq"])
    p = {r.seq: r.likelihood for r in out.collect()}
    assert p[0] == 0.5 and p[21] > p[20]
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        assert abs(value(spark, anomaly.erfc(F.lit(x)))[0] - math.erfc(x)) < 2e-7


def test_metrics(spark):
    df = spark.createDataFrame([("s", 0, [0, 1, 2, 3, 4]), ("s", 1, [2, 3, 4, 5, 6])], "series string, seq long, bits array<int>")
    m = metrics.summary(df, "bits", 100, ["series"], ["seq"]).first()
    assert m.sparsity_mean == 0.05 and m.overlap_mean == 3 and m.num_samples == 2
    u = metrics.usage(df, "bits", 100, ["series"]).first()
    assert u.dead_bits == 93


def test_windows(spark):
    e = spark.range(500).select(F.lit("n").alias("series"), F.col("id").alias("seq"), F.sin(F.col("id") / 7).alias("value"))
    w = windows.count_windows(e, ["series"], ["seq"], "value", 50)
    assert w.count() == 10
    f = w.select(windows.features(F.col("samples")).alias("f"))
    assert f.where("f.p2p > 0").count() == 10
    assert value(spark, windows.distance(windows.features(F.array(F.lit(1.0), F.lit(2.0))), windows.features(F.array(F.lit(1.0), F.lit(2.0)))))[0] == 0


def test_hybrid_score_meets_every_baseline(spark, tmp_path, monkeypatch):
    from quillon.plans import catalog

    draw = random.Random(5)
    rows = [(u, k, 1000 * u + k, draw.uniform(0, 500)) for u in [3 * j for j in range(1, 131)] for k in range(20)]
    spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(nearest, "BLOCK", 20)  # several blocks and groups of rows
    monkeypatch.setattr(nearest, "ROWS", 30)
    monkeypatch.setattr(windows, "RANGES", 7)
    got = {(r.user_id, r.win): r for r in catalog.hybrid_score(spark, str(tmp_path)).collect()}
    all_windows = {(r.user_id, r.win): (set(r.bits), r.f) for r in catalog.scored_windows(spark, str(tmp_path)).collect()}
    base = [all_windows[k] for k in sorted(all_windows) if k[1] == 0]
    apart = lambda f, g: sum(abs(f[k] - g[k]) * w for k, w in windows.WEIGHTS.items())
    step = len(base) // 50
    d = [apart(base[i][1], base[j][1]) for i in range(0, len(base), step) for j in range(i + 1, len(base), step)]
    assert step == 2 and len(got) == len(all_windows) == 260
    for key, (own, f) in all_windows.items():
        overlap, near = max(len(own & b) for b, _ in base), min(apart(f, g) for _, g in base)
        z = (near - np.mean(d)) / np.std(d)
        score = 0.3 * max(0, 1 - overlap / 40) + 0.7 * max(0, z / (1 + abs(z)))
        assert got[key].overlap == overlap and abs(got[key].distance - near) < 1e-5 and abs(got[key].score - score) < 1e-5


def brute_activation(samples, side):
    """The five layers of one window, place by place, for a side of 256."""
    n, act = len(samples), {}

    def put(y, x, v):
        if 0 <= y < side and 0 <= x < side and v > 0:
            act[x, y] = max(act.get((x, y), 0), v)

    low, span = min(samples), max(max(samples) - min(samples), 0.001)
    slope = [0.0] + [b - a for a, b in zip(samples, samples[1:])]
    bend = [0.0] + [b - a for a, b in zip(slope, slope[1:])]
    rms = [math.sqrt(sum(v * v for v in samples[max(i - 5, 0) : i + 5]) / len(samples[max(i - 5, 0) : i + 5])) for i in range(n)]
    top_slope, top_bend, top_rms = (max(max(map(abs, v)), 0.001) for v in (slope, bend, rms))
    for i in range(n):
        x = min(int(i / n * side), side - 1)
        centre = ((1 - (samples[i] - low) / span) * 0.4 + 0.55) * side
        for dy in range(-15, 16):
            put(int(centre) + dy, x, math.exp(-2 * (dy / 20) ** 2) * 0.8)
        for dy in range(-8, 9):
            put(int((1 - (slope[i] / top_slope + 1) / 2) * 0.35 * side) + dy, x, math.exp(-2 * (dy / 10) ** 2) * abs(slope[i]) / top_slope * 0.7)
        e, spread = rms[i] / top_rms, int(rms[i] / top_rms * 15)
        for dy in range(-spread, spread + 1):
            put(int(0.45 * side) + dy, x, e * (1 - abs(dy) / (spread + 1)) * 0.5 if e > 0.3 else 0)
        c = abs(bend[i]) / top_bend
        radius = int(c * 8)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if c > 0.4 and dx * dx + dy * dy <= radius * radius:
                    put(int(centre) + dy, x + dx, c * (1 - math.hypot(dx, dy) / radius) * 0.6)
    for nth, period in enumerate((4, 8, 16, 32)):
        for begin in range(0, n, period // 2):
            chunk = samples[begin : begin + period]
            m = len(chunk)
            if m < period // 2:
                continue
            parts = [(sum(v * math.cos(2 * math.pi * k * j / m) for j, v in enumerate(chunk)), sum(v * math.sin(2 * math.pi * k * j / m) for j, v in enumerate(chunk))) for k in range(m // 2)]
            mag = min(sum(math.hypot(*p) for p in parts) / m / span, 1)
            x = min(int((begin + begin + m) // 2 / n * side), side - 1)
            for dy in range(8):
                for dx, v in ((0, 0.4), (-1, 0.3), (1, 0.3)):
                    put(min(int((nth * 0.08 + 0.02) * side) + dy, side - 1), x + dx, mag * v)
    return act


def test_fingerprint_layers(spark):
    draw = random.Random(3)
    rows = [(u, [draw.uniform(-50, 300) for _ in range(n)]) for u, n in ((1, 10), (1, 10), (2, 23), (2, 40))] + [(3, [7.0] * 10)]
    df = spark.createDataFrame([*rows, (4, None), (4, []), (4, [1.0, None])], "user_id long, samples array<double>")
    points = windows.fingerprint_points(df, ["user_id"], "samples")
    want = [(u, brute_activation(s, 256)) for u, s in rows]
    got = [(r.user_id, {(p.x, p.y): p.v for p in r.points}) for r in points.collect()]
    same = lambda a, b: a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert len(got) == len(want) and all(any(u == v and same(a, b) for v, b in got) for u, a in want)
    bits = [set(r.b) for r in points.select(windows.sparse_bits(F.col("points"), 256, 0.3).alias("b")).collect()]
    assert all({y * 256 + x for (x, y), v in a.items() if v > 0.3} in bits for _, a in want)
    maps = {}
    for r in windows.fingerprint(points, ["user_id"], "points").collect():
        maps.setdefault(r.user_id, {})[r.x, r.y] = r.v
    for u in (1, 2, 3):
        total = {}
        for a in (a for v, a in want if v == u):
            for k, v in a.items():
                total[k] = total.get(k, 0) + v
        assert same(maps[u], {k: v / max(total.values()) for k, v in total.items()})


def test_fingerprint_tells_frequencies_apart(spark):
    slow, fast = [0.0, 1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 1.0, 2.0, 3.0], [0.0, 3.0, 1.0, 2.0, 0.0, 3.0, 1.0, 2.0, 1.0, 2.0]
    act = windows.activation(np.array([slow, fast]), 64)
    assert sorted(slow) == sorted(fast) and (np.abs(act[0] - act[1])[:29] > 0.1).any()  # above the amplitude's layer


def test_models(spark, tmp_path):
    t = spark.createDataFrame([(1, [1, 2])], "id int, bits array<int>")
    for path in (f"{tmp_path}/m", f"{tmp_path}/m.json"):
        model_io.save({"t": t}, path, {"alpha": 0.5})
        tables, params = model_io.load(spark, path)
        assert tables["t"].collect() == t.collect() and params == {"alpha": 0.5}
    assert value(spark, model_io.to_json(bits(1, 2), 9))[0] == '{"dims":[9],"bits":[1,2]}'


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select sdr_overlap(array(1,2,3), array(2,3,4)) as o, anomaly_score(array(1,2), array(2)) as a, encode_scalar(50D, 0D, 100D, 100, 5) as e").first()
    assert r.o == 2 and r.a == 0.5 and r.e == [48, 49, 50, 51, 52]


def test_cell_statistics_read_ticks_once(spark, tmp_path):
    """Ticks may be the work of a sequential learner: they are counted in one pass, whatever nulls they have."""
    rows = [([1, 2, 3], [2, 9], 0.6), ([2, 3], [], 0.5), ([], [3], 1.0), (None, [1], 0.9), ([3, None], None, None), ([7], [7, 1], 0.7)]
    passes = tmp_path / "passes"
    passes.mkdir()

    def slow(batches):
        for k, batch in enumerate(batches):
            (passes / f"{__import__('uuid').uuid4().hex}-{k}").write_text("")
            yield batch

    ticks = spark.createDataFrame(rows, "active_cells array<int>, predicted_cells array<int>, anomaly double").coalesce(1)
    ticks = ticks.mapInArrow(slow, ticks.schema)
    found = {r["cell"]: tuple(r)[1:] for r in windows.cell_statistics(ticks).collect()}
    assert found == {1: (1, 0, 1, 1 / 6, 0.0), 2: (2, 1, 1, 2 / 6, 0.5), 3: (3, 0, 1, 3 / 6, 0.0), 7: (1, 1, 1, 1 / 6, 1.0)}
    assert len(list(passes.iterdir())) == 1
    assert windows.cell_statistics(ticks.limit(0)).count() == 0


def test_poolers_draw_their_first_synapses_once(monkeypatch):
    """Each of many short series begins with a new pooler: they have the same first synapses, and learn apart."""
    p = spatial_pooler.PoolerParams(inputs=(50,), columns=(20,), potential_radius=50, seed=77)
    drawn = []
    monkeypatch.setattr(spatial_pooler, "_drawn", lambda p, of=spatial_pooler._drawn: drawn.append(p) or of(p))
    a, b = spatial_pooler.Pooler(p), spatial_pooler.Pooler(p)
    first = b.export()
    for k in range(5):
        a.compute(np.arange(k, k + 9), True)
    assert drawn == [p] and b.export() == first == spatial_pooler.Pooler(p).export() != a.export()
