"""A stream in several micro-batches gives what the batch form gives."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import encoders, slices, spatial_pooler, temporal_memory
from quillon.operators.anomaly import Likelihood
from quillon.operators.classifier import Classifier
from quillon.streaming import stateful

SCHEMA = "series string, seq long, value double"


def rows(n):
    return [(s, k, float((k * 7 + len(s)) % 11) / 10) for s in ("a", "bb") for k in range(n)]


def stream(spark, tmp_path, n, parts, make):
    """Runs make(stream) over the rows in so many files, one a micro-batch."""
    data = rows(n)
    for p in range(parts):
        own = [r for r in data if r[1] * parts // n == p]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"t{abs(hash(str(tmp_path))) % 10**8}"
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_delta(spark, tmp_path):
    got = {(r.series, r.seq): r.delta for r in stream(spark, tmp_path, 12, 3, stateful.delta)}
    df = spark.createDataFrame(rows(12), SCHEMA)
    want = df.select("series", "seq", encoders.DeltaEncoder.delta(F.col("value"), ["series"], ["seq"]).alias("d")).collect()
    assert len(got) == 24 and all(abs(got[r.series, r.seq] - r.d) < 1e-12 for r in want)


def test_likelihood(spark, tmp_path):
    p = Likelihood(5, 6, 3)
    got = {(r.series, r.seq): r.likelihood for r in stream(spark, tmp_path, 20, 2, lambda s: stateful.likelihood(s, p))}
    want = p.add(spark.createDataFrame(rows(20), SCHEMA), "value", ["series"], ["seq"]).collect()
    assert all(abs(got[r.series, r.seq] - r.likelihood) < 1e-9 for r in want)


@pytest.mark.parametrize("kind", ["delta", "likelihood"])
def test_sessions_in_a_stream(spark, tmp_path, kind):
    """A stream with reset flags gives what the batch form gives by session."""
    p, flag = Likelihood(3, 4, 2), F.col("seq") % 7 == 3
    make = stateful.delta if kind == "delta" else lambda s: stateful.likelihood(s, p)
    got = {(r.series, r.seq): r[kind] for r in stream(spark, tmp_path, 24, 3, lambda s: make(s.withColumn("reset", flag)))}
    by_session = slices.sessions(spark.createDataFrame(rows(24), SCHEMA), ["series"], ["seq"], flag, [], slices=3)
    keys = (["series", "session"], ["seq"])
    want = slices.delta(by_session, "value", *keys, slices=3) if kind == "delta" else slices.likelihood(by_session, "value", *keys, p, slices=3)
    want = want.select("series", "seq", "session", kind).collect()
    assert len(got) == 48 and max(r.session for r in want) == 4
    assert all(abs(got[r.series, r.seq] - r[kind]) < 1e-9 for r in want)


def test_memory(spark, tmp_path):
    p = temporal_memory.MemoryParams(columns=(50,), cells_per_column=3, activation=2, min_threshold=1, initial=0.5)
    cols = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i + F.col("seq") % 4 * 10).cast("int"))
    got = {(r.series, r.seq): r.anomaly for r in stream(spark, tmp_path, 24, 3, lambda s: stateful.memory(s.withColumn("cols", cols), p))}
    want = temporal_memory.run_series(spark.createDataFrame(rows(24), SCHEMA).withColumn("cols", cols), p).collect()
    assert {(r.series, r.seq): r.anomaly for r in want} == got


def test_memory_forgets_at_a_reset(spark, tmp_path):
    p = temporal_memory.MemoryParams(columns=(50,), cells_per_column=3, activation=2, min_threshold=1, initial=0.5)
    cols = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i + F.col("seq") % 4 * 10).cast("int"))
    with_reset = lambda df: df.withColumn("cols", cols).withColumn("reset", F.col("seq") % 5 == 0)
    got = {(r.series, r.seq): r.anomaly for r in stream(spark, tmp_path, 24, 3, lambda s: stateful.memory(with_reset(s), p))}
    want = temporal_memory.run_series(with_reset(spark.createDataFrame(rows(24), SCHEMA)), p).collect()
    assert {(r.series, r.seq): r.anomaly for r in want} == got and all(v == 1 for (_, k), v in got.items() if k % 5 == 0)


def test_pooler(spark, tmp_path):
    p = spatial_pooler.PoolerParams(inputs=(50,), columns=(30,), potential_radius=50, boost=2.0, density=0.1)
    bits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i + F.col("seq") % 7 * 6).cast("int"))
    got = {(r.series, r.seq): r.active for r in stream(spark, tmp_path, 20, 3, lambda s: stateful.pooler(s.withColumn("bits", bits), p))}
    want = spatial_pooler.run_series(spark.createDataFrame(rows(20), SCHEMA).withColumn("bits", bits), p).collect()
    assert {(r.series, r.seq): r.active for r in want} == got


def test_classifier(spark, tmp_path):
    """The probabilities before each row are those of a classifier that has learned the rows before it."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i + F.col("seq") % 3 * 5).cast("int"))
    make = lambda df: df.withColumn("bits", bits).withColumn("bucket", (F.col("seq") % 3).cast("int")).withColumn("reset", F.col("seq") == 6)
    got = {(r.series, r.seq): r.p for r in stream(spark, tmp_path, 15, 3, lambda s: stateful.classifier(make(s), 0.2, (1,)))}
    for series in ("a", "bb"):
        c = Classifier(0.2, (1,))
        for k in range(15):
            if k == 6:
                c.reset()
            own = np.array([i + k % 3 * 5 for i in range(3)])
            assert np.allclose(got[series, k], c.infer(own, 1))
            c.learn(own, k % 3)


def test_states_go_when_their_time_is_up(spark, tmp_path):
    """A series without rows for the time-out loses its state, and its late rows are told then."""
    at = lambda n: datetime.datetime(2024, 1, 1, 0, 0, n, tzinfo=datetime.timezone.utc)
    (tmp_path / "in").mkdir()
    parts = [[("a", 5, 1.0, at(0))], [("a", 3, 9.0, at(1)), ("a", 2, 9.0, at(1))], [("b", 1, 1.0, at(40))], [("b", 2, 2.0, at(41))], [("a", 1, 7.0, at(50)), ("b", 3, 2.0, at(51))]]
    schema = SCHEMA + ", ts timestamp"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.delta(source.withWatermark("ts", "1 second"), timeout=5)
    query = None
    for k, own in enumerate(parts):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, k
    got = sorted((r.series, r.seq, r.delta, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.delta is not None)
    told = [(r.series, r.seq, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.delta is None]
    assert got == [("a", 1, 0.0, 0), ("a", 5, 0.0, 0), ("b", 1, 0.0, 0), ("b", 2, 1.0, 0), ("b", 3, 0.0, 0)] and told == [("a", 5, 2)]


def test_fields():
    assert [x.strip() for x in stateful._split("a int, b array<struct<c:int,d:int>>, e long")] == ["a int", "b array<struct<c:int,d:int>>", "e long"]
    assert pytest is not None
