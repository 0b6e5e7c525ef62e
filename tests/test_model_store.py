"""Versions of models: whole or not at all, and only what has changed."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.errors import SerializationError
from quillon.sources.model_store import ModelStore


def synapses(spark, rows):
    return spark.createDataFrame(rows, "segment int, presyn int, perm double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_and_changes(spark, tmp_path):
    store, keys = ModelStore(spark, str(tmp_path / "m")), {"synapses": ["segment", "presyn"]}
    assert store.versions() == []
    with pytest.raises(SerializationError):
        store.load()
    steps = [
        [(1, 1, 0.5), (1, 2, 0.1), (None, 3, None)],
        [(1, 1, 0.6), (1, 2, 0.1), (None, 3, None), (4, 4, 0.2)],  # one differs, one is new
        [(1, 2, 0.1), (4, 4, 0.2)],  # two are gone
        [(1, 2, 0.1), (4, 4, 0.2), (1, 1, 0.6), (None, 3, 0.0)],  # and come back
        [],
        [(7, 7, 0.7)],
    ]
    for k, now in enumerate(steps, 1):
        assert store.save({"synapses": synapses(spark, now), "notes": spark.range(k)}, {"step": k}, keys) == k
    assert store.versions() == list(range(1, len(steps) + 1))
    for k, now in enumerate(steps, 1):
        tables, params = store.load(k)
        assert rows(tables["synapses"]) == sorted(now, key=repr) and params == {"step": k} and tables["notes"].count() == k
        assert tables["synapses"].columns == ["segment", "presyn", "perm"]
    assert rows(store.load()[0]["synapses"]) == steps[-1]
    entry = store.manifest(2)["tables"]["synapses"]
    assert spark.read.parquet(entry["changes"][0]).count() == 2


def test_a_chain_ends(spark, tmp_path, monkeypatch):
    from quillon.sources import model_store

    monkeypatch.setattr(model_store, "CHAIN", 2)
    store, keys = ModelStore(spark, str(tmp_path)), {"t": ["segment", "presyn"]}
    for k in range(5):
        store.save({"t": synapses(spark, [(1, 1, float(k))])}, keys=keys)
    assert [len(store.manifest(v)["tables"]["t"]["changes"]) for v in store.versions()] == [0, 1, 2, 0, 1]
    assert rows(store.load()[0]["t"]) == [(1, 1, 4.0)]
    store.save({"t": spark.range(2)}, keys={"t": ["id"]})  # another schema is saved whole
    assert rows(store.load()[0]["t"]) == [(0,), (1,)]


def test_a_save_that_is_cut_off(spark, tmp_path):
    """A table that fails after another has been written, and a manifest that is never renamed."""
    store = ModelStore(spark, str(tmp_path))
    good = synapses(spark, [(1, 1, 0.5)])
    store.save({"a": good, "b": good})
    bad = good.select("segment", "presyn", F.assert_true(F.col("perm") > 1).cast("double").alias("perm"))
    with pytest.raises(Exception, match="is not true"):
        store.save({"a": synapses(spark, [(2, 2, 0.9)]), "b": bad})
    assert store.versions() == [1] and rows(store.load()[0]["a"]) == [(1, 1, 0.5)]
    monkey = store._publish
    store._publish = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.save({"a": synapses(spark, [(3, 3, 0.9)]), "b": good})
    store._publish = monkey
    assert rows(store.load()[0]["a"]) == [(1, 1, 0.5)]
    assert store.save({"a": good, "b": good}) == 2


def test_two_writers(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    store.save({"a": spark.range(1)})
    with pytest.raises(SerializationError):
        store._publish(1, {"params": {}, "tables": {}})
    assert store.load()[0]["a"].count() == 1 and os.path.isdir(tmp_path / "manifests")
