"""The pipeline against its brute-force version: each stage judged on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, decontamination, quality_rules

from .test_llm import CLASHES, ODD, SCHEMA, brute_base, brute_simhash, brute_substring, docs, with_clashes


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def results(spark, sf):
    out, now = [], common.table(spark, sf, "documents")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        after = common.stage_table(spark, f(spark, now, sf), f"test-{name}")
        out.append((name, now, after))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == now.columns and dict(after.dtypes) == dict(now.dtypes)
        now = after
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality(spark, sf, results):
    before, after = results["quality_rules"]
    judged = quality_rules.judge(before, common.table(spark, sf, "labels"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged.collect() if r.kept}
    assert not any(brute_base(x)[-1] for _, x in rows(after))


def test_simhash(results):
    before, after = (rows(df) for df in results["simhash_dedup"])
    assert {k for k, _ in after} == {c for _, _, c in brute_simhash(before)} and len(after) == len({k for k, _ in after})


def test_substring(results):
    before, after = (rows(df) for df in results["substring_dedup"])
    want = {k: n for k, _, n, _ in brute_substring(before)}
    text = dict(before)
    assert len(after) == len(before)
    for k, x in after:
        assert len(x.split()) == len(text[k].split()) - want[k] and (want[k] or x == text[k])


def test_decontamination(spark, sf, results):
    before, after = results["decontamination"]
    hit = {r.doc_id for r in decontamination.contained(before, common.table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - hit


def test_run(spark, sf, results):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, results["bpe"][1].collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf, name):
    df = docs(spark, ODD)
    assert stage(name)(spark, df, sf).count() <= len(ODD)
    assert stage(name)(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
    if name == "substring_dedup":
        assert stage(name)(spark, df, sf).count() == len(ODD)


def test_decontamination_goes_by_row(spark, sf):
    item = common.table(spark, sf, "benchmark").where("length(text) > 100").orderBy("item_id").first().text
    clean = " ".join(f"clean{k}" for k in range(60))
    rows = [(None, item), (1, item), (1, clean), (None, clean), (2, clean), (2, clean), (3, None)]
    after = stage("decontamination")(spark, docs(spark, rows), sf)
    assert Counter(map(tuple, after.select("doc_id", "text").collect())) == Counter([(1, clean), (None, clean), (2, clean), (2, clean), (3, None)])
    assert after.columns == docs(spark, rows).columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_that_are_called_like_results(spark, sf, name):
    long = " ".join(f"word{k}" for k in range(70))
    own = {c: F.lit(f"mine {c}") for c in "n_words kept n_removed kept_sha256 llr row_key row_key_1 fp component_id item_id __quality_words n_repeat_words base_failed".split() if c[:2] != "__"}
    df = docs(spark, [(1, long), (2, long + " more"), (3, None)]).withColumns(own)
    after = stage(name)(spark, df, sf)
    assert after.columns == df.columns and dict(after.dtypes) == dict(df.dtypes)
    assert all(r[c] == f"mine {c}" for r in after.collect() for c in own)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_and_type(spark, sf, name):
    long = " ".join(f"word{k}" for k in range(70))
    df = with_clashes(docs(spark, [(1, long), (2, long + " more"), (3, None)]))
    after = stage(name)(spark, df, sf)
    if name != "bpe":
        assert after.columns == df.columns and dict(after.dtypes) == dict(df.dtypes)
        assert all(r[c] == f"mine {c}" for r in after.collect() for c in CLASHES)
    assert after.count() >= (0 if name == "quality_rules" else 1)
