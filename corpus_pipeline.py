"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage's result is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents (doc_id, text, lang, source, n_chars, and whatever else docs has).

* quality_rules: documents that the rules reject go.
* simhash_dedup: of each class of near duplicates one row stays, that with the smallest doc_id; null ids come last, and
  rows of equal ids go by a hash of all columns.
* substring_dedup: repeated passages go from the texts; n_chars follows. No document goes.
* decontamination: documents that contain a benchmark item go, row by row: null and repeated ids make no difference.
* bpe: the tokens of each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

Empty tables pass through. A null text fails the quality rules. Rows that repeat a doc_id within a class: one stays. Other
columns pass through, whatever their names and types (those with maps are compared as JSON).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, pair_bpe, simhash_dedup, substring_dedup
from quillon.llm import quality_rules as rules
from quillon.llm.common import hashable, remove_stage_tables, stage_paths, stage_table, table, unused
from quillon.llm.queries import vocabulary


def _aside(docs: DataFrame, results: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with other names for columns that are called like a result, and these names."""
    moved = {c: unused(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in results.split()}
    return docs.withColumnsRenamed(moved), moved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, moved = _aside(docs, "n_words word_chars n_symbols n_dup_lines n_repeat_words llr base_failed kept")
    kept = rules.judge(own, table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*[F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays. Rows are told apart by two 64-bit hashes of all their columns, which texts meet in the end."""
    keys = [unused(f"row_key_{n}", docs.columns) for n in (1, 2)]
    marked = docs.withColumns({k: F.xxhash64(F.lit(n), *hashable(docs)) for n, k in enumerate(keys, 1)})
    classes = simhash_dedup.near_duplicates(spark, marked, keep=[F.col(k) for k in keys])
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *keys)
    stays = classes.groupBy("root").agg(F.min(order).alias("first")).select(*[F.col("first")[k].alias(k) for k in keys])
    kept = marked.join(stage_table(spark, stays, "stays"), keys, "left_semi")
    return kept.dropDuplicates(keys).select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, moved = _aside(docs, "n_words n_removed kept_sha256 kept")
    found = substring_dedup.deduplicate(spark, own)
    made = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[made[c].alias(c) if c in made else F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that contain no item. Rows are told apart by two 64-bit hashes of all their columns, as in simhash."""
    key = F.struct(*[F.xxhash64(F.lit(n), *hashable(docs)).alias(f"k{n}") for n in (1, 2)])
    row = unused("row_key", docs.columns)
    marked = docs.withColumn(row, key)
    hit = decontamination.contained(marked, table(spark, sf_dir, "benchmark"), doc_id=row).select("doc_id.k1", "doc_id.k2").distinct()
    hit = stage_table(spark, hit, "contaminated")
    same = (marked[row]["k1"] == hit["k1"]) & (marked[row]["k2"] == hit["k2"])
    return marked.join(hit, same, "left_anti").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pair_bpe.encode(spark, docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"), ids=False, decoded=False).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("bpe", bpe),
]

#: SQL can't express SimHash classes at a bearable cost, nor BPE; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written and read again before the next stage, and what it came from is removed."""
    docs, others = table(spark, sf_dir, "documents"), stage_paths(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(spark, docs, f"pipeline-{name}")
            remove_stage_tables(spark, others | {docs.stage_path})
    return docs
