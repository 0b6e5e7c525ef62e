"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, importance, language_id, language_model, minhash_dedup, pair_bpe, quality_rules, simhash_dedup, substring_dedup, toxicity, trie_tokens, whitening
from .common import fold, table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents")).drop("root")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 10) == 0
    return language_model.fit_and_score(spark, docs, ~held_out).withColumn("held_out", held_out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out().alias("held_out")
    model = toxicity.fit(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model, [F.col("doc_id"), held_out])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    filters = language_id.fit(docs.where(~held_out))
    return language_id.predict(spark, docs, filters, [F.col("doc_id"), held_out.alias("held_out")])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return trie_tokens.token_counts(spark, docs, trie_tokens.learn(spark, docs, vocabulary("piece_bpe_32k.model")), [F.col("doc_id")])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pair_bpe.encode(spark, docs, vocabulary("word_bpe_49k.json"), ids=False, decoded=False).drop("text")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of rows whose vec_id is divisible by 7 moves on by one of ten; anchors are the rows whose vec_id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(spark, rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring": op2_substring,
    "op3_quality": op3_quality,
    "op4_importance": op4_importance,
    "op5_language_model": op5_language_model,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
    "op11_minhash": op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op2_substring": substring_dedup.oracle_sql(), "op6_decontamination": decontamination.oracle_sql(), "op13_hard_negatives": hard_negatives.oracle_sql()}
