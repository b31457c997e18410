"""Registered queries of the subpackage: (spark, sf_dir) -> DataFrame, each
over its whole table. ``oracle`` has the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, labelled, langid, merkle, mixing, neardup, negatives, pii, quality, ranking, recurrent, sharding,
    toxicity, warc,
)
from .common import held_out, table
from .oracle import ORACLES  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_ok = quality.passes("base-1")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base_ok).alias("base_failed"), (base_ok & quality.passes()).alias("kept"), "fail_bits")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked_documents(documents(spark, sf_dir))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir).select("doc_id", "text", "source"))


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = labelled.learning_sample(docs, table(spark, sf_dir, "labels"), "quality")
    return _judged(ranking.score(docs, ranking.fit(sample)), ranking.DECISION)


def toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = labelled.learning_sample(docs, table(spark, sf_dir, "labels"), "toxic")
    return _judged(toxicity.score(docs, toxicity.fit(sample)), 0.5)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(langid.learning_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        "cross_entropy", "rejected")


def warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "position")


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir).select("doc_id", "text"), sharding.even_tree(16))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"),
        (F.col("vec_id") % 100 == 0).alias("anchor"))
    return negatives.MultiIndex(rows).mine()


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.Manifest(documents(spark, sf_dir)).proofs()


def recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = recurrent.fit(docs.filter(~recurrent.held_out(F.col("doc_id"))))
    return recurrent.score(docs, model).select(
        "doc_id", recurrent.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


QUERIES = {
    "op1_personal_data": personal_data,
    "op2_quality_rules": quality_rules,
    "op3_jaccard_join": jaccard_join,
    "op4_source_mixing": source_mixing,
    "op5_quality_ranking": quality_ranking,
    "op6_toxicity_grammar": toxicity_grammar,
    "op7_language_id": language_id,
    "op8_warc_index": warc_index,
    "op9_benchmark_leaks": benchmark_leaks,
    "op10_hash_tree_shards": hash_tree_shards,
    "op11_hard_negatives": hard_negatives,
    "op12_merkle_manifest": merkle_manifest,
    "op13_recurrent_lm": recurrent_scores,
}
