"""One query for each training-data operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, bpe, codebooks, embedding, langid, linededup, mixing, negatives, rules, simhash, substring, toxicity, vantage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.remove_repeated_lines(table(spark, sf_dir, "documents"), exact_from=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts and its base rule, without the learned list."""
    judged = rules.base_rule(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("_size") * F.col("_copies")).cast("long")
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "quality_base_counts": quality_base_counts,
        "op6_mixing": op6_mixing,
        "op7_language_id": op7_language_id,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"quality_base_counts": rules.ORACLE, "op2_embedding_near_dedup": embedding.ORACLE, "op3_substring_dedup": substring.ORACLE, "op6_mixing": mixing.ORACLE, "op11_vector_codes": codebooks.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_nearest_neighbours": vantage.ORACLE}
