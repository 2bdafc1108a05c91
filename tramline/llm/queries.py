"""The corpus queries, one per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import chat, decontaminate, divergence, language_id, mixing, near_dup, oracles, quality_gam, quality_rules, secrets, shards, spelling, token_counts, toxicity
from tramline.llm.common import remainder_is, table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_is("doc_id", 3, 1)
    return language_id.identify(docs, language_id.train(docs.filter(~held_out & F.col("doc_id").isNotNull())), held_out)


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf_dir, "conversations")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder_is("doc_id", 4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model, held_out)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder_is("doc_id", 3, 1)
    model = quality_gam.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality_gam.score(docs, model, held_out)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_rotation": oracles.CHAT, "op4_minhash_near_dedup": oracles.NEAR_DUP, "op7_benchmark_decontamination": oracles.LEAKS, "op12_source_divergence": oracles.DIVERGENCE, "op13_spelling_variants": oracles.SPELLING}
