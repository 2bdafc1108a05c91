"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token shards.

Each stage reads the table that the one before has written.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import decontaminate, mixing, near_dup, quality_rules, shards
from tramline.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision verdict keeps."""
    judged = quality_rules.judge(docs.withColumn("_row", F.struct(*docs.columns)), keep=("_row",))
    return judged.filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, rows without an id included: the one with the smallest id, then the smallest text hash.

    Rows that repeat an id are one document.  Wordless rows are alike only if they repeat an id or, without one, the text.
    """
    kept = stored(near_dup.survivors(docs, words=5, percent=80), "kept")
    # The row travels whole in a column of its own, so that no name in it can clash with the keys.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), near_dup.text_key().alias("_key"))
    ids = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    rows = rows.join(ids, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    if not kept.filter("copies > 1").isEmpty():
        rows = rows.dropDuplicates(["_id", "_key"])
    return rows.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents that mostly consist of them go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights follow the tempered source, language and topic margins."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride shards in training order; returns their index."""
    return shards.training_order(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mix),
    ("token_id_output", tokens),
]
#: None: SQL can't express the iterative fits and the tokenizer.  tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
