"""What the corpus operators share: table access, scratch tables on shared storage, and label folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.sources.scratch import shared_folder, stored, swept

__all__ = ["bounded_sample", "discard", "fold", "in_batches", "labelled_sample", "remainder_is", "shared_folder", "stored", "swept", "table"]
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def remainder_is(doc_id: str | Column, folds: int, r: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == r, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows (all if there are fewer), the same ones in every run: those with the smallest hashed keys."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """``text, y`` of about ``bound`` labelled documents.  The sample is taken from the labels, so that only it is broadcast.

    An id counts once, however often the labels or the documents repeat it: with its highest label and its first text.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
    few = bounded_sample(rows, F.col("doc_id").cast("string"), bound, seed)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def in_batches(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of ``BATCH_ROWS`` rows.

    Spark's default of 10,000 rows can be hundreds of MB of long texts on either side.  A session that sets its own number
    keeps it.  ``mapInArrow`` takes a dot in a column's name for a field of a struct, so such columns go in under other names.
    """
    odd = [c for c in df.columns if "." in c or "`" in c]
    if odd:
        wide = max(map(len, df.columns)) + 1
        df = df.toDF(*["_" * wide + str(k) if c in odd else c for k, c in enumerate(df.columns)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)
