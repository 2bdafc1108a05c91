"""Tables that a job writes once and reads several times, on storage that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where the session names none, one is made and remembered in local mode only; on a cluster a folder of one machine would
    lose what executors write elsewhere, so that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tramline.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-tramline-")
        spark.conf.set("tramline.scratch", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files are removed when it ends, instead of when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again: later uses neither repeat its work nor plan it anew, and lost executors cost nothing.

    The shuffle files of the job that writes it go as soon as it ends, so that a query of several such steps holds those of one at a time.
    """
    path = shared_folder(df.sparkSession, label)
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
