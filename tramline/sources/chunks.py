"""Fact tables in chunks of time, and rollups that are kept up to date beside them.

A chunked table is a folder of Parquet with one partition per stretch of ``seconds``, numbered from the epoch, so that neither the session's
time zone nor the calendar decides where a chunk begins.  Whole chunks are dropped as folders, without opening a file.

A rollup is a chunked table with a chunk for each of its buckets, and a log of the buckets that facts have touched since they
were last computed.  The log is written before the facts, and an entry is done with only after the facts were there: whatever fails in
between, a bucket is computed once too often, never once too few.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions import exprs as X
from tramline.sources.scratch import discard, stored

CHUNK = "chunk"
MOST_BUCKETS = 200_000  # dirty buckets named in one refresh: over 20 years of hours


class Folder:
    """The entries of a folder on whatever storage the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.base = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.base)] if self.fs.exists(self.base) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.base, name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(self.base, old), self._path(self.base, new)):
            raise OSError(f"{old} can't be renamed to {new}")


@dataclass(frozen=True)
class Chunked:
    """A table at ``path`` whose rows belong to the chunk of their time ``ts``."""

    path: str
    schema: T.StructType
    ts: str
    seconds: int

    def number(self, ts: Column | str | None = None) -> Column:
        return F.floor(X.epoch(self.ts if ts is None else ts) / self.seconds).cast("long")

    def _write(self, df: DataFrame, mode: str) -> None:
        placed = df.select(self.schema.names).withColumn(CHUNK, self.number())
        # One task for each chunk and a bounded number of tasks for each of the busiest, instead of a file from every task in every chunk.
        placed.hint("rebalance", CHUNK).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(CHUNK).parquet(self.path)

    def append(self, df: DataFrame) -> None:
        self._write(df, "append")

    def overwrite(self, df: DataFrame) -> None:
        """Replaces the chunks that ``df`` has rows of; others stay as they are."""
        self._write(df, "overwrite")

    def chunks(self, spark: SparkSession) -> list[int]:
        """The numbers of the chunks that there are, by their folders' names."""
        return sorted(int(n.split("=", 1)[1]) for n in Folder(spark, self.path).names() if n.startswith(f"{CHUNK}="))

    def read(self, spark: SparkSession) -> DataFrame:
        """The table with its chunk numbers; an absent one is empty."""
        whole = T.StructType([*self.schema.fields, T.StructField(CHUNK, T.LongType())])
        return spark.read.schema(whole).parquet(self.path) if self.chunks(spark) else spark.createDataFrame([], whole)

    def only(self, spark: SparkSession, numbers: Iterable[int]) -> DataFrame:
        """The rows of some chunks; no other folder is opened."""
        return self.read(spark).filter(F.col(CHUNK).isin([int(n) for n in numbers]))

    def between(self, spark: SparkSession, start_s: int, end_s: int) -> DataFrame:
        """The rows in [start, end), in seconds of the epoch."""
        near = self.read(spark).filter(F.col(CHUNK).between(start_s // self.seconds, -(-end_s // self.seconds) - 1))
        return near.filter((F.col(self.ts) >= F.timestamp_seconds(F.lit(start_s))) & (F.col(self.ts) < F.timestamp_seconds(F.lit(end_s))))

    def drop(self, spark: SparkSession, numbers: Iterable[int]) -> None:
        folder = Folder(spark, self.path)
        for n in numbers:
            folder.remove(f"{CHUNK}={int(n)}")

    def _edge(self, spark: SparkSession, number: int, keep: Column, more: DataFrame | None = None) -> None:
        """Rewrites the one chunk that a bound cuts through; left alone if it is whole and nothing comes."""
        own = self.only(spark, [number])
        if more is None and own.filter(~keep).isEmpty():
            return
        rows = own.filter(keep).select(self.schema.names)
        held = stored(rows if more is None else rows.unionByName(more), "edge")
        if held.isEmpty():
            self.drop(spark, [number])
        else:
            self.overwrite(held)
        discard(held)

    def drop_before(self, spark: SparkSession, edge_s: int) -> int:
        """Retention: chunks that end by ``edge_s`` go as folders; of the chunk that it falls into, only younger rows stay.
        Returns the number of chunks that went whole."""
        there, number = self.chunks(spark), edge_s // self.seconds
        old = [n for n in there if n < number]
        self.drop(spark, old)
        if number in there and edge_s % self.seconds:
            self._edge(spark, number, F.col(self.ts) >= F.timestamp_seconds(F.lit(edge_s)))
        return len(old)

    def replace_from(self, spark: SparkSession, new: DataFrame, edge_s: int) -> None:
        """The rows from ``edge_s`` on are replaced by those of ``new``; older chunks aren't opened.  ``new`` may be made from this table."""
        edge, number = F.timestamp_seconds(F.lit(edge_s)), edge_s // self.seconds
        fresh = stored(new.filter(F.col(self.ts) >= edge).select(self.schema.names), "fresh")
        there = [r[0] for r in fresh.select(self.number().alias("n")).distinct().collect()]
        self.drop(spark, [n for n in self.chunks(spark) if n > number and n not in there])
        later = [n for n in there if n > number]
        if later:
            self.overwrite(fresh.filter(self.number() > number))
        if number in there or number in self.chunks(spark):
            self._edge(spark, number, F.col(self.ts) < edge, fresh.filter(self.number() == number))
        discard(fresh)


@dataclass(frozen=True)
class Rollup:
    """``table``, made from ``facts`` by ``build``, one chunk for each bucket; ``log`` is the folder of what is out of date."""

    facts: Chunked
    table: Chunked
    build: Callable[[DataFrame], DataFrame]
    log: str

    def _note(self, buckets: DataFrame, state: str) -> str:
        name = f"{state}-{uuid.uuid4().hex}"
        buckets.select("bucket").distinct().coalesce(1).write.parquet(f"{self.log}/{name}")
        return name

    def append(self, rows: DataFrame) -> None:
        """Adds facts; their buckets are out of date from then on."""
        spark, own = rows.sparkSession, stored(rows.select(self.facts.schema.names), "rows")
        entry = self._note(own.select(self.table.number(self.facts.ts).alias("bucket")), "pending")
        self.facts.append(own)
        Folder(spark, self.log).rename(entry, entry.replace("pending", "ready"))
        discard(own)

    def _entries(self, spark: SparkSession) -> list[str]:
        return [n for n in Folder(spark, self.log).names() if n.split("-")[0] in ("pending", "ready")]

    def dirty(self, spark: SparkSession, entries: list[str] | None = None) -> list[int]:
        """The buckets that are out of date.  There are at most as many as the rollup has buckets, and no more than ``MOST_BUCKETS``."""
        entries = self._entries(spark) if entries is None else entries
        if not entries:
            return []
        found = spark.read.schema("bucket long").parquet(*[f"{self.log}/{n}" for n in entries]).distinct().limit(MOST_BUCKETS + 1).collect()
        if len(found) > MOST_BUCKETS:
            raise ValueError("too many buckets for one refresh; refresh a window at a time")
        return sorted(r[0] for r in found)

    def source(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """The facts of some buckets, by the chunks that they lie in."""
        a, b = self.table.seconds, self.facts.seconds
        numbers = sorted({n for k in buckets for n in range(k * a // b, -(-(k + 1) * a // b))})
        return self.facts.only(spark, numbers).filter(self.table.number(self.facts.ts).isin(buckets)).drop(CHUNK)

    def refresh(self, spark: SparkSession, start_s: int | None = None, end_s: int | None = None) -> list[int]:
        """Computes what is out of date anew, and nothing else; within [start, end) if given, whole buckets only.  Returns the buckets.

        Entries whose facts are still being written are used and stay.  A refresh that is repeated gives the same table.
        """
        folder, entries = Folder(spark, self.log), self._entries(spark)
        dirty, size = self.dirty(spark, entries), self.table.seconds
        inside = lambda k: (start_s is None or k * size >= start_s) and (end_s is None or (k + 1) * size <= end_s)
        now = [k for k in dirty if inside(k)]
        if now:
            made = stored(self.build(self.source(spark, now)).select(self.table.schema.names), "buckets")
            self.table.overwrite(made)
            full = {r[0] for r in made.select(self.table.number().alias("n")).distinct().collect()}
            self.table.drop(spark, [k for k in now if k not in full])  # facts that have gone
            discard(made)
        rest = [k for k in dirty if not inside(k)]
        if rest and now:
            self._note(spark.createDataFrame([(k,) for k in rest], "bucket long"), "ready")
        if now or not rest:
            for name in entries:
                if name.startswith("ready"):
                    folder.remove(name)
        return now
