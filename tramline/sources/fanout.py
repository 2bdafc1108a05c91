"""Sinks for micro-batches that may come twice: one read for many sinks, and keyed merges into a database.

A micro-batch is repeated after a failure with the same number and the same rows.  A sink that has taken a batch says so in a ledger or in
the transaction itself, so that the repetition leaves no second copy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from tramline.sources.chunks import Folder

Sink = Callable[[DataFrame, int], None]


class Ledger:
    """Which sinks have taken which batches: one empty file each, so that marking is a single step on any storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, sink: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{sink}")

    def done(self, sink: str) -> set[int]:
        return {int(n) for n in self._folder(sink).names() if n.isdigit()}

    def mark(self, sink: str, batch_id: int) -> None:
        folder = self._folder(sink)
        folder.fs.create(folder._path(folder.base, str(batch_id)), True).close()

    def forget_before(self, sink: str, batch_id: int) -> None:
        """Old marks go: only the last batch can be repeated."""
        folder = self._folder(sink)
        for n in folder.names():
            if n.isdigit() and int(n) < batch_id:
                folder.remove(n)


def fan_out(makers: dict[str, tuple[Callable[[DataFrame], DataFrame], Sink]], ledger: str) -> Sink:
    """A ``foreachBatch`` function that reads a batch once and hands each sink its own form of it.

    ``makers`` maps a sink's name to what it makes of the batch and where that goes.  A sink that has taken the batch before is
    passed over.  If one fails, the others still get theirs; then the first error is raised, and the repeated batch goes to that one
    alone.  The sinks' own writes must be repeatable, since a failure can fall between a write and its mark: ``owned_folder`` and ``jdbc_merge`` are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        book = Ledger(batch.sparkSession, ledger)
        todo = {name: own for name, own in makers.items() if batch_id not in book.done(name)}
        if not todo:
            return
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)  # a lost block is read again from the source
        failed: Exception | None = None
        try:
            for name, (make, sink) in todo.items():
                try:
                    sink(make(held), batch_id)
                    book.mark(name, batch_id)
                    book.forget_before(name, batch_id - 1)
                except Exception as e:  # noqa: BLE001
                    failed = failed or e
        finally:
            held.unpersist()
        if failed is not None:
            raise failed

    return write


def owned_folder(path: str) -> Sink:
    """Parquet in which each batch owns a folder and replaces it when it comes again."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@contextmanager
def _connection(spark: SparkSession, url: str, driver: str, **properties) -> Iterator:
    jvm = spark._jvm
    own = jvm.java.util.Properties()
    for k, v in properties.items():
        own.setProperty(k, str(v))
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)  # also finds drivers that came with --jars
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    connection.setAutoCommit(False)
    try:
        yield connection
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def jdbc_merge(url: str, table: str, keys: tuple[str, ...], driver: str, update: bool = True, batch: int = 500, text: str = "varchar(255)", nullable: tuple[str, ...] = (), **properties) -> Sink:
    """A ``foreachBatch`` function that merges micro-batches into a table by key.

    Executors write the batch into a staging table of its own number, which a repetition replaces.  One transaction then merges it: known
    keys are updated (or left, without ``update``), new ones inserted, the staging table dropped.  In ``nullable`` keys nulls are equal; the others are
    compared plainly, so that an index serves.  The batch may hold a key once.
    Texts are staged as ``text``, since many databases can't compare the long ones.  The target must exist; a unique index on its keys guards it against other writers.
    """
    for name in (table, *keys, *nullable):
        if not NAME.fullmatch(name):
            raise ValueError(f"not a plain name: {name}")

    def write(df: DataFrame, batch_id: int) -> None:
        spark, stage = df.sparkSession, f"{table}_batch_{batch_id}"
        if bad := [c for c in df.columns if not NAME.fullmatch(c)]:
            raise ValueError(f"not plain names: {bad}")
        options = {"url": url, "driver": driver, "batchsize": str(batch), **properties}
        kinds = ", ".join(f"{c} {text}" for c, kind in df.dtypes if kind == "string")
        if kinds:
            options["createTableColumnTypes"] = kinds
        df.write.format("jdbc").mode("overwrite").options(dbtable=stage, **options).save()
        rest = [c for c in df.columns if c not in keys]
        quoted = lambda c: f'"{c}"'
        same = " and ".join(f"(t.{c} = s.{quoted(c)} or (t.{c} is null and s.{quoted(c)} is null))" if c in nullable else f"t.{c} = s.{quoted(c)}" for c in keys)
        sets = f"when matched then update set {', '.join(f'{c} = s.{quoted(c)}' for c in rest)}" if update and rest else ""
        merge = f"merge into {table} t using {stage} s on {same} {sets} when not matched then insert ({', '.join(df.columns)}) values ({', '.join('s.' + quoted(c) for c in df.columns)})"
        with _connection(spark, url, driver, **properties) as c:
            statement = c.createStatement()
            statement.executeUpdate(merge)
            statement.executeUpdate(f"drop table {stage}")

    return write
