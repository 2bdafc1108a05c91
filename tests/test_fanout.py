"""Repeated micro-batches: one copy in every sink."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tramline.sources import fanout
from tramline.streaming import stream

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_a_failed_sink_alone_is_retried_and_nothing_doubles(spark, tmp_path):
    taken, broken = [], [True]

    def flaky(df, batch_id):
        if batch_id == 1 and broken[0]:
            raise OSError("gone")
        fanout.owned_folder(str(tmp_path / "flaky"))(df, batch_id)

    def good(df, batch_id):
        taken.append(batch_id)
        fanout.owned_folder(str(tmp_path / "good"))(df, batch_id)

    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "long")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("id", count.asNondeterministic()("id"))
    write = fanout.fan_out({"flaky": (lambda b: b.filter("id % 2 = 0"), flaky), "good": (lambda b: b, good), "sums": (lambda b: b.agg(F.sum("id").alias("s")), fanout.owned_folder(str(tmp_path / "sums")))}, str(tmp_path / "ledger"))
    with pytest.raises(Exception, match="gone"):
        stream.foreach_batch(source, write, str(tmp_path / "checkpoint")).awaitTermination()
    assert taken == [0, 1], "the others had theirs before the error"
    broken[0] = False
    stream.foreach_batch(source, write, str(tmp_path / "checkpoint")).awaitTermination()
    assert taken == [0, 1, 2], "a batch that was taken is not handed over again"
    rows = lambda name: sorted(r[0] for r in spark.read.parquet(str(tmp_path / name)).select("id").collect())
    assert rows("good") == list(range(30)) and rows("flaky") == list(range(0, 30, 2))
    assert sorted(r["s"] for r in spark.read.parquet(str(tmp_path / "sums")).collect()) == [45, 145, 245]
    assert seen.value == 40, "each batch is read once for all sinks, the failed one a second time for the sink that lacked it"
    assert fanout.Ledger(spark, str(tmp_path / "ledger")).done("good") == {1, 2}


@pytest.fixture
def table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with fanout._connection(spark, url, DERBY) as c:
        s = c.createStatement()
        s.executeUpdate("create table delays (route_id varchar(20), direction_id int, delay double)")
        s.executeUpdate("create unique index delays_key on delays (route_id, direction_id)")
    read = lambda: sorted(map(tuple, spark.read.format("jdbc").options(url=url, dbtable="delays", driver=DERBY).load().collect()), key=str)
    return url, read


def frame(spark, rows):
    return spark.createDataFrame(rows, "route_id string, direction_id int, delay double")


def test_merge_twice_leaves_one_copy(spark, table):
    url, read = table
    write = fanout.jdbc_merge(url, "delays", ("route_id", "direction_id"), DERBY, nullable=("direction_id",))
    batch = frame(spark, [("1", 0, 10.0), ("1", None, 20.0), ("2", 1, 30.0)])
    write(batch, 0)
    write(batch, 0)
    assert read() == sorted([("1", 0, 10.0), ("1", None, 20.0), ("2", 1, 30.0)], key=str)
    write(frame(spark, [("1", None, 21.0), ("3", 0, 40.0)]), 1)
    assert read() == sorted([("1", 0, 10.0), ("1", None, 21.0), ("2", 1, 30.0), ("3", 0, 40.0)], key=str)
    fanout.jdbc_merge(url, "delays", ("route_id", "direction_id"), DERBY, nullable=("direction_id",), update=False)(frame(spark, [("1", 0, 99.0), ("4", 0, 50.0)]), 2)
    assert ("1", 0, 10.0) in read() and ("4", 0, 50.0) in read() and len(read()) == 5


def test_a_merge_that_fails_leaves_the_table_as_it_was(spark, table):
    url, read = table
    write = fanout.jdbc_merge(url, "delays", ("route_id", "direction_id"), DERBY, nullable=("direction_id",))
    write(frame(spark, [("1", 0, 10.0)]), 0)
    with pytest.raises(Exception, match="(?i)duplicate|unique|merge"):
        write(frame(spark, [("1", 0, 11.0), ("5", 0, 1.0), ("5", 0, 2.0)]), 1)
    assert read() == [("1", 0, 10.0)]
    write(frame(spark, [("1", 0, 11.0), ("5", 0, 1.0)]), 1)
    assert read() == [("1", 0, 11.0), ("5", 0, 1.0)]
    with pytest.raises(ValueError):
        fanout.jdbc_merge(url, "delays; drop table delays", ("route_id",), DERBY)
