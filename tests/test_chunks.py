"""Chunked tables and rollups: pruning, retention, invalidation and refresh, on small tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tramline.operators import rollups
from tramline.sources.chunks import CHUNK, Chunked, Rollup

FACT = "id long, window_start timestamp, route_id string, direction_id int, vehicle_count long, avg_delay_sec double, max_delay_sec double, min_delay_sec double"
HOUR = 3600


def facts(spark, rows):
    """Rows of (id, seconds, route)."""
    full = [(k, s, r, 0, 1, float(s % 7), float(s % 11), float(s % 5)) for k, s, r in rows]
    return spark.createDataFrame(full, FACT.replace("timestamp", "long")).withColumn("window_start", F.timestamp_seconds("window_start"))


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


@pytest.fixture
def rollup(spark, tmp_path):
    own = Chunked(str(tmp_path / "facts"), schema_of(spark, FACT), "window_start", HOUR)
    made = "bucket timestamp, route_id string, direction_id int, total_observations long, avg_delay_sec double, max_delay_sec double, min_delay_sec double"
    return Rollup(own, Chunked(str(tmp_path / "hourly"), schema_of(spark, made), "bucket", HOUR), rollups.hourly_delay, str(tmp_path / "log"))


def files(path, number=None):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if number is None or f"{CHUNK}={number}/" in str(p)}


def rows(df):
    return sorted(map(str, df.drop(CHUNK).collect()))


def spoil(path, number):
    """A chunk that can't be read: whatever opens it fails."""
    for p in files(path, number):
        Path(p).write_bytes(b"not parquet")


def test_rollup_follows_late_facts(spark, rollup):
    first = [(k, h * HOUR + k * 60, f"r{k % 2}") for h in range(5) for k in range(6)]
    rollup.append(facts(spark, first))
    assert rollup.refresh(spark) == [0, 1, 2, 3, 4] and rollup.refresh(spark) == []
    assert rows(rollup.table.read(spark)) == rows(rollups.hourly_delay(facts(spark, first)))
    late = [(90, 1 * HOUR + 5, "r0"), (91, 1 * HOUR + 9, "r9"), (92, 7 * HOUR, "r1")]
    rollup.append(facts(spark, late))
    assert rollup.dirty(spark) == [1, 7]
    before = {n: files(rollup.table.path, n) for n in (0, 2, 3, 4)}
    for n in (0, 2, 3, 4):
        spoil(rollup.facts.path, n)
    assert rollup.refresh(spark) == [1, 7]
    assert rows(rollup.table.read(spark)) == rows(rollups.hourly_delay(facts(spark, first + late)))
    assert {n: files(rollup.table.path, n) for n in before} == before, "clean buckets are not written"
    plan = rollup.source(spark, [1, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [chunk" in plan or "PartitionFilters: [isnotnull(chunk" in plan


def test_refresh_of_a_window_leaves_the_rest_for_later(spark, rollup):
    first = [(h, h * HOUR + 1, "r") for h in range(6)]
    rollup.append(facts(spark, first))
    assert rollup.refresh(spark, 2 * HOUR, 4 * HOUR + 30) == [2, 3], "whole buckets only"
    assert rollup.table.chunks(spark) == [2, 3] and rollup.dirty(spark) == [0, 1, 4, 5]
    assert rollup.refresh(spark, 2 * HOUR, 3 * HOUR) == [] and rollup.dirty(spark) == [0, 1, 4, 5]
    assert rollup.refresh(spark) == [0, 1, 4, 5]
    assert rows(rollup.table.read(spark)) == rows(rollups.hourly_delay(facts(spark, first)))


def test_facts_that_fail_to_arrive_leave_their_bucket_dirty(spark, rollup, monkeypatch):
    rollup.append(facts(spark, [(1, 10, "r")]))
    rollup.refresh(spark)
    with monkeypatch.context() as m:
        m.setattr(Chunked, "append", lambda self, df: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            rollup.append(facts(spark, [(2, HOUR, "r")]))
    assert rollup.refresh(spark) == [1] and rollup.dirty(spark) == [1], "its facts may still come"
    assert rollup.table.chunks(spark) == [0]
    rollup.facts.append(facts(spark, [(2, HOUR, "r")]))
    assert rollup.refresh(spark) == [1] and rollup.table.chunks(spark) == [0, 1]


def test_bucket_without_facts_goes(spark, rollup):
    rollup.append(facts(spark, [(1, 10, "r"), (2, HOUR, "r")]))
    rollup.refresh(spark)
    rollup.facts.drop(spark, [0])
    rollup._note(spark.createDataFrame([(0,)], "bucket long"), "ready")
    assert rollup.refresh(spark) == [0] and rollup.table.chunks(spark) == [1]


def test_daily_buckets_over_hourly_chunks(spark, rollup, tmp_path):
    made = rollup.table.schema.fieldNames()
    kind = schema_of(spark, "bucket timestamp, route_id string, direction_id int, total_observations long, avg_delay_sec double, peak_delay_sec double, min_delay_sec double")
    daily = Rollup(rollup.facts, Chunked(str(tmp_path / "daily"), kind, "bucket", 24 * HOUR), rollups.daily_delay, str(tmp_path / "daily_log"))
    some = [(k, k * 5 * HOUR, f"r{k % 3}") for k in range(20)]
    daily.append(facts(spark, some))
    assert daily.refresh(spark) == [0, 1, 2, 3] and "bucket" in made
    assert rows(daily.table.read(spark)) == rows(rollups.daily_delay(facts(spark, some)))


def test_retention_drops_folders_and_filters_the_edge(spark, rollup):
    table = rollup.facts
    some = [(k, k * 600, "r") for k in range(36)]
    table.append(facts(spark, some))
    for n in (0, 1):
        spoil(table.path, n)
    kept = {n: files(table.path, n) for n in (3, 4, 5)}
    assert table.drop_before(spark, 2 * HOUR + 1800) == 2, "old chunks go unread"
    assert sorted(r["id"] for r in table.read(spark).collect()) == list(range(15, 36))
    assert {n: files(table.path, n) for n in kept} == kept, "kept chunks are not rewritten"
    edge = files(table.path, 2)
    assert table.drop_before(spark, 2 * HOUR + 1800) == 0 and files(table.path, 2) == edge
    assert table.drop_before(spark, 9 * HOUR) == 4 and table.read(spark).count() == 0


def test_between_opens_its_own_chunks(spark, rollup):
    table = rollup.facts
    table.append(facts(spark, [(k, k * 600, "r") for k in range(36)]))
    for n in (0, 1, 4, 5):
        spoil(table.path, n)
    assert sorted(r["id"] for r in table.between(spark, 2 * HOUR + 600, 4 * HOUR).collect()) == list(range(13, 24))


def test_replace_from_rewrites_the_edge_and_what_follows(spark, rollup):
    table = rollup.facts
    table.append(facts(spark, [(k, k * 600, "old") for k in range(36)]))
    old = {n: files(table.path, n) for n in (0, 1)}
    new = table.read(spark).drop(CHUNK).filter("id % 2 = 0").withColumn("route_id", F.lit("new"))
    table.replace_from(spark, new.filter("id < 24 or id >= 30"), 2 * HOUR + 1800)
    got = sorted((r["id"], r["route_id"]) for r in table.read(spark).collect())
    assert got == sorted([(k, "old") for k in range(15)] + [(k, "new") for k in range(16, 36, 2) if k < 24 or k >= 30])
    assert {n: files(table.path, n) for n in old} == old and table.chunks(spark) == [0, 1, 2, 3, 5]
