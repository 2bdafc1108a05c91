"""Sketches of windows with far more values than they hold, merged from minutes that come in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import sketches

SECONDS = "event_time"


def test_merged_sketches_stay_within_their_bounds(spark):
    rows = spark.range(120_000).select(
        F.timestamp_seconds(F.lit(3600 * 5) + F.col("id") % 7200).alias(SECONDS), F.concat(F.lit("v"), F.xxhash64("id") % 9000).alias("vehicle_id"), F.lit("r").alias("route_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(1)).cast("int").alias("direction_id"), F.when(F.col("id") % 50 != 7, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100_000)) ** 2).alias("v"),
    )
    part = lambda k: rows.filter(F.pmod(F.xxhash64("vehicle_id"), F.lit(4)) == k)
    parts = [sketches.minute_states(part(k), SECONDS, "v", "vehicle_id") for k in range(4)]
    minutes = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    hours = sketches.estimates(sketches.merged(minutes, 3600))
    out = sketches.checked(hours, rows, SECONDS, "v", "vehicle_id", 3600).collect()
    assert len(out) == 4 and all(r["quantile_within"] and r["count_within"] for r in out)
    exact = rows.filter("v is not null").groupBy(F.date_trunc("hour", SECONDS).alias("bucket"), "direction_id").agg(F.count("v").alias("n"), F.max("v").alias("high")).collect()
    assert sorted((r["observations"], r["max"]) for r in out) == sorted((r["n"], r["high"]) for r in exact)


def test_small_windows_are_exact_and_nulls_are_left_out(spark):
    rows = spark.createDataFrame([(1, "a", "r", None, 5.0), (2, "b", "r", None, 7.0), (3, None, "r", None, None), (4, "a", "r", None, 9.0)], "s long, vehicle_id string, route_id string, direction_id int, v double")
    out = sketches.estimates(sketches.minute_states(rows.withColumn("t", F.timestamp_seconds("s")), "t", "v", "vehicle_id"), 0.5).collect()
    assert [(r["observations"], r["vehicle_count"], r["avg"], r["max"], r["min"], r["quantile"]) for r in out] == [(3, 2, 7.0, 9.0, 5.0, 7.0)]
    assert sketches.estimates(sketches.minute_states(rows.limit(0).withColumn("t", F.timestamp_seconds("s")), "t", "v", "vehicle_id")).count() == 0
