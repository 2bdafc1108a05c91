"""Column expressions on hand-made edge rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramline.config import DEFAULT
from tramline.functions import exprs as X


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_gtfs_time(spark):
    rows = [("00:00:00",), ("13:48:05",), ("25:30:00",), (None,), ("",), ("13:48",), ("bad:value:00",)]
    assert values(spark, rows, "t string", X.gtfs_time_to_seconds("t")) == [0, 49685, 91800, None, None, None, None]


def test_gtfs_date(spark):
    rows = [("20240229",), ("2024-03-01",), ("",), (None,), ("20241399",)]
    assert values(spark, rows, "t string", X.gtfs_date_parse("t")) == [dt.date(2024, 2, 29), dt.date(2024, 3, 1), None, None, None]


def test_risk_and_labels(spark):
    rows = [(100.0,), (200.0,), (299.0,), (300.0,), (600.0,)]
    assert values(spark, rows, "d double", X.risk_level("d")) == ["low", "medium", "medium", "high", "critical"]
    assert values(spark, rows, "d double", X.high_delay_label("d")) == [0, 0, 0, 1, 1]


def test_warm_start_worked_example(spark):
    row = spark.createDataFrame(
        [(120.0, 240.0, 300.0, 8.0, 1, 0, 0.5, 20.0)], "avg_delay_sec double, p95_delay_sec double, max_delay_sec double, speed_drop_kmh double, bunching_count int, service_gap_count int, hotspot_score double, avg_freshness_sec double"
    )
    assert X.normalize_features(row).select(X.warm_start_score()).first()[0] == pytest.approx(233.0)


def test_normalize_fills(spark):
    row = spark.createDataFrame([(4, True)], "vehicle_count int, is_weekend boolean")
    got = X.normalize_features(row).first()
    assert len(got) == 20 and got["vehicle_count"] == 4.0 and got["is_weekend"] == 1.0 and got["avg_delay_sec"] == 0.0


def test_daylight_saving(spark):
    rows = [("2024-03-31", 10 * 3600), ("2024-10-27", 10 * 3600), ("2024-01-01", 91800)]
    e = F.unix_timestamp(X.scheduled_instant(F.col("d").cast("date"), F.col("s"), "Europe/Bucharest"))
    want = [int(dt.datetime(2024, 3, 31, 7, tzinfo=dt.UTC).timestamp()), int(dt.datetime(2024, 10, 27, 8, tzinfo=dt.UTC).timestamp()), int(dt.datetime(2024, 1, 1, 23, 30, tzinfo=dt.UTC).timestamp())]
    assert values(spark, rows, "d string, s int", e) == want


def test_clamp_delay(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (-500.0,), (0.5,), (1.5,), (9999.0,)]
    assert values(spark, rows, "d double", X.clamp_delay("d")) == [0, 0, 0, -120, 0, 2, 1800]


def test_locations(spark):
    rows = [("loc:44.4,26.1",), ("loc:50,26",), ("stop:1",), ("loc:a,b",), (None,)]
    got = values(spark, rows, "t string", X.parse_location_id("t"))
    assert got[0]["lat"] == 44.4 and got[1:] == [None] * 4


def test_bbox_refused(spark):
    with pytest.raises(ValueError):
        X.bbox_filter(spark.range(1).select(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")), -91, 0, 0, 0)


def test_bands_and_labels(spark):
    rows = [(0,), (3,), (11,), (5,)]
    assert values(spark, rows, "t int", X.route_type_label("t")) == ["Tram", "Bus", "Trolleybus", "Other (5)"]
    assert values(spark, [(5,), (99,), (None,)], "t int", X.planner_route_type_label("t")) == ["cable tram", "type 99", "unknown"]
    assert values(spark, [(None,), (60.0,), (500.0,)], "d double", X.freshness_status_band("d")) == ["healthy", "degraded", "stale"]


def test_defaults():
    assert (DEFAULT.watermark_s, DEFAULT.geofence_m, DEFAULT.bunching_s, DEFAULT.horizon_minutes, DEFAULT.high_delay_s) == (15, 75.0, 120, 30, 300.0)
