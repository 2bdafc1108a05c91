"""Windowed metrics over vehicle telemetry.

Telemetry has ``vehicle_id, route_id, direction_id, latitude, longitude, epoch_s`` (seconds), ``event_time`` and optionally
``event_id`` as a tie-break.  The same column expressions serve batch frames and streams wherever streams allow them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X

RD = ("route_id", "direction_id")



def _tumbling(df: DataFrame, seconds: int, *aggs: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by UTC-aligned window and route direction; the bucket is arithmetic, so it is no time-window operator."""
    out = df.groupBy(X.bucket("event_time", seconds).alias("window_start"), *RD, *extra).agg(*aggs)
    return out.withColumn("window_end", F.timestamp_seconds(X.epoch("window_start") + seconds))


def telemetry_freshness(df: DataFrame, as_of: Column) -> DataFrame:
    """One-minute feed freshness: distinct vehicles and the age of their reports at ``as_of`` (epoch seconds)."""
    age = X.telemetry_age(as_of, "epoch_s")
    return _tumbling(
        df.withColumn("age", age),
        60,
        F.count_distinct("vehicle_id").alias("vehicle_count"),
        F.avg("age").alias("avg_freshness_sec"),
        F.max("age").alias("max_freshness_sec"),
        F.min("age").alias("min_freshness_sec"),
        F.percentile("age", 0.95).alias("p95_freshness_sec"),
    )


def bunching_events(df: DataFrame, cfg: TransitConfig = DEFAULT, max_distance_m: float | None = None) -> DataFrame:
    """Pairs of vehicles of one route direction that report within ``bunching_join_s`` of each other.

    The interval condition becomes an equality: one side falls into the bucket of its time, the other is repeated for that bucket
    and its two neighbours.  Each pair meets exactly once, a route's day is spread over many join keys, and rows with a null
    direction never match.
    """
    span = cfg.bunching_join_s
    cols = ["vehicle_id", *RD, "latitude", "longitude", "epoch_s"]
    a = df.select(*cols, F.floor(F.col("epoch_s") / span).alias("b"))
    near = F.explode(F.array(*[F.floor(F.col("epoch_s") / span) + d for d in (-1, 0, 1)])).alias("b")
    z = df.select(*[F.col(c).alias(f"z_{c}") for c in cols], near)
    gap = F.abs(F.col("epoch_s") - F.col("z_epoch_s"))
    pairs = a.join(
        z,
        (a["b"] == z["b"])
        & (F.col("route_id") == F.col("z_route_id"))
        & (F.col("direction_id") == F.col("z_direction_id"))
        & (F.col("vehicle_id") < F.col("z_vehicle_id"))
        & (gap <= span)
        & (gap < cfg.bunching_s),
    )
    out = pairs.select(
        F.timestamp_seconds("epoch_s").alias("event_time"),
        *RD,
        F.col("vehicle_id").alias("vehicle_a_id"),
        F.col("z_vehicle_id").alias("vehicle_b_id"),
        gap.cast("double").alias("gap_seconds"),
        F.col("latitude").alias("lat_a"),
        F.col("longitude").alias("lon_a"),
        F.col("z_latitude").alias("lat_b"),
        F.col("z_longitude").alias("lon_b"),
    )
    return out if max_distance_m is None else out.filter(X.equirect_distance_m("lat_a", "lon_a", "lat_b", "lon_b") <= max_distance_m)


def service_gap_window(df: DataFrame, threshold_s: float = 600, window_s: int = 600, max_vehicles: int = 1) -> DataFrame:
    """Windows in which at most ``max_vehicles`` vehicles served a route direction over more than ``threshold_s``."""
    span = (F.max("epoch_s") - F.min("epoch_s")).cast("double")
    out = _tumbling(df, window_s, F.min("event_time").alias("gap_start"), F.max("event_time").alias("gap_end"), span.alias("gap_duration_sec"), F.count_distinct("vehicle_id").alias("vehicles"))
    return out.filter((F.col("vehicles") <= max_vehicles) & (F.col("gap_duration_sec") > threshold_s)).select("gap_start", "gap_end", *RD, "gap_duration_sec")


def service_gap_between_events(df: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Consecutive sightings on a route direction that lie further apart than the threshold.

    Sightings are first reduced to the earliest and latest per time bucket of the threshold's length, so that the ordered pass over
    a busy route sees at most two rows per bucket; no gap longer than the threshold can lie inside a bucket.
    """
    b = F.floor(F.col("epoch_s") / cfg.service_gap_s)
    ends = df.groupBy(*RD, b.alias("b")).agg(F.min("epoch_s").alias("lo"), F.max("epoch_s").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy(*RD).orderBy("b"))
    gaps = ends.withColumn("before", before).filter(F.col("lo") - F.col("before") > cfg.service_gap_s)
    return gaps.select(F.timestamp_seconds("before").alias("gap_start"), F.timestamp_seconds("lo").alias("gap_end"), *RD, (F.col("lo") - F.col("before")).cast("double").alias("gap_duration_sec"))


def consecutive_fix_lag(df: DataFrame) -> DataFrame:
    """Valid segments between a vehicle's consecutive fixes: 5 s < dt < 300 s and 0 < speed < 120 km/h."""
    tie = ["event_id"] if "event_id" in df.columns else []
    w = Window.partitionBy("vehicle_id").orderBy("epoch_s", *tie)
    prev = {c: F.lag(c).over(w).alias(f"prev_{c}") for c in ("latitude", "longitude", "epoch_s")}
    seg = df.select("*", *prev.values()).withColumn("dt", F.col("epoch_s") - F.col("prev_epoch_s"))
    seg = seg.withColumn("speed_kmh", X.segment_speed_kmh("prev_latitude", "prev_longitude", "latitude", "longitude", "dt"))
    return seg.filter("dt > 5 and dt < 300 and speed_kmh > 0 and speed_kmh < 120")


def segment_speed(df: DataFrame, window_s: int = 900) -> DataFrame:
    """Segment speeds by window and route direction; ``vehicle_count`` counts segments."""
    return _tumbling(
        consecutive_fix_lag(df),
        window_s,
        F.count(F.lit(1)).alias("vehicle_count"),
        F.avg("speed_kmh").alias("avg_speed_kmh"),
        F.min("speed_kmh").alias("min_speed_kmh"),
        F.max("speed_kmh").alias("max_speed_kmh"),
    )


def live_fleet(df: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """The latest fix of every vehicle seen in the last ``seconds``; a partially aggregated maximum, not a sort."""
    rest = [c for c in df.columns if c not in ("vehicle_id", "event_time", "event_id")]
    order = F.struct("event_time", *(["event_id"] if "event_id" in df.columns else []))
    recent = X.recent_filter(df, "event_time", as_of, seconds)
    last = recent.groupBy("vehicle_id").agg(F.max_by(F.struct("event_time", *rest), order).alias("f"))
    return last.select("vehicle_id", "f.*")


def daily_fleet(df: DataFrame) -> DataFrame:
    return df.groupBy(X.bucket("event_time", 86400).alias("bucket")).agg(
        F.count_distinct("vehicle_id").alias("unique_vehicles"), F.count_distinct("route_id").alias("unique_routes"), F.count(F.lit(1)).alias("total_position_reports")
    )


def session_presence(df: DataFrame, gap_s: int = 600) -> DataFrame:
    """Presence sessions of a route direction: sightings no further apart than ``gap_s``."""
    w = F.session_window("event_time", f"{gap_s} seconds")
    out = df.groupBy(w.alias("w"), *RD).agg(F.count(F.lit(1)).alias("reports"), F.max("event_time").alias("last_seen"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *RD, "reports", "last_seen")
