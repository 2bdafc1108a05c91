"""Feature windows: seven rollups by window and route direction, joined null-safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X

RD = ("route_id", "direction_id")


def _rollup(df: DataFrame, ts: str, seconds: int, *aggs: Column) -> DataFrame:
    return df.groupBy(X.bucket(ts, seconds).alias("feature_time"), *RD).agg(*aggs)


def delay_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(
        df, "window_start", s, F.sum("vehicle_count").alias("vehicle_count"), F.count(F.lit(1)).alias("observation_count"),
        F.avg("avg_delay_sec").alias("avg_delay_sec"), F.avg("p95_delay_sec").alias("p95_delay_sec"), F.max("max_delay_sec").alias("max_delay_sec"),
    )


def speed_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(df, "window_start", s, F.avg("avg_speed_kmh").alias("avg_speed_kmh"), F.min("min_speed_kmh").alias("min_speed_kmh"))


def bunching_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(df, "event_time", s, F.count(F.lit(1)).alias("bunching_count"))


def gap_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(df, "gap_start", s, F.count(F.lit(1)).alias("service_gap_count"), F.sum("gap_duration_sec").alias("total_gap_sec"))


def dwell_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(df, "window_start", s, F.avg("avg_dwell_sec").alias("avg_dwell_sec"))


def freshness_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(df, "window_start", s, F.avg("avg_freshness_sec").alias("avg_freshness_sec"))


def hotspot_rollup(df: DataFrame, s: int = 900) -> DataFrame:
    return _rollup(df, "window_start", s, F.avg("hotspot_score").alias("hotspot_score"))


def join_null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on (feature_time, route_id, direction_id), null directions being equal."""
    r = right
    for k in ("feature_time", *RD):
        r = r.withColumnRenamed(k, f"_{k}")
    same = (F.col("feature_time") == F.col("_feature_time")) & (F.col("route_id") == F.col("_route_id")) & F.col("direction_id").eqNullSafe(F.col("_direction_id"))
    return left.join(r, same, "left").drop("_feature_time", "_route_id", "_direction_id")


def feature_windows(delay: DataFrame, speed: DataFrame, bunching: DataFrame, gaps: DataFrame, dwell: DataFrame, freshness: DataFrame, hotspots: DataFrame, routes: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """The 24 feature columns of every window that has delay (``generated_at`` is the caller's)."""
    s = cfg.feature_window_s
    f = delay_rollup(delay, s)
    for more in (speed_rollup(speed, s), bunching_rollup(bunching, s), gap_rollup(gaps, s), dwell_rollup(dwell, s), freshness_rollup(freshness, s), hotspot_rollup(hotspots, s)):
        f = join_null_safe(f, more)
    f = f.join(routes.select("route_id", F.col("route_type").alias("route_type")), "route_id", "left")
    cal = X.calendar_features("feature_time", cfg.timezone)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return f.select(
        "feature_time", *RD, F.lit("network").alias("zone_id"), "route_type", *[v.alias(k) for k, v in cal.items()], "vehicle_count", "observation_count",
        "avg_delay_sec", "p95_delay_sec", "max_delay_sec", "avg_speed_kmh", "min_speed_kmh", X.speed_drop("avg_speed_kmh").alias("speed_drop_kmh"),
        zero("bunching_count").alias("bunching_count"), zero("service_gap_count").alias("service_gap_count"), F.coalesce("total_gap_sec", F.lit(0.0)).alias("total_gap_sec"),
        "avg_dwell_sec", F.coalesce("hotspot_score", F.lit(0.0)).alias("hotspot_score"), "avg_freshness_sec",
    )
