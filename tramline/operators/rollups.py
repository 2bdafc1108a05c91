"""Hourly and daily rollups, and the aggregates that read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import exprs as X

RD = ("route_id", "direction_id")
HOUR, DAY = 3600, 86400


def _by(df: DataFrame, ts: str, seconds: int, *aggs: Column) -> DataFrame:
    return df.groupBy(X.bucket(ts, seconds).alias("bucket"), *RD).agg(*aggs)


def hourly_delay(m: DataFrame) -> DataFrame:
    return _by(m, "window_start", HOUR, F.sum("vehicle_count").alias("total_observations"), F.avg("avg_delay_sec").alias("avg_delay_sec"), F.max("max_delay_sec").alias("max_delay_sec"), F.min("min_delay_sec").alias("min_delay_sec"))


def daily_delay(m: DataFrame) -> DataFrame:
    return _by(m, "window_start", DAY, F.sum("vehicle_count").alias("total_observations"), F.avg("avg_delay_sec").alias("avg_delay_sec"), F.max("max_delay_sec").alias("peak_delay_sec"), F.min("min_delay_sec").alias("min_delay_sec"))


def hourly_bunching(b: DataFrame) -> DataFrame:
    return _by(b, "event_time", HOUR, F.count(F.lit(1)).alias("bunching_count"), F.avg("gap_seconds").alias("avg_gap_seconds"), F.min("gap_seconds").alias("min_gap_seconds"))


def hourly_speed(s: DataFrame) -> DataFrame:
    return _by(s, "window_start", HOUR, F.sum("vehicle_count").alias("total_observations"), F.avg("avg_speed_kmh").alias("avg_speed_kmh"), F.min("min_speed_kmh").alias("min_speed_kmh"), F.max("max_speed_kmh").alias("max_speed_kmh"))


def hourly_reliability(g: DataFrame) -> DataFrame:
    d = "gap_duration_sec"
    return _by(g, "gap_start", HOUR, F.count(F.lit(1)).alias("gap_count"), F.sum(d).alias("total_gap_sec"), F.avg(d).alias("avg_gap_sec"), F.max(d).alias("max_gap_sec"))


def delay_by_hour_of_day(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(F.hour("bucket").alias("hour_of_day"), *RD).agg(F.avg("avg_delay_sec").alias("avg_delay_sec"), F.max("max_delay_sec").alias("max_delay_sec"), F.sum("total_observations").alias("total_observations"))


def delay_by_route_type(hourly: DataFrame, routes: DataFrame) -> DataFrame:
    j = hourly.join(routes.select("route_id", "route_type"), "route_id")
    return j.groupBy("route_type", X.route_type_label("route_type").alias("route_type_label")).agg(
        F.avg("avg_delay_sec").alias("avg_delay_sec"), F.max("max_delay_sec").alias("max_delay_sec"), F.sum("total_observations").alias("total_observations")
    )


def root_cause_join(delay: DataFrame, speed: DataFrame, bunching: DataFrame, gaps: DataFrame, routes: DataFrame) -> DataFrame:
    """Hourly delay with that hour's speed, bunching and gaps; directions match by plain equality."""
    keys = ["bucket", *RD]
    j = delay.select(*keys, "avg_delay_sec", "max_delay_sec").join(speed.select(*keys, "avg_speed_kmh"), keys, "left")
    j = j.join(bunching.select(*keys, "bunching_count"), keys, "left").join(gaps.select(*keys, "gap_count", "total_gap_sec"), keys, "left")
    return j.join(routes.select("route_id", "route_short_name", "route_type"), "route_id", "left")


def root_cause_hourly(delay: DataFrame, speed: DataFrame, bunching: DataFrame, gaps: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    j = X.recent_filter(root_cause_join(delay, speed, bunching, gaps, routes), "bucket", as_of, 30 * DAY)
    return j.select(
        "bucket", *RD, "route_short_name", "route_type", X.display_round("avg_delay_sec", 1).alias("avg_delay_sec"), X.display_round("max_delay_sec", 1).alias("max_delay_sec"),
        X.display_round("avg_speed_kmh", 1).alias("avg_speed_kmh"), F.coalesce("bunching_count", F.lit(0)).alias("bunching_count"), F.coalesce("gap_count", F.lit(0)).alias("service_gap_count"),
        X.display_round("total_gap_sec", 1).alias("total_gap_sec"), X.associated_factor("avg_delay_sec", "avg_speed_kmh", "bunching_count", "gap_count").alias("associated_factor"),
    )


def fleet_kpis(positions: DataFrame, delay: DataFrame, speed: DataFrame, bunching: DataFrame, gaps: DataFrame, as_of: Column) -> DataFrame:
    """One row of six figures over their own recency windows: six one-row aggregates side by side."""
    near = lambda df, ts, s: X.recent_filter(df, ts, as_of, s)
    one = [
        near(positions, "event_time", 300).agg(F.count_distinct("vehicle_id").alias("active_vehicles"), F.count_distinct("route_id").alias("active_routes")),
        near(delay, "window_start", 900).agg(X.display_round(F.avg("avg_delay_sec"), 1).alias("avg_network_delay_sec")),
        near(speed, "window_start", 1800).agg(X.display_round(F.avg("avg_speed_kmh"), 1).alias("avg_network_speed_kmh")),
        near(bunching, "event_time", 1800).agg(F.count(F.lit(1)).alias("bunching_events_30m")),
        near(gaps, "gap_start", 3600).agg(F.count(F.lit(1)).alias("service_gaps_60m")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), one)  # each side is a single row


def distinct_route_types(routes: DataFrame) -> DataFrame:
    return routes.select("route_type", X.route_type_label("route_type").alias("route_type_label"), "route_id", "route_short_name").distinct().orderBy("route_type", "route_short_name")
