"""Status views and dashboard reports: filters, label joins, bands and top-k over the metric tables.

Dimension tables are joined plainly: Spark broadcasts them below its size threshold and shuffles them above it.  Views and series are
tables, whose order is the reader's to ask for; only top-k reports, of a fixed size, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import exprs as X

RD = ("route_id", "direction_id")


def join_route_dim(df: DataFrame, routes: DataFrame) -> DataFrame:
    return df.join(routes.select("route_id", "route_short_name", "route_type"), "route_id", "left")


def join_stop_dim(df: DataFrame, stops: DataFrame, how: str = "left") -> DataFrame:
    return df.join(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id", how)


def latest_rows(df: DataFrame, ts: str = "window_start") -> DataFrame:
    """Rows of the newest window: a one-row maximum, broadcast, as an equality."""
    top = df.agg(F.max(ts).alias("_top"))
    return df.join(F.broadcast(top), F.col(ts) == F.col("_top")).drop("_top")


def correlated_label(df: DataFrame, routes: DataFrame) -> DataFrame:
    """``metric``: the route id, followed by its short name where there is one."""
    j = join_route_dim(df, routes)
    return j.withColumn("metric", F.concat("route_id", F.coalesce(F.concat(F.lit(" — "), "route_short_name"), F.lit(""))))


def newest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_features(features: DataFrame, as_of: Column) -> DataFrame:
    recent = X.recent_filter(features, "feature_time", as_of, 7200)
    return newest_per(recent, [*RD, "zone_id"], [F.col("feature_time").desc()])


def latest_route_predictions(pred: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    ahead = pred.filter(F.col("target_time") >= as_of - F.expr("interval 15 minutes"))
    last = newest_per(ahead, [*RD, "target_time"], [F.col("prediction_time").desc()])
    return join_route_dim(last, routes).withColumn("is_stale", X.is_stale_flag("generated_at", as_of))


def latest_bunching_predictions(pred: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    ahead = pred.filter(F.col("target_time") >= as_of - F.expr("interval 15 minutes"))
    return join_route_dim(newest_per(ahead, [*RD, "target_time"], [F.col("prediction_time").desc()]), routes)


def attribution_top5(attr: DataFrame, as_of: Column) -> DataFrame:
    return X.recent_filter(attr, "attribution_time", as_of, 86400).filter("feature_rank <= 5")


def hotspots_recent(hot: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    return join_route_dim(X.recent_filter(hot, "window_start", as_of, 7200), routes)


def recent_stop_delay(events: DataFrame, routes: DataFrame, stops: DataFrame, as_of: Column) -> DataFrame:
    e = join_stop_dim(join_route_dim(X.recent_filter(events, "observed_time", as_of, 7200), routes), stops)
    return e.select(
        "observed_time", "scheduled_time", "vehicle_id", *RD, "route_short_name", "trip_id", "stop_id", "stop_name", "stop_sequence",
        X.display_round("delay_sec", 1).alias("delay_sec"), X.display_round("distance_to_stop_m", 1).alias("distance_to_stop_m"),
        X.display_round("match_confidence", 2).alias("match_confidence"), "match_method",
    )


def route_status(delay: DataFrame, routes: DataFrame) -> DataFrame:
    j = join_route_dim(latest_rows(delay), routes)
    rounded = [X.display_round(c, 1).alias(c) for c in ("avg_delay_sec", "max_delay_sec", "p95_delay_sec")]
    return j.select("window_start", *RD, "route_short_name", "route_type", "vehicle_count", *rounded, X.route_status_band("avg_delay_sec").alias("status"))


def freshness_status(fresh: DataFrame, routes: DataFrame) -> DataFrame:
    j = join_route_dim(latest_rows(fresh), routes)
    rounded = [X.display_round(c, 1).alias(c) for c in ("avg_freshness_sec", "max_freshness_sec", "p95_freshness_sec")]
    return j.select("window_start", *RD, "route_short_name", "vehicle_count", *rounded, X.freshness_status_band("p95_freshness_sec").alias("status"))


def route_speed_summary(speed: DataFrame, routes: DataFrame) -> DataFrame:
    j = join_route_dim(latest_rows(speed), routes)
    rounded = [X.display_round(c, 1).alias(c) for c in ("avg_speed_kmh", "min_speed_kmh", "max_speed_kmh")]
    return j.select("window_start", *RD, "route_short_name", "route_type", "vehicle_count", *rounded, X.traffic_status_band("avg_speed_kmh").alias("traffic_status"))


def active_bunching(bunching: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    return join_route_dim(X.recent_filter(bunching, "event_time", as_of, 1800), routes)


def active_service_gaps(gaps: DataFrame, routes: DataFrame, as_of: Column) -> DataFrame:
    j = join_route_dim(X.recent_filter(gaps, "gap_start", as_of, 3600), routes)
    return j.withColumn("gap_duration_min", X.display_round(F.col("gap_duration_sec") / 60.0, 1))


# --- dashboard reports ---------------------------------------------------------------------------------------------------


def _in_range(df: DataFrame, ts: str, start: Column | None, end: Column | None, routes_csv: str) -> DataFrame:
    df = df if start is None else df.filter(F.col(ts).between(start, end))
    return df.filter(X.route_list_filter(routes_csv)) if "route_id" in df.columns else df


def _label(df: DataFrame, routes: DataFrame) -> DataFrame:
    return join_route_dim(df, routes).withColumn("route", F.coalesce("route_short_name", "route_id"))


#: panel -> (table, time column, value column): series by route over time
SERIES = {
    "bunching_frequency": ("hourly_bunching", "bucket", "bunching_count"),
    "reliability": ("hourly_reliability", "bucket", "gap_count"),
    "gap_duration": ("hourly_reliability", "bucket", "total_gap_sec"),
    "average_delay": ("hourly_delay", "bucket", "avg_delay_sec"),
    "peak_delay": ("hourly_delay", "bucket", "max_delay_sec"),
    "vehicles_observed": ("hourly_delay", "bucket", "total_observations"),
    "delay_heatmap": ("daily_delay", "bucket", "avg_delay_sec"),
    "speed_trend": ("hourly_speed", "bucket", "avg_speed_kmh"),
    "true_delay": ("route_delay", "window_start", "avg_delay_sec"),
    "true_delay_p95": ("route_delay", "window_start", "p95_delay_sec"),
    "predicted_delay": ("predictions", "prediction_time", "predicted_delay_sec"),
}
#: panel -> (table, time column)
COUNTS = {"matches": ("stop_delay_events", "observed_time"), "features": ("features", "feature_time"), "predictions": ("predictions", "prediction_time")}
#: panel -> (table, time column, value, aggregate, digits, descending, limit); digits and limits are fixed values, here and below
TOPS = {
    "slowest_routes": ("hourly_speed", "bucket", "avg_speed_kmh", "avg", 1, False, 15),
    "worst_delay_routes": ("daily_delay", "bucket", "avg_delay_sec", "avg", 1, True, 20),
    "most_unreliable_routes": ("hourly_reliability", "bucket", "gap_count", "sum", 0, True, 10),
}


def report(name: str, tables: dict[str, DataFrame], start: Column | None = None, end: Column | None = None, routes_csv: str = "__all") -> DataFrame:
    """A dashboard panel as a frame: a filter, a label join and a projection or top-k."""
    routes = tables.get("routes")
    if name in SERIES:
        table, ts, value = SERIES[name]
        rows = _label(_in_range(tables[table], ts, start, end, routes_csv), routes)
        v = X.display_round(F.col(value) / 60.0, 1) if name == "gap_duration" else F.col(value).cast("double")
        return rows.select(F.col(ts).alias("time"), F.col("route").alias("metric"), "direction_id", v.alias("value"))
    if name in COUNTS:
        table, ts = COUNTS[name]
        return _in_range(tables[table], ts, start, end, routes_csv).agg(F.count(F.lit(1)).alias("value"))
    if name in TOPS:
        table, ts, value, how, digits, down, limit = TOPS[name]
        rows = _label(_in_range(tables[table], ts, start, end, routes_csv), routes)
        aggs = [X.display_round(getattr(F, how)(value), digits).alias("value")]
        if name == "worst_delay_routes":
            aggs.append(X.display_round(F.max("peak_delay_sec"), 1).alias("peak"))
        order = F.col("value").desc() if down else F.col("value").asc()
        return rows.groupBy("route").agg(*aggs).orderBy(order, "route").limit(limit)
    if name in ("average_true_delay", "average_predicted_delay"):
        table, ts, value = {"average_true_delay": ("stop_delay_events", "observed_time", "delay_sec"), "average_predicted_delay": ("predictions", "prediction_time", "predicted_delay_sec")}[name]
        return _in_range(tables[table], ts, start, end, routes_csv).agg(X.display_round(F.avg(value), 1).alias("value"))
    if name == "critical_routes":
        rows = _in_range(tables["predictions"], "prediction_time", start, end, routes_csv)
        return rows.filter("risk_level = 'critical'").agg(F.count_distinct("route_id").alias("value"))
    if name == "latest_features":
        rows = _label(_in_range(tables["features"], "feature_time", start, end, routes_csv), routes)
        cols = [X.display_round(c, 1).alias(c) for c in ("avg_delay_sec", "p95_delay_sec", "max_delay_sec")]
        out = rows.select("feature_time", "route", "direction_id", *cols, "vehicle_count", "observation_count", X.display_round("hotspot_score", 2).alias("hotspot_score"))
        return out.orderBy(F.col("feature_time").desc(), F.col("avg_delay_sec").desc_nulls_last(), "route", "direction_id").limit(75)
    if name == "latest_predictions":
        rows = _label(_in_range(tables["predictions"], "prediction_time", start, end, routes_csv), routes)
        out = rows.select("prediction_time", "target_time", "route", "direction_id", X.display_round("predicted_delay_sec", 1).alias("predicted_delay_sec"), "risk_level", X.display_round("confidence", 2).alias("confidence"), "model_version", "feature_time")
        return out.orderBy(F.col("prediction_time").desc(), F.col("predicted_delay_sec").desc(), "route", "direction_id").limit(75)
    if name in ("hotspot_map", "top_hotspots"):
        rows = _label(_in_range(tables["hotspots"], "window_start", start, end, routes_csv), routes)
        digits = 5 if name == "top_hotspots" else 8
        cols = [X.display_round(c, d).alias(c) for c, d in (("centroid_lat", digits), ("centroid_lon", digits), ("avg_delay_sec", 1), ("p95_delay_sec", 1), ("hotspot_score", 2))]
        out = rows.select("window_start", "zone_id", "route", "direction_id", "observation_count", *cols, F.col("hotspot_score").alias("_s"))
        return out.orderBy(F.col("_s").desc(), "window_start", "zone_id", "route", "direction_id").limit(300 if name == "hotspot_map" else 75).drop("_s")
    if name == "fleet_activity":
        return _in_range(tables["daily_fleet"], "bucket", start, end, routes_csv)
    if name in ("bunching_table", "bunching_map"):
        rows = tables["active_bunching"].filter(X.route_list_filter(routes_csv))
        if name == "bunching_map":
            return rows.select(F.col("lat_a").alias("latitude"), F.col("lon_a").alias("longitude"), "route_short_name", "gap_seconds", F.concat("vehicle_a_id", F.lit(" ↔ "), "vehicle_b_id").alias("vehicles")).orderBy("vehicles", "gap_seconds", "latitude", "longitude").limit(200)
        at = lambda a, b: F.concat(X.display_round(a, 5).cast("decimal(12,5)").cast("string"), F.lit(", "), X.display_round(b, 5).cast("decimal(12,5)").cast("string"))
        out = rows.select("event_time", "route_short_name", X.route_type_label("route_type").alias("route_type"), "vehicle_a_id", "vehicle_b_id", "gap_seconds", at("lat_a", "lon_a").alias("location_a"), at("lat_b", "lon_b").alias("location_b"))
        return out.orderBy(F.col("event_time").desc(), "vehicle_a_id", "vehicle_b_id", "gap_seconds", "location_a", "location_b").limit(100)
    if name == "gap_table":
        rows = tables["active_gaps"].filter(X.route_list_filter(routes_csv))
        return rows.orderBy(F.col("gap_duration_sec").desc(), "gap_start", *RD).limit(50)
    raise KeyError(name)


REPORTS = (
    *SERIES, *COUNTS, *TOPS, "average_true_delay", "average_predicted_delay", "critical_routes", "latest_features", "latest_predictions", "hotspot_map",
    "top_hotspots", "fleet_activity", "bunching_table", "bunching_map", "gap_table",
)
