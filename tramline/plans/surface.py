"""The library for those who write SQL: its scalar expressions as session functions, its operators' results as views.

A function's body is the SQL text of the column expression itself, so the optimizer sees built-in functions in either form, and
there is one definition.  A view is a plan, not a result: a query pays for the views that it names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X
from tramline.operators import features, matching, rollups, telemetry, views

#: name: parameters, result type, expression over columns of the parameters' names
Function = tuple[str, str, Callable[..., Column]]


def functions(cfg: TransitConfig = DEFAULT) -> dict[str, Function]:
    four = "lat_a double, lon_a double, lat_b double, lon_b double"
    return {
        "gtfs_time_to_seconds": ("t string", "int", X.gtfs_time_to_seconds), "gtfs_date": ("d string", "date", X.gtfs_date_parse),
        "location": ("id string", "struct<lat: double, lon: double>", lambda c: X.parse_location_id(c, cfg.city_box)), "distance_m": (four, "double", X.equirect_distance_m),
        "segment_speed_kmh": (f"{four}, seconds double", "double", X.segment_speed_kmh), "zone_id": ("lat double, lon double", "string", X.zone_id_3dp),
        "stop_place_id": ("parent string, name string, lat double, lon double", "string", X.stop_place_id), "walk_seconds": ("meters double", "double", lambda m: X.walk_seconds(m, cfg.walking_mps)),
        "time_bucket": ("ts timestamp, seconds bigint", "timestamp", lambda ts, s: F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / F.col(s)) * F.col(s))),
        "telemetry_age": ("as_of double, epoch_s double", "double", lambda a, t: F.col(a) - F.col(t)), "minutes_between": ("dep bigint, arr bigint", "bigint", X.minutes_between),
        "match_confidence": ("distance double", "double", lambda d: X.match_confidence(d, cfg.geofence_m)), "match_method": ("trip_start string", "string", X.match_method),
        "hotspot_score": ("avg_delay double, p95_delay double", "double", X.hotspot_score), "speed_drop": ("avg_speed double", "double", X.speed_drop),
        "risk_level": ("delay double", "string", lambda d: X.risk_level(d, cfg.high_delay_s)), "route_type_label": ("kind int", "string", X.route_type_label),
        "route_status": ("delay double", "string", X.route_status_band), "traffic_status": ("speed double", "string", X.traffic_status_band),
        "freshness_status": ("p95 double", "string", X.freshness_status_band), "clamp_delay": ("delay double", "double", X.clamp_delay),
        "associated_factor": ("delay double, speed double, bunching bigint, gaps bigint", "string", X.associated_factor),
    }


def sql_text(spark: SparkSession, expression: Column) -> str:
    """A column expression as SQL.  Operators come as functions; those whose names are keywords are quoted."""
    return re.sub(r"(?<![\w`'])(and|or|not)\(", r"`\1`(", spark._jsparkSession.expression(expression._jc).sql())


def register_functions(spark: SparkSession, prefix: str = "", cfg: TransitConfig = DEFAULT) -> list[str]:
    """Makes every scalar of ``functions`` a function of this session, under its name behind ``prefix``; returns the names."""
    out = []
    for name, (parameters, result, make) in functions(cfg).items():
        names = [p.split()[0] for p in parameters.split(", ")]
        body = sql_text(spark, make(*names))
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns {result} return cast({body} as {result})")
        out.append(prefix + name)
    return out


def operator_views(tables: Mapping[str, DataFrame], as_of: Column, cfg: TransitConfig = DEFAULT) -> dict[str, DataFrame]:
    """What the operators make of ``telemetry`` and the timetable tables, by the names under which SQL finds them."""
    t = tables
    events = matching.match_stop_delay(t["telemetry"], t["trips"], t["calendar"], t["stop_times"], t["stops"], cfg)
    delay, dwell, hot = matching.route_delay(events), matching.stop_dwell_windows(events, 3600), matching.geo_hotspots(events, t["stops"])
    speed, bunch, gaps = telemetry.segment_speed(t["telemetry"]), telemetry.bunching_events(t["telemetry"], cfg), telemetry.service_gap_between_events(t["telemetry"], cfg)
    fresh = telemetry.telemetry_freshness(t["telemetry"], F.unix_timestamp(as_of))
    return {
        "stop_delay_events": events, "route_delay_metrics": delay, "stop_dwell_times": dwell, "geo_delay_hotspots": hot, "segment_speed_stats": speed, "bunching_events": bunch,
        "service_gap_alerts": gaps, "telemetry_freshness_metrics": fresh, "realtime_feature_windows": features.feature_windows(delay, speed, bunch, gaps, dwell, fresh, hot, t["routes"], cfg),
        "hourly_delay_by_route": rollups.hourly_delay(delay), "daily_delay_by_route": rollups.daily_delay(delay), "hourly_bunching_by_route": rollups.hourly_bunching(bunch),
        "hourly_speed_by_route": rollups.hourly_speed(speed), "hourly_service_reliability": rollups.hourly_reliability(gaps), "daily_fleet_utilization": telemetry.daily_fleet(t["telemetry"]),
        "route_status": views.route_status(delay, t["routes"]), "freshness_status": views.freshness_status(fresh, t["routes"]), "active_bunching": views.active_bunching(bunch, t["routes"], as_of),
        "active_service_gaps": views.active_service_gaps(gaps, t["routes"], as_of), "route_speed_summary": views.route_speed_summary(speed, t["routes"]),
    }


def register_views(tables: Mapping[str, DataFrame], as_of: Column, prefix: str = "", cfg: TransitConfig = DEFAULT) -> list[str]:
    """Makes the operators' results temporary views of the session; returns their names."""
    made = operator_views(tables, as_of, cfg)
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in made]
