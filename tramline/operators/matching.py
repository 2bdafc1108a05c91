"""Matching fixes to scheduled stops, and what derives from the matches.

The timetable is joined once into stop visits.  A fix meets the stops of its grid cell (stops are repeated for the cells around
them, which are as wide as the geofence), the geofence thins these pairs out, and only what is left meets the visits of its route and
stop, on its weekday, within its stretch of the day.  So a busy terminus is many join keys, and no timetable's whole day meets one fix.
All joins are equality joins with residuals; no cartesian product appears.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X
from tramline.sources.scratch import shared_folder

RD = ("route_id", "direction_id")
LON_METERS = 75_000.0  # a degree of longitude in the geofence's box: never more than it has at the latitudes served
FIX_KEY = ("event_time", "vehicle_id", "route_id", "direction_id", "latitude", "longitude", "trip_start_time")


def first_stop_per_trip(stop_times: DataFrame) -> DataFrame:
    """Per trip the time at its first timed stop: one partially aggregated minimum."""
    t = F.coalesce("departure_s", "arrival_s")
    return stop_times.filter(t.isNotNull()).groupBy("trip_id").agg(F.min_by(t, "stop_sequence").alias("first_s"))


def unmatched_positions(positions: DataFrame, matched: DataFrame, as_of: Column, cfg: TransitConfig = DEFAULT, limit: int | None = None) -> DataFrame:
    """Recent fixes with a trip start that have no match yet; newest first if limited."""
    recent = X.recent_filter(positions.filter("trip_start_time is not null"), "event_time", as_of, cfg.match_lookback_s)
    done = matched.select(F.col("observed_time").alias("event_time"), "vehicle_id", "route_id").distinct()
    out = recent.join(done, ["event_time", "vehicle_id", "route_id"], "left_anti")
    return out if limit is None else newest(out, limit)


def newest(positions: DataFrame, limit: int) -> DataFrame:
    tie = ["event_id"] if "event_id" in positions.columns else ["vehicle_id"]
    return positions.orderBy(F.col("event_time").desc(), *[F.col(c).desc() for c in tie]).limit(limit)


def stop_visits(trips: DataFrame, calendar: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Every timed stop of every trip with its route, calendar and first time."""
    t = F.coalesce("arrival_s", "departure_s")
    v = stop_times.filter(t.isNotNull()).select("trip_id", "stop_id", "stop_sequence", t.alias("scheduled_s"))
    v = v.join(trips.select("trip_id", F.col("route_id").alias("trip_route"), F.col("direction_id").alias("trip_direction"), "service_id"), "trip_id")
    v = v.join(first_stop_per_trip(stop_times), "trip_id", "left").join(calendar, "service_id")
    return v.join(stops.select("stop_id"), "stop_id", "left_semi")


def by_weekday(calendar: DataFrame) -> DataFrame:
    """The calendar once for each weekday on which a service runs, ``weekday`` counting from Monday = 0."""
    days = F.array(*[F.when(F.col(d).cast("int") == 1, F.lit(k)) for k, d in enumerate(X.DAYS)])
    return calendar.withColumn("weekday", F.explode(F.array_compact(days))).drop(*X.DAYS)


def service_dates(cfg: TransitConfig = DEFAULT) -> Column:
    """The service dates that a fix may belong to."""
    return F.transform(F.sequence(F.lit(0), F.lit(cfg.service_day_lookback)), lambda k: F.date_sub(X.service_local_date("event_time", cfg.timezone), k))


VISIT_KEY = ("route_id", "stop_id", "weekday", "stretch")


def _span(cfg: TransitConfig) -> int:
    """One hour more than the tolerance: on days on which clocks change, wall-clock seconds and elapsed ones differ by that much."""
    return cfg.schedule_tolerance_s + 3600


def keyed_visits(trips: DataFrame, calendar: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT, weekdays: DataFrame | None = None) -> DataFrame:
    """The timetable as fixes meet it: by route, stop, weekday and stretch of the day; of the given ``weekdays`` (seven rows at most) only, if there are any.

    The stop times are read once and brought together by trip, where their first time is found and their route and services join them.
    """
    runs = by_weekday(calendar) if weekdays is None else by_weekday(calendar).join(F.broadcast(weekdays), "weekday", "left_semi")
    late, early = F.coalesce("departure_s", "arrival_s"), F.coalesce("arrival_s", "departure_s")
    first = F.min_by(late, "stop_sequence").over(Window.partitionBy("trip_id"))
    v = stop_times.filter(early.isNotNull()).select("trip_id", "stop_id", "stop_sequence", early.alias("scheduled_s"), first.alias("first_s"))
    v = v.join(trips.select("trip_id", "route_id", F.col("direction_id").alias("trip_direction"), "service_id"), "trip_id").join(runs, "service_id")
    v = v.withColumn("stretch", F.floor(F.col("scheduled_s") / _span(cfg)))
    return v.select(*VISIT_KEY, "trip_id", "stop_sequence", "scheduled_s", "trip_direction", "first_s", "start_date", "end_date")


def prepare_timetable(trips: DataFrame, calendar: DataFrame, stop_times: DataFrame, stops: DataFrame, cfg: TransitConfig = DEFAULT, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """``keyed_visits`` written once, bucketed and sorted by its key, so that every match reads it as it lies.

    A session needs at least as many buckets as shuffle partitions, the default, for its joins to take the table's partitioning over.
    """
    spark = trips.sparkSession
    name = name or f"timetable_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = keyed_visits(trips, calendar, stop_times, cfg).join(stops.select("stop_id"), "stop_id", "left_semi").repartition(n, *VISIT_KEY)  # one file for each bucket
    visits.write.bucketBy(n, *VISIT_KEY).sortBy(*VISIT_KEY).option("path", shared_folder(spark, "timetable")).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def match_candidates(
    positions: DataFrame, trips: DataFrame, calendar: DataFrame, stop_times: DataFrame, stops: DataFrame, cfg: TransitConfig = DEFAULT, visits: DataFrame | None = None
) -> DataFrame:
    """All stops a fix may belong to, with distance and delay.  ``visits`` is a prepared timetable, if there is one."""
    span = _span(cfg)
    day = F.explode(service_dates(cfg))
    if visits is None:  # of the weekdays on which there are fixes: the others' visits would be shuffled for nothing
        weekdays = positions.select(day.alias("d")).select(F.weekday("d").alias("weekday")).distinct()
        visits = keyed_visits(trips, calendar, stop_times, cfg, weekdays)
    around = F.explode(F.expr("flatten(transform(array(-1,0,1), y -> transform(array(-1,0,1), x -> struct(y, x))))"))
    high, wide = cfg.geofence_m / X.METERS_PER_DEGREE, cfg.geofence_m / LON_METERS
    cell = lambda c, step: F.floor(F.col(c) / (step * X.CELL_SLACK))
    s = stops.select("stop_id", "stop_lat", "stop_lon", around.alias("o"))
    s = s.select("stop_id", "stop_lat", "stop_lon", (cell("stop_lat", high) + F.col("o.y")).alias("cy"), (cell("stop_lon", wide) + F.col("o.x")).alias("cx"))
    p = positions.withColumn("cy", cell("latitude", high)).withColumn("cx", cell("longitude", wide))
    box = (F.abs(F.col("stop_lat") - F.col("latitude")) <= high) & (F.abs(F.col("stop_lon") - F.col("longitude")) <= wide)
    start = F.col("start_s").isNull() | (F.abs(F.col("first_s") - F.col("start_s")) <= cfg.trip_start_tolerance_s)
    distance = X.equirect_distance_m("latitude", "longitude", "stop_lat", "stop_lon")
    # Hinted, as Spark's estimate of the stops doesn't see that they are repeated: they would be broadcast when far too large.
    at = p.join(s.hint("merge"), ["cy", "cx"]).drop("cy", "cx").filter(box & (distance <= cfg.geofence_m)).withColumn("distance_to_stop_m", distance)
    at = at.withColumn("service_date", day).withColumn("start_s", X.gtfs_time_to_seconds("trip_start_time")).withColumn("weekday", F.weekday("service_date"))
    wall = X.epoch(F.from_utc_timestamp("event_time", cfg.timezone)) - X.epoch(F.col("service_date").cast("timestamp"))
    at = at.withColumn("stretch", F.explode(F.array(*[F.floor(wall / span) + k for k in (-1, 0, 1)])))
    near = at.join(visits, [*VISIT_KEY])
    near = near.filter(start & (F.col("direction_id").isNull() | (F.col("direction_id") == F.col("trip_direction"))) & F.col("service_date").between(F.col("start_date"), F.col("end_date")))
    near = near.withColumn("scheduled_time", X.scheduled_instant("service_date", "scheduled_s", cfg.timezone))
    near = near.withColumn("delay_sec", (X.epoch("event_time") - X.epoch("scheduled_time")).cast("double"))
    near = near.filter(F.abs("delay_sec") <= cfg.schedule_tolerance_s)
    return near.select(
        *positions.columns, "service_date", "start_s", "trip_id", "trip_direction", "stop_id", "stop_sequence", "scheduled_time", "delay_sec", "distance_to_stop_m",
        X.match_confidence("distance_to_stop_m", cfg.geofence_m).alias("match_confidence"), X.match_method("start_s").alias("match_method"),
    )


def best_match_per_position(candidates: DataFrame, key: tuple[str, ...] = FIX_KEY) -> DataFrame:
    """Per fix the nearest stop, then the smallest delay, then trip and sequence: a partially aggregated minimum."""
    keys = [k for k in (*key, "event_id") if k in candidates.columns]
    rest = [c for c in candidates.columns if c not in keys]
    order = F.struct("distance_to_stop_m", F.abs("delay_sec").alias("d"), "trip_id", "stop_sequence")
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("m")).select(*keys, "m.*")


def match_stop_delay(
    positions: DataFrame, trips: DataFrame, calendar: DataFrame, stop_times: DataFrame, stops: DataFrame, cfg: TransitConfig = DEFAULT, visits: DataFrame | None = None
) -> DataFrame:
    """One stop-delay event per matched fix; ``visits`` as in ``match_candidates``."""
    best = best_match_per_position(match_candidates(positions, trips, calendar, stop_times, stops, cfg, visits))
    return best.select(
        F.col("event_time").alias("observed_time"), "scheduled_time", "service_date", "vehicle_id", "route_id",
        F.coalesce("direction_id", "trip_direction").alias("direction_id"), "trip_id", "stop_id", "stop_sequence", "delay_sec", "distance_to_stop_m",
        "match_confidence", "match_method",
    )


def dedupe_stop_delay(events: DataFrame, key: tuple[str, ...], newest_first: str = "created_at") -> DataFrame:
    """The newest row of each key, nulls being equal."""
    w = Window.partitionBy(*key).orderBy(F.col(newest_first).desc(), *[F.col(c) for c in sorted(events.columns) if c not in (*key, newest_first)])
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stratified_stop_sample(visits: DataFrame) -> DataFrame:
    """One reproducible stop visit per route, direction and hour, by the smallest hash of its name."""
    hour = (F.col("scheduled_s") / 3600).cast("int").alias("hour")
    tag = F.md5(F.concat_ws(":", "trip_id", "stop_id", F.col("stop_sequence").cast("string")))
    pick = F.min_by(F.struct("trip_id", "stop_id", "stop_sequence"), tag).alias("m")
    return visits.groupBy(F.col("trip_route").alias("route_id"), F.col("trip_direction").alias("direction_id"), hour).agg(pick).select("route_id", "direction_id", "hour", "m.*")


def route_delay(events: DataFrame, window_s: int = 60) -> DataFrame:
    out = events.groupBy(X.bucket("observed_time", window_s).alias("window_start"), *RD).agg(
        F.count_distinct("vehicle_id").alias("vehicle_count"),
        F.avg("delay_sec").alias("avg_delay_sec"),
        F.max("delay_sec").alias("max_delay_sec"),
        F.min("delay_sec").alias("min_delay_sec"),
        F.percentile("delay_sec", 0.95).alias("p95_delay_sec"),
    )
    return out.withColumn("window_end", F.timestamp_seconds(X.epoch("window_start") + window_s))


def stop_dwell_windows(events: DataFrame, window_s: int = 900) -> DataFrame:
    """How long a vehicle was observed at one stop; two observations at least."""
    at = X.epoch("observed_time")
    out = events.groupBy(X.bucket("observed_time", window_s).alias("window_start"), *RD, "stop_id", "vehicle_id").agg(
        F.count(F.lit(1)).alias("observation_count"), (F.max(at) - F.min(at)).cast("double").alias("avg_dwell_sec")
    )
    out = out.filter("observation_count >= 2").withColumn("max_dwell_sec", F.col("avg_dwell_sec"))
    return out.withColumn("window_end", F.timestamp_seconds(X.epoch("window_start") + window_s))


def geo_hotspots(events: DataFrame, stops: DataFrame, window_s: int = 900, speed: DataFrame | None = None, bunching: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Delay by window, stop zone and route direction.  Speed, bunching and gaps fill in only when their tables are given."""
    e = events.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id")
    out = e.groupBy(X.bucket("observed_time", window_s).alias("window_start"), X.zone_id_3dp("stop_lat", "stop_lon").alias("zone_id"), *RD).agg(
        F.avg("stop_lat").alias("centroid_lat"),
        F.avg("stop_lon").alias("centroid_lon"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count_distinct("vehicle_id").alias("active_vehicle_count"),
        F.avg("delay_sec").alias("avg_delay_sec"),
        F.percentile("delay_sec", 0.95).alias("p95_delay_sec"),
    )
    out = out.withColumn("window_end", F.timestamp_seconds(X.epoch("window_start") + window_s))
    out = out.withColumn("hotspot_score", X.hotspot_score("avg_delay_sec", "p95_delay_sec"))
    extra = {"avg_speed_kmh": (speed, F.avg("avg_speed_kmh"), "window_start"), "bunching_count": (bunching, F.count(F.lit(1)), "event_time"), "service_gap_count": (gaps, F.count(F.lit(1)), "gap_start")}
    for name, (df, agg, ts) in extra.items():
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("double") if name == "avg_speed_kmh" else F.lit(0).cast("long"))
            continue
        more = df.groupBy(X.bucket(ts, window_s).alias("_w"), F.col("route_id").alias("_r"), F.col("direction_id").alias("_d")).agg(agg.alias(name))
        same = (F.col("window_start") == F.col("_w")) & (F.col("route_id") == F.col("_r")) & F.col("direction_id").eqNullSafe(F.col("_d"))
        out = out.join(more, same, "left").drop("_w", "_r", "_d")
        if name != "avg_speed_kmh":
            out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def matching_cycle(
    positions: DataFrame, matched: DataFrame, timetable: dict[str, DataFrame], metrics: dict[str, DataFrame], as_of: Column, cfg: TransitConfig = DEFAULT, tables: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Match what is new within the look-back and derive the tables that depend on it for that range, in order.

    ``stop_delay_events`` holds the new events, to be appended.  Of ``matched`` only what lies in the refreshed range is read: a
    partitioned table (column ``event_date``) is read from its last folders only.  The other results are the refreshed range, or, with
    the earlier ``tables`` of the same names, those with that range replaced.
    """
    from tramline.operators import features
    from tramline.sources.scratch import stored
    from tramline.sources.sinks import insert_unique, read_since, refresh_from, since

    edge = since(as_of, cfg.match_lookback_s, cfg.feature_window_s)
    known = read_since(matched, "observed_time", edge)
    todo = unmatched_positions(read_since(positions, "event_time", edge), known, as_of, cfg)
    fresh = match_stop_delay(todo, timetable["trips"], timetable["calendar"], timetable["stop_times"], timetable["stops"], cfg)
    fresh = stored(insert_unique(known, fresh), "events")
    events = stored(known.select(fresh.columns).unionByName(fresh), "range")
    delay, dwell, hot = route_delay(events), stop_dwell_windows(events), geo_hotspots(events, timetable["stops"])
    when = {"speed": "window_start", "bunching": "event_time", "gaps": "gap_start", "freshness": "window_start"}
    m = {k: read_since(metrics[k], ts, edge) for k, ts in when.items()}
    rows = features.feature_windows(delay, m["speed"], m["bunching"], m["gaps"], dwell, m["freshness"], hot, timetable["routes"], cfg)
    out = {"stop_dwell_times": (dwell, "window_start"), "route_delay_metrics": (delay, "window_start"), "geo_delay_hotspots": (hot, "window_start"), "realtime_feature_windows": (rows, "feature_time")}
    old = tables or {}
    return {"stop_delay_events": fresh} | {k: refresh_from(old[k], df, ts, edge) if k in old else df for k, (df, ts) in out.items()}
