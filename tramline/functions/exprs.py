"""Scalar building blocks as column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DEFAULT

METERS_PER_DEGREE = 111320.0
CELL_SLACK = 1 + 1e-6  # cells a little wider than the reach, so that rounding never puts two points in reach two cells apart
C = Column


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- parsing -----------------------------------------------------------------------------------------------------------


def gtfs_time_to_seconds(c) -> Column:
    """``HH:MM:SS``, hours may exceed 23, as seconds since the service day began; null if blank or malformed."""
    parts = F.split(F.trim(_col(c)), ":")
    h, m, s = (F.get(parts, i).try_cast("int") for i in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def gtfs_date_parse(c) -> Column:
    """``YYYYMMDD`` or an ISO date; null if blank."""
    t = F.trim(_col(c))
    return F.when(F.length(t) == 8, F.to_date(F.try_to_timestamp(t, F.lit("yyyyMMdd")))).otherwise(t.try_cast("date"))


# The box that locations must lie in (south, north, west, east).


def parse_location_id(c, box: tuple[float, float, float, float] = DEFAULT.city_box) -> Column:
    """``loc:lat,lon`` inside the city box as struct(lat, lon), else null."""
    south, north, west, east = box
    parts = F.split(F.regexp_extract(_col(c), r"^loc:([^,]*,[^,]*)$", 1), ",")
    lat, lon = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    here = _col(c).startswith("loc:") & lat.between(south, north) & lon.between(west, east)  # most ids are stops' and need no pattern
    return F.when(here, F.struct(lat.alias("lat"), lon.alias("lon")))


# --- geometry and motion -----------------------------------------------------------------------------------------------


def equirect_distance_m(lat_a, lon_a, lat_b, lon_b) -> Column:
    dy = (_col(lat_b) - _col(lat_a)) * METERS_PER_DEGREE
    dx = (_col(lon_b) - _col(lon_a)) * METERS_PER_DEGREE * F.cos(F.radians(_col(lat_a)))
    return F.sqrt(dy * dy + dx * dx)


def segment_speed_kmh(lat_a, lon_a, lat_b, lon_b, seconds) -> Column:
    km = equirect_distance_m(lat_a, lon_a, lat_b, lon_b) / 1000.0
    return F.when(_col(seconds) > 0, km / (_col(seconds) / 3600.0))


def web_mercator_xy(lat, lon, zoom) -> Column:
    """struct(x, y) in pixels of a 256-pixel tile pyramid; latitude is clamped to the projection's range."""
    s = F.sin(F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), _col(lat)))))
    scale = 256.0 * F.pow(F.lit(2.0), _col(zoom))
    x = (_col(lon) + 180.0) / 360.0 * scale
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * scale
    return F.struct(x.alias("x"), y.alias("y"))


def zone_id_3dp(lat, lon) -> Column:
    text = lambda v: F.format_string("%.3f", F.round(_col(v).cast("decimal(38,8)"), 3).cast("double"))
    return F.concat(text(lat), F.lit(":"), text(lon))


def stop_place_id(parent, name, lat, lon) -> Column:
    at = lambda v: F.round(_col(v).cast("decimal(38,8)"), 4).cast("decimal(38,4)").cast("string")
    own = F.concat(F.lower(F.regexp_replace(_col(name), r"\s+", " ")), F.lit(":"), at(lat), F.lit(":"), at(lon))
    return F.coalesce(F.nullif(_col(parent), F.lit("")), F.concat(F.lit("geo:"), F.md5(own)))


def walk_seconds(meters, mps: float = 1.25) -> Column:
    return F.ceil(_col(meters) / mps).cast("long")


# --- time --------------------------------------------------------------------------------------------------------------


def epoch(c) -> Column:
    return F.unix_timestamp(_col(c))


def bucket(c, seconds: int) -> Column:
    """Start of the UTC-aligned bucket that holds an instant."""
    return F.timestamp_seconds(F.floor(epoch(c) / seconds) * seconds)


def telemetry_age(as_of_epoch, ts) -> Column:
    return (F.lit(as_of_epoch) if not isinstance(as_of_epoch, Column) else as_of_epoch).cast("double") - _col(ts).cast("double")


def service_local_date(ts, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(_col(ts), tz))


def scheduled_instant(service_date, seconds, tz: str) -> Column:
    """Wall-clock addition: the service day's midnight plus seconds (24 h and more included), read in the zone."""
    wall = _col(service_date).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _col(seconds).cast("decimal(18,6)"))
    return F.to_utc_timestamp(wall, tz)


def service_active_on(date, prefix: str = "") -> Column:
    """Whether the calendar row (columns monday..sunday, start_date, end_date) runs on a date."""
    days = F.array(*[F.col(f"{prefix}{d}").cast("int") for d in DAYS])
    on = F.element_at(days, F.weekday(_col(date)) + 1) == 1
    return _col(date).between(F.col(f"{prefix}start_date"), F.col(f"{prefix}end_date")) & on


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def calendar_features(ts, tz: str) -> dict[str, Column]:
    local = F.from_utc_timestamp(_col(ts), tz)
    hour, dow = F.hour(local), F.weekday(local) + 1
    return {"hour_of_day": hour, "day_of_week": dow, "is_weekend": dow >= 6, "is_am_peak": hour.between(7, 9), "is_pm_peak": hour.between(16, 19)}


def minutes_between(start, end) -> Column:
    """Whole minutes from one epoch second to another, rounded up, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.ceil((_col(end) - _col(start)) / 60.0))


def recent_filter(df: DataFrame, ts: str, as_of: Column, seconds: int) -> DataFrame:
    return df.filter(F.col(ts) > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


# --- scores, labels and bands ------------------------------------------------------------------------------------------


def match_confidence(distance, geofence: float = 75.0) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.0 - _col(distance) / geofence))


def match_method(trip_start) -> Column:
    return F.when(_col(trip_start).isNull(), "route_direction_geofence").otherwise("trip_start_geofence")


def speed_drop(avg_speed) -> Column:
    return F.greatest(F.lit(0.0), 15.0 - F.coalesce(_col(avg_speed), F.lit(15.0)))


def hotspot_score(avg_delay, p95_delay) -> Column:
    # 600 and 900 seconds.
    part = lambda c, d: F.greatest(F.lit(0.0), F.coalesce(_col(c), F.lit(0.0)) / d)
    return part(avg_delay, 600.0) + part(p95_delay, 900.0)


def risk_level(delay, threshold: float = 300.0) -> Column:
    d = _col(delay)
    return F.when(d >= 2 * threshold, "critical").when(d >= threshold, "high").when(d >= threshold / 2, "medium").otherwise("low")


def high_delay_label(delay, threshold: float = 300.0) -> Column:
    return (_col(delay) >= threshold).cast("int")


# The feature columns in model order.
FEATURE_COLUMNS = (
    "vehicle_count", "observation_count", "avg_delay_sec", "p95_delay_sec", "max_delay_sec", "avg_speed_kmh", "min_speed_kmh",
    "speed_drop_kmh", "bunching_count", "service_gap_count", "total_gap_sec", "avg_dwell_sec", "hotspot_score", "avg_freshness_sec",
    "hour_of_day", "day_of_week", "is_weekend", "is_am_peak", "is_pm_peak", "route_type",
)


def normalize_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature columns as doubles: null or absent becomes 0, true becomes 1; ``keep`` columns come along first."""
    one = lambda c: F.coalesce((F.col(c).cast("int") if dict(df.dtypes)[c] == "boolean" else F.col(c)).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.select(*keep, *[one(c).alias(c) for c in FEATURE_COLUMNS])


def warm_start_score(prefix: str = "") -> Column:
    """The closed-form baseline over normalised features."""
    # All weights, caps and the floor.
    v = lambda c: F.col(prefix + c)
    cap = lambda c, top, weight: F.least(v(c), F.lit(float(top))) * float(weight)
    tail = F.greatest(F.lit(0.0), v("p95_delay_sec") - v("avg_delay_sec")) * 0.25
    severe = F.greatest(F.lit(0.0), v("max_delay_sec") - v("p95_delay_sec")) * 0.10
    pressure = cap("speed_drop_kmh", 60, 2) + cap("bunching_count", 10, 15) + cap("service_gap_count", 10, 45) + cap("hotspot_score", 5, 90) + cap("avg_freshness_sec", 120, 0.05)
    return F.greatest(F.lit(-300.0), v("avg_delay_sec") + tail + severe + pressure)


# Route type labels of the dashboards and of the planner.
ROUTE_TYPES = {0: "Tram", 1: "Metro", 3: "Bus", 11: "Trolleybus"}
PLANNER_ROUTE_TYPES = {
    0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "ferry", 5: "cable tram", 6: "aerial lift", 7: "funicular", 11: "trolleybus",
    12: "monorail",
}


def _labels(table: dict[int, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def route_type_label(c) -> Column:
    return F.coalesce(F.try_element_at(_labels(ROUTE_TYPES), _col(c).cast("int")), F.concat(F.lit("Other ("), _col(c).cast("string"), F.lit(")")))


def planner_route_type_label(c) -> Column:
    known = F.try_element_at(_labels(PLANNER_ROUTE_TYPES), _col(c).cast("int"))
    return F.coalesce(known, F.concat(F.lit("type "), _col(c).cast("string")), F.lit("unknown"))


def _band(c, high: float, mid: float, names: tuple[str, str, str]) -> Column:
    return F.when(_col(c) > high, names[0]).when(_col(c) > mid, names[1]).otherwise(names[2])


# The limits of the three bands below.
def route_status_band(c) -> Column:
    return _band(c, 300, 120, ("critical", "warning", "normal"))


def traffic_status_band(c) -> Column:
    return F.when(_col(c) < 8, "congested").when(_col(c) < 15, "slow").otherwise("normal")


def freshness_status_band(c) -> Column:
    return _band(c, 120, 45, ("stale", "degraded", "healthy"))


def associated_factor(delay, speed, bunching, gaps) -> Column:
    late = _col(delay) > 300
    return (
        F.when(late & (_col(speed) < 8), "low_speed_associated")
        .when(late & (F.coalesce(_col(bunching), F.lit(0)) > 0), "bunching_associated")
        .when(late & (F.coalesce(_col(gaps), F.lit(0)) > 0), "service_gap_associated")
        .when(late, "unexplained_high_delay")
        .otherwise("normal")
    )


def is_stale_flag(generated_at, as_of: Column) -> Column:
    return _col(generated_at) < as_of - F.expr("interval 2 hours")


def clamp_delay(c) -> Column:
    d = _col(c).cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return F.when(ok, F.bround(F.greatest(F.lit(-120.0), F.least(F.lit(1800.0), d)))).otherwise(0.0).cast("int")


def display_round(c, digits: int) -> Column:
    return F.round(_col(c).cast("decimal(38,8)"), digits).cast("double")


# --- filters -----------------------------------------------------------------------------------------------------------


def bbox_filter(df: DataFrame, south: float, west: float, north: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside the box; south and north may come reversed; a box outside the globe is refused."""
    south, north = min(south, north), max(south, north)
    if not (-90 <= south and north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
        raise ValueError("the box lies outside latitude -90..90 and longitude -180..180")
    return df.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def stop_search(places: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Stop places whose name, any stop id or any alias contains ``text``, by name."""
    t = text.lower()
    has = lambda x: F.contains(F.lower(x), F.lit(t))
    return places.filter(has(F.col("name")) | F.exists("stop_ids", has) | F.exists("names", has)).orderBy("name", "place_id").limit(limit)


def route_list_filter(routes_csv: str, c="route_id") -> Column:
    """Dashboard filter: everything if the list ends in ``__all``, else membership."""
    return F.lit(True) if routes_csv.endswith("__all") else _col(c).isin([r for r in routes_csv.split(",")])
