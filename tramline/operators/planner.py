"""Trip planning as batch joins: a frame of requests in, a frame of itineraries out.

A request has ``request_id, origin_id, destination_id, service_date, departure_s``; an endpoint is a stop, a stop place or
``loc:lat,lon``.  Every per-request limit is a ranked window keyed by the request, so a batch of requests is one job.

Searches meet the timetable by service date, stop and stretch of the day: departures are joined with the services that run on the
dates asked for, and their time falls into buckets as wide as the window searched, so that a stop's other hours and services never
meet a request.  What several steps read is written once to shared storage (``stored``).

Rides are by far the largest table of a search, so they are shuffled once, by request, for their ranks and for those that are direct; they go
on without what their trip tells (route, direction, shape), which only the rows that are kept get back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X
from tramline.sources.scratch import stored, swept

KEY = ("request_id", "service_date")
TRIP = ("trip_id", "route_id", "direction_id", "shape_id")


# --- places and endpoints ------------------------------------------------------------------------------------------------


def stop_places(stops: DataFrame) -> DataFrame:
    """Stops grouped by parent station, or by name and rounded position."""
    s = stops.filter("location_type is null or location_type = 0").withColumn("place_id", X.stop_place_id("parent_station", "stop_name", "stop_lat", "stop_lon"))
    return s.groupBy("place_id").agg(
        F.min("stop_name").alias("name"),
        F.avg("stop_lat").alias("lat"),
        F.avg("stop_lon").alias("lon"),
        F.sort_array(F.collect_list("stop_id")).alias("stop_ids"),
        F.count(F.lit(1)).alias("stop_count"),
        F.sort_array(F.collect_set("stop_name")).alias("names"),
    )


def _cells(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    """Cell of a point; longitude steps are twice as wide, enough for latitudes below 60 degrees."""
    return F.floor(lat / step).alias("cy"), F.floor(lon / (2 * step)).alias("cx")


def near_join(left: DataFrame, right: DataFrame, lat_a: str, lon_a: str, lat_b: str, lon_b: str, meters: float) -> DataFrame:
    """Pairs within ``meters``: the right side is repeated for the nine cells around it, then an equality join and the distance.

    The join is hinted: Spark's estimate of the repeated side doesn't see the repeats, so that it would be broadcast when far too large.
    """
    step = meters / X.METERS_PER_DEGREE * X.CELL_SLACK
    y, x = _cells(F.col(lat_a), F.col(lon_a), step)
    l = left.withColumn("cy", y).withColumn("cx", x)  # noqa: E741
    around = F.expr("flatten(transform(array(-1,0,1), dy -> transform(array(-1,0,1), dx -> struct(dy, dx))))")
    y, x = _cells(F.col(lat_b), F.col(lon_b), step)
    r = right.withColumn("o", F.explode(around)).withColumn("cy", y + F.col("o.dy")).withColumn("cx", x + F.col("o.dx")).drop("o")
    near = l.join(r.hint("merge"), ["cy", "cx"]).drop("cy", "cx")
    return near.withColumn("meters", X.equirect_distance_m(lat_a, lon_a, lat_b, lon_b)).filter(F.col("meters") <= meters)


def transfer_stop_pairs(stops: DataFrame, meters: float = DEFAULT.transfer_walk_m) -> DataFrame:
    """Stops within walking distance of each other, each with itself included."""
    a = stops.select(F.col("stop_id").alias("from_stop_id"), F.col("stop_lat").alias("a_lat"), F.col("stop_lon").alias("a_lon"))
    b = stops.select(F.col("stop_id").alias("to_stop_id"), F.col("stop_lat").alias("b_lat"), F.col("stop_lon").alias("b_lon"))
    return near_join(a, b, "a_lat", "a_lon", "b_lat", "b_lon", meters).select("from_stop_id", "to_stop_id", "meters")


def access_stop_join(locations: DataFrame, places: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Per location (``location_id, loc_lat, loc_lon``) its nearest stop places, at most ``location_stops``."""
    near = near_join(locations, places, "loc_lat", "loc_lon", "lat", "lon", cfg.location_stop_m)
    w = Window.partitionBy("location_id").orderBy("meters", "place_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cfg.location_stops)


def resolve_endpoints(requests: DataFrame, places: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """``request_id, side, endpoint_id, lat, lon, stop_id, walk_m``: the stops at which each end of a request may start or end."""
    # Locations are read inside the explode: as a column after it, each use (both filters, latitude, longitude) would read them again.
    end = lambda side: F.struct(F.lit(side).alias("side"), F.col(f"{side}_id").alias("endpoint_id"), X.parse_location_id(f"{side}_id", cfg.city_box).alias("at"))
    ends = requests.select("request_id", F.explode(F.array(end("origin"), end("destination"))).alias("e")).select("request_id", "e.*")
    by_id = places.select(F.explode(F.concat(F.array("place_id"), "stop_ids")).alias("endpoint_id"), "lat", "lon", "stop_ids").distinct()
    named = ends.filter("at is null").drop("at").join(by_id, "endpoint_id").select("request_id", "side", "endpoint_id", "lat", "lon", F.explode("stop_ids").alias("stop_id"), F.lit(0.0).alias("walk_m"))
    spots = ends.filter("at is not null").select("request_id", "side", "endpoint_id", F.col("at.lat").alias("loc_lat"), F.col("at.lon").alias("loc_lon"), F.concat_ws("|", "request_id", "side").alias("location_id"))
    walked = access_stop_join(spots, places, cfg)
    walked = walked.select("request_id", "side", "endpoint_id", F.col("loc_lat").alias("lat"), F.col("loc_lon").alias("lon"), F.explode("stop_ids").alias("stop_id"), F.col("meters").alias("walk_m"))
    return named.unionByName(walked)


def service_windows(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """``request_id, service_date, earliest_s, service_id``: today's services and yesterday's, whose clock runs on past midnight."""
    back = F.explode(F.array(F.lit(0), F.lit(1))).alias("back")
    r = requests.select("request_id", F.col("service_date").alias("day"), "departure_s", back)
    r = r.select("request_id", F.date_sub("day", F.col("back")).alias("service_date"), (F.col("departure_s") + F.col("back") * 86400).alias("earliest_s"))
    days = F.explode(F.array_compact(F.array(*[F.when(F.col(d).cast("int") == 1, F.lit(k)) for k, d in enumerate(X.DAYS)]))).alias("weekday")
    runs = calendar.select("service_id", "start_date", "end_date", days)
    dates = r.select("service_date").distinct().withColumn("weekday", F.weekday("service_date"))
    per_day = dates.join(runs, "weekday").filter(F.col("service_date").between(F.col("start_date"), F.col("end_date"))).select("service_date", "service_id")
    return r.join(per_day, "service_date")


# --- searches ------------------------------------------------------------------------------------------------------------


def prepared_search(requests: DataFrame, places: DataFrame, calendar: DataFrame, trips: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT) -> tuple[DataFrame, ...]:
    """``ends, windows, trips, stop_times`` of a batch of requests, stored: trips that run on the dates asked for only, and their timed visits."""
    ends = stored(resolve_endpoints(requests, places, cfg), "ends")
    windows = stored(service_windows(requests, calendar), "windows")
    trips = stored(trips.select(*TRIP, "service_id").join(windows.select("service_id").distinct(), "service_id", "left_semi"), "trips")
    timed = stop_times.filter("arrival_s is not null or departure_s is not null").select("trip_id", "stop_id", "stop_sequence", "arrival_s", "departure_s")
    return ends, windows, trips, stored(timed.join(trips.select("trip_id"), "trip_id", "left_semi"), "times")


def _timed(stop_times: DataFrame, departing: bool) -> DataFrame:
    t = F.coalesce("departure_s", "arrival_s") if departing else F.coalesce("arrival_s", "departure_s")
    return stop_times.filter(t.isNotNull()).select("trip_id", "stop_id", "stop_sequence", t.alias("t"))


def departures_on(windows: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Timed departures by ``service_date``, on the dates of the windows and their services only."""
    days = windows.select("service_date", "service_id").distinct()
    runs = trips.select(*TRIP, "service_id").join(days, "service_id").drop("service_id")
    return _timed(stop_times, True).join(runs, "trip_id")


def _within(asked: DataFrame, visits: DataFrame, lo: Column, span: int) -> DataFrame:
    """``asked`` (with ``service_date, stop_id``) beside the departures there between ``lo`` and ``lo + span``, as an equality join."""
    a = asked.withColumn("_lo", lo).withColumn("_b", F.explode(F.array(F.floor(F.col("_lo") / span), F.floor(F.col("_lo") / span) + 1)))
    j = a.join(visits.withColumn("_b", F.floor(F.col("t") / span)), ["service_date", "stop_id", "_b"])
    return j.filter((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_lo") + span)).drop("_lo", "_b")


def boardings(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Departures that a request can catch: its origin stops' timed visits on active services within the search window."""
    o = ends.filter("side = 'origin'").select("request_id", "stop_id", "walk_m")
    o = o.join(windows.select(*KEY, "earliest_s").distinct(), "request_id")
    return _within(o, departures_on(windows, trips, stop_times), F.col("earliest_s"), cfg.search_window_s).drop("earliest_s")


STRETCH_S = 3600  # of the day, by which arrivals are met
LEG_NAMES = {
    "trip_id": "trip_id", "route_id": "route_id", "direction_id": "direction_id", "shape_id": "shape_id", "stop_id": "from_stop", "to_stop": "to_stop",
    "stop_sequence": "from_seq", "to_seq": "to_seq", "t": "dep_s", "to_t": "arr_s",
}


def _ride(b: DataFrame, stop_times: DataFrame, leg: str) -> DataFrame:
    """Boardings with every later stop of the same trip."""
    later = _timed(stop_times, False).select("trip_id", F.col("stop_id").alias("to_stop"), F.col("stop_sequence").alias("to_seq"), F.col("t").alias("to_t"))
    r = b.join(later, "trip_id").filter("to_seq > stop_sequence")
    return _as_leg(r, leg)


def _as_leg(rides: DataFrame, leg: str) -> DataFrame:
    return rides.select(*[c for c in rides.columns if c not in LEG_NAMES], *[F.col(k).alias(f"{leg}_{v}") for k, v in LEG_NAMES.items() if k in rides.columns])


def _told(rows: DataFrame, trips: DataFrame, *legs: str) -> DataFrame:
    """Route, direction and shape of the trips of some legs."""
    for leg in legs:
        rows = rows.join(trips.select(*[F.col(c).alias(f"{leg}_{c}") for c in TRIP]), f"{leg}_trip_id")
    return rows


def first_rides(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Every ride that starts at the origin of a request."""
    return _ride(boardings(ends, windows, trips, stop_times, cfg), stop_times, "leg1").withColumnRenamed("walk_m", "access_m")


def direct_trip_join(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Every direct ride of every request."""
    d = ends.filter("side = 'destination'").select("request_id", F.col("stop_id").alias("leg1_to_stop"), F.col("walk_m").alias("egress_m"))
    return first_rides(ends, windows, trips, stop_times, cfg).join(d, ["request_id", "leg1_to_stop"])


def _rank(df: DataFrame, *order: str) -> Column:
    """Number of a row within its request and service day.  Ties are broken by all trips, stops, places in a trip and times, which name a row."""
    rest = [c for c in sorted(df.columns) if c not in order and c.endswith(("_trip_id", "_stop", "_seq", "_s"))]
    return F.row_number().over(Window.partitionBy(*KEY).orderBy(*order, *rest))


def top_per_request(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows of each request and service day."""
    return df.withColumn("_n", _rank(df, *order)).filter(F.col("_n") <= k).drop("_n")


def ranked_rides(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """The rides of ``first_rides`` that a search goes on with, stored: the earliest ``first_legs`` of each request and the direct ones.

    ``early`` tells the former; ``egress`` holds the walks of the latter, one for each way in which their stop is a destination.
    Both are found in one shuffle by request.  The trips' routes, directions and shapes are left out.
    """
    at = stored(boardings(ends, windows, trips, stop_times, cfg).drop(*TRIP[1:]), "boardings")
    rides = _ride(at, stop_times, "leg1").withColumnRenamed("walk_m", "access_m")
    goals = ends.filter("side = 'destination'").groupBy("request_id").agg(F.collect_list(F.struct("stop_id", "walk_m")).alias("_goals"))
    rides = rides.withColumn("early", F.lit(True)).join(goals, "request_id", "left")
    here = F.filter(F.coalesce("_goals", F.array()), lambda g: g["stop_id"] == F.col("leg1_to_stop"))
    rides = rides.withColumn("egress", F.transform(here, lambda g: g["walk_m"])).drop("_goals")
    rides = rides.withColumn("early", _rank(rides, "leg1_arr_s") <= cfg.first_legs)
    return stored(rides.filter(F.col("early") | (F.size("egress") > 0)), "rides")


def direct_itineraries(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, cfg: TransitConfig = DEFAULT, rides: DataFrame | None = None) -> DataFrame:
    """The first ``candidates`` direct rides of each request; ``rides`` are those of ``ranked_rides`` if there already."""
    best = lambda found: top_per_request(found, cfg.candidates, "leg1_arr_s", "leg1_dep_s")
    if rides is None:
        return best(direct_trip_join(ends, windows, trips, stop_times, cfg))
    return _told(best(rides.withColumn("egress_m", F.explode("egress")).drop("early", "egress")), trips, "leg1")


def longest_ride(stop_times: DataFrame) -> int:
    """Seconds from the first departure to the last arrival of the longest trip: one number."""
    own = stop_times.groupBy("trip_id").agg((F.max(F.coalesce("arrival_s", "departure_s")) - F.min(F.coalesce("departure_s", "arrival_s"))).alias("s"))
    with swept(stop_times.sparkSession):
        return own.agg(F.max("s")).first()[0] or 0


def last_rides(ends: DataFrame, bounds: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, departures: DataFrame | None = None) -> DataFrame:
    """Every ride that ends at the destination of a request within its bounds (``request_id, service_date, lo, hi, after, upto``): it departs
    between ``lo`` and ``hi`` and arrives later than ``after``, by ``upto``.  ``departures`` may tell more of the timed departures.

    Arrivals are met by stop, date and stretch of the day, so that those of other hours never meet a request.
    """
    d = ends.filter("side = 'destination'").select("request_id", F.col("stop_id").alias("to_stop"), F.col("walk_m").alias("egress_m")).join(bounds, "request_id")
    stretches = F.explode(F.sequence(F.floor(F.col("after") / STRETCH_S), F.floor(F.col("upto") / STRETCH_S))).alias("_b")
    d = d.filter("after <= upto").select("*", stretches)
    days = windows.select("service_date", "service_id").distinct()
    runs = trips.select(*TRIP, "service_id").join(days, "service_id").drop("service_id")
    arrivals = _timed(stop_times, False).select("trip_id", F.col("stop_id").alias("to_stop"), F.col("stop_sequence").alias("to_seq"), F.col("t").alias("to_t"))
    arrivals = arrivals.join(runs, "trip_id").withColumn("_b", F.floor(F.col("to_t") / STRETCH_S))
    met = d.join(arrivals, ["service_date", "to_stop", "_b"]).filter("to_t > after and to_t <= upto").drop("_b", "after", "upto")
    rides = met.join(_timed(stop_times, True) if departures is None else departures, "trip_id")
    return rides.filter((F.col("stop_sequence") < F.col("to_seq")) & F.col("t").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def _first_legs(rides: DataFrame, cfg: TransitConfig) -> tuple[DataFrame, DataFrame]:
    """The earliest first legs of each request, and when the ride after them departs: ``lo`` to ``hi``."""
    first = rides.filter("early").drop("early", "egress")
    soonest, latest = cfg.min_transfer_s, cfg.min_transfer_s + cfg.transfer_wait_s
    bounds = first.groupBy(*KEY).agg((F.min("leg1_arr_s") + soonest).alias("lo"), (F.max("leg1_arr_s") + latest).alias("hi"))
    return first, stored(bounds, "bounds")


def _changes(stop_times: DataFrame, stops: DataFrame, cfg: TransitConfig) -> DataFrame:
    """Timed departures with the stops from which one may walk to them, themselves included: stored, as every search reads them.

    The walks join the timetable, not the first legs: those are many more, and would be shuffled once more for it.
    """
    pairs = transfer_stop_pairs(stops, cfg.transfer_walk_m).select(F.col("from_stop_id").alias("leg1_to_stop"), F.col("to_stop_id").alias("stop_id"), F.col("meters").alias("transfer_m"))
    return stored(_timed(stop_times, True).join(pairs, "stop_id"), "changes")


def _transfers(first: DataFrame, last: DataFrame, cfg: TransitConfig) -> DataFrame:
    """First legs and last rides (by ``_changes``) that connect."""
    j = first.join(last.drop(*TRIP[1:]), [*KEY, "leg1_to_stop"])
    wait = F.col("t") - F.col("leg1_arr_s")
    j = j.filter((F.col("trip_id") != F.col("leg1_trip_id")) & wait.between(cfg.min_transfer_s, cfg.min_transfer_s + cfg.transfer_wait_s))
    return _as_leg(j, "leg2")


def one_transfer_join(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, cfg: TransitConfig = DEFAULT, rides: DataFrame | None = None) -> DataFrame:
    """First legs (the earliest arrivals of each request), a walk between stops, and a second ride to the destination.

    The search meets in the middle: first legs from the origin and last rides into the destination, departing no later than the
    first legs allow, are joined by request, date and transfer stop, so that no boarding that misses the destination is ever made.
    """
    rides = ranked_rides(ends, windows, trips, stop_times, cfg) if rides is None else rides
    first, bounds = _first_legs(rides, cfg)
    whole = bounds.withColumn("after", F.col("lo") - 1).withColumn("upto", F.col("hi") + longest_ride(stop_times))
    return _told(_transfers(first, last_rides(ends, whole, windows, trips, stop_times, _changes(stop_times, stops, cfg)), cfg), trips, "leg1", "leg2")


def one_transfer_itineraries(ends: DataFrame, windows: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, cfg: TransitConfig = DEFAULT, rides: DataFrame | None = None) -> DataFrame:
    """The best ``candidates`` of ``one_transfer_join``, found without all the others.

    A first pass takes only last rides that arrive within ``probe_s`` of the earliest possible departure.  A request that has enough of
    them is done: whatever arrives later is worse than all of those.  Only the others' last rides are searched to the end.  Where connections are so
    sparse that few requests would be done, as one request in ``probe_sample`` tells, a single pass is cheaper; the rows are the same.
    """
    rides = ranked_rides(ends, windows, trips, stop_times, cfg) if rides is None else rides
    first, bounds = _first_legs(rides, cfg)
    changes = _changes(stop_times, stops, cfg)
    last = lambda some: stored(last_rides(ends, some, windows, trips, stop_times, changes).drop(*TRIP[1:]), "last")
    search = lambda some: _transfers(first.join(some.select(*KEY), [*KEY], "left_semi"), last(some), cfg)
    best = lambda found: _told(top_per_request(found, cfg.candidates, "leg2_arr_s", "leg1_dep_s"), trips, "leg1", "leg2")
    enough = lambda found: found.groupBy(*KEY).count().filter(F.col("count") >= cfg.candidates).select(*KEY)
    soon = bounds.withColumn("after", F.col("lo") - 1).withColumn("upto", F.col("lo") + cfg.probe_s)
    end = F.col("hi") + longest_ride(stop_times)
    asked = soon.filter(F.pmod(F.xxhash64("request_id"), F.lit(cfg.probe_sample)) == 0)
    with swept(ends.sparkSession):
        sparse = 2 * enough(search(asked)).count() < asked.count()
    if sparse:
        return best(_transfers(first, last(soon.withColumn("upto", end)), cfg))
    near = stored(_transfers(first, last(soon), cfg), "near")
    others = stored(bounds.join(enough(near), [*KEY], "left_anti"), "others")
    far = search(others.withColumn("after", F.col("lo") + cfg.probe_s).withColumn("upto", end))
    return best(near.unionByName(far))


def union_service_windows(direct: DataFrame, transfer: DataFrame) -> DataFrame:
    return direct.withColumn("kind", F.lit("direct")).unionByName(transfer.withColumn("kind", F.lit("one_transfer")), allowMissingColumns=True)


def found_itineraries(search: tuple[DataFrame, ...], stops: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Direct rides and rides with a transfer of a ``prepared_search``, the best of each kind, stored."""
    rides = ranked_rides(*search, cfg)
    return stored(union_service_windows(direct_itineraries(*search, cfg, rides), one_transfer_itineraries(*search, stops, cfg, rides)), "found")


# --- itineraries ---------------------------------------------------------------------------------------------------------

LEG = "mode string, trip_id string, route_id string, direction_id int, route_short_name string, from_id string, to_id string, dep long, arr long, minutes long, meters double"


def _walk(frm: Column, to: Column, dep: Column, meters: Column, mps: float) -> Column:
    s = X.walk_seconds(meters, mps)
    nul = F.lit(None)
    return F.struct(
        F.lit("walk").alias("mode"), nul.cast("string").alias("trip_id"), nul.cast("string").alias("route_id"), nul.cast("int").alias("direction_id"), nul.cast("string").alias("route_short_name"),
        frm.alias("from_id"), to.alias("to_id"), dep.alias("dep"), (dep + s).alias("arr"), F.greatest(F.lit(1).cast("long"), F.ceil(s / 60.0)).alias("minutes"), F.round(meters).alias("meters"),
    )


def _transit(leg: str, midnight: Column) -> Column:
    c = lambda n: F.col(f"{leg}_{n}")
    dep, arr = midnight + c("dep_s"), midnight + c("arr_s")
    return F.struct(
        F.lit("transit").alias("mode"), c("trip_id").alias("trip_id"), c("route_id").alias("route_id"), c("direction_id").cast("int").alias("direction_id"), F.col(f"{leg}_short").alias("route_short_name"),
        c("from_stop").alias("from_id"), c("to_stop").alias("to_id"), dep.alias("dep"), arr.alias("arr"), X.minutes_between(dep, arr).alias("minutes"), F.lit(None).cast("double").alias("meters"),
    )


def assemble_itineraries(candidates: DataFrame, requests: DataFrame, routes: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Candidates as arrays of legs with access, transfer and egress walks; rides that leave before the walk arrives are dropped."""
    for leg in ("leg1", "leg2"):
        candidates = candidates.join(routes.select(F.col("route_id").alias(f"{leg}_route_id"), F.col("route_short_name").alias(f"{leg}_short")), f"{leg}_route_id", "left")
    asked = requests.select("request_id", "origin_id", "destination_id", _requested(cfg).alias("requested"))
    c = candidates.join(asked, "request_id").withColumn("midnight", X.epoch(F.to_utc_timestamp(F.col("service_date").cast("timestamp"), cfg.timezone)))
    m, two = F.col("midnight"), F.col("kind") == "one_transfer"
    none = F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':') for x in LEG.split(', '))}>")
    first, second = _transit("leg1", m), _transit("leg2", m)
    access = F.when(F.col("access_m") > 0, _walk(F.col("origin_id"), F.col("leg1_from_stop"), F.col("requested"), F.col("access_m"), cfg.walking_mps)).otherwise(none)
    transfer = F.when(two, _walk(F.col("leg1_to_stop"), F.col("leg2_from_stop"), m + F.col("leg1_arr_s"), F.col("transfer_m"), cfg.walking_mps)).otherwise(none)
    last_stop = F.when(two, F.col("leg2_to_stop")).otherwise(F.col("leg1_to_stop"))
    last_arr = m + F.when(two, F.col("leg2_arr_s")).otherwise(F.col("leg1_arr_s"))
    egress = F.when(F.col("egress_m") > 0, _walk(last_stop, F.col("destination_id"), last_arr, F.col("egress_m"), cfg.walking_mps)).otherwise(none)
    legs = F.filter(F.array(access, first, transfer, F.when(two, second).otherwise(none), egress), lambda x: x.isNotNull())
    out = c.filter(m + F.col("leg1_dep_s") >= F.col("requested") + F.when(F.col("access_m") > 0, X.walk_seconds("access_m", cfg.walking_mps)).otherwise(0))
    out = out.select("request_id", "requested", F.col("kind"), legs.alias("legs"))
    out = out.withColumn("dep", F.col("legs")[0]["dep"]).withColumn("arr", F.element_at("legs", -1)["arr"])
    return out.select(
        "request_id", "requested", "kind", "legs", "dep", "arr", X.minutes_between("requested", "arr").alias("total_minutes"), X.minutes_between("requested", "dep").alias("waiting_minutes"),
        F.when(F.col("kind") == "direct", 0).otherwise(1).alias("transfers"), _itinerary_id().alias("itinerary_id"),
    )


def _itinerary_id() -> Column:
    """A name made of all legs with their times: a trip may serve the same two stops twice."""
    times = F.transform("legs", lambda x: F.concat_ws("-", x["dep"].cast("string"), x["arr"].cast("string")))
    return F.md5(F.concat_ws("@", _signature(False), F.array_join(times, " ")))


def _requested(cfg: TransitConfig) -> Column:
    return X.epoch(F.to_utc_timestamp(F.col("service_date").cast("timestamp"), cfg.timezone)) + F.col("departure_s")


def prediction_asof_join(legs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per leg (``leg_id, route_id, direction_id, dep``) the prediction nearest in target time within 90 minutes, the newest first.

    The range becomes an equality on 90-minute buckets and their neighbours; a null direction matches any.
    """
    span = 5400
    p = predictions.select(F.col("route_id"), F.col("direction_id").alias("p_dir"), X.epoch("target_time").alias("target"), X.epoch("prediction_time").alias("made"), "predicted_delay_sec", "confidence")
    p = p.withColumn("b", F.explode(F.array(*[F.floor(F.col("target") / span) + d for d in (-1, 0, 1)])))
    l = legs.withColumn("b", F.floor(F.col("dep") / span))  # noqa: E741
    j = l.join(p, ["route_id", "b"]).filter((F.abs(F.col("target") - F.col("dep")) <= span) & (F.col("direction_id").isNull() | F.col("p_dir").isNull() | (F.col("direction_id") == F.col("p_dir"))))
    order = F.struct(F.abs(F.col("target") - F.col("dep")).alias("d"), (-F.col("made")).alias("m"), (-F.col("target")).alias("t"), F.coalesce("p_dir", F.lit(-1)).alias("p"))
    return j.groupBy("leg_id").agg(F.min_by(F.struct(X.clamp_delay("predicted_delay_sec").alias("seconds"), "confidence"), order).alias("x")).select("leg_id", "x.*")


def history_feature_profile(features: DataFrame, as_of: Column) -> DataFrame:
    recent = X.recent_filter(features.filter("avg_delay_sec is not null"), "feature_time", as_of, 60 * 86400)
    out = recent.groupBy("route_id", "direction_id", "hour_of_day", "day_of_week").agg(F.avg("avg_delay_sec").alias("delay_sec"), F.sum("observation_count").alias("observations"))
    return out.withColumn("confidence", F.least(F.lit(0.85), 0.35 + F.col("observations") / 200.0))


def history_event_profile(events: DataFrame, as_of: Column, tz: str) -> DataFrame:
    recent = X.recent_filter(events, "observed_time", as_of, 60 * 86400)
    cal = X.calendar_features("scheduled_time", tz)
    out = recent.groupBy("route_id", "direction_id", cal["hour_of_day"].alias("hour_of_day"), cal["day_of_week"].alias("day_of_week"))
    out = out.agg(F.avg("delay_sec").alias("delay_sec"), F.count(F.lit(1)).alias("observations"))
    return out.withColumn("confidence", F.least(F.lit(0.7), 0.25 + F.col("observations") / 300.0))


def history_profile_join(legs: DataFrame, profile: DataFrame, tz: str, base: float, top: float, per: float) -> DataFrame:
    """Per leg the observation-weighted mean of the profile's rows for its route, hour and day; a null direction matches any."""
    cal = X.calendar_features(F.timestamp_seconds("dep"), tz)
    l = legs.select("leg_id", "route_id", F.col("direction_id").alias("l_dir"), cal["hour_of_day"].alias("hour_of_day"), cal["day_of_week"].alias("day_of_week"))  # noqa: E741
    j = l.join(profile, ["route_id", "hour_of_day", "day_of_week"]).filter("l_dir is null or direction_id is null or l_dir = direction_id")
    out = j.groupBy("leg_id").agg((F.sum(F.col("delay_sec") * F.col("observations")) / F.sum("observations")).alias("d"), F.sum("observations").alias("observations"))
    return out.select("leg_id", X.clamp_delay("d").alias("seconds"), F.least(F.lit(top), base + F.col("observations") / per).alias("confidence"))


def leg_delay_estimate(legs: DataFrame, predictions: DataFrame, features: DataFrame, events: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """``leg_id, seconds, source, confidence``: prediction, else feature history, else event history, else the timetable."""
    out = legs.select("leg_id")
    parts = [
        ("model_prediction", prediction_asof_join(legs, predictions)),
        ("historical_feature_windows", history_profile_join(legs, history_feature_profile(features, as_of), tz, 0.35, 0.85, 200.0)),
        ("historical_stop_events", history_profile_join(legs, history_event_profile(events, as_of, tz), tz, 0.25, 0.7, 300.0)),
    ]
    for k, (_, p) in enumerate(parts):
        out = out.join(p.select("leg_id", F.struct("seconds", "confidence").alias(f"p{k}")), "leg_id", "left")
    pick = lambda f: F.coalesce(*[F.col(f"p{k}.{f}") for k in range(3)])
    source = F.coalesce(*[F.when(F.col(f"p{k}").isNotNull(), name) for k, (name, _) in enumerate(parts)], F.lit("static_schedule"))
    return out.select("leg_id", F.coalesce(pick("seconds"), F.lit(0)).alias("seconds"), source.alias("source"), pick("confidence").alias("confidence"))


def apply_expected_delays(itineraries: DataFrame, estimate) -> DataFrame:
    """Shift legs by the running sum of the estimated delays.  ``estimate`` maps a frame of legs to ``leg_id, seconds, source``.

    Rides of one route and direction that leave together are one leg to estimate, however many itineraries use them.  Itineraries meet the
    estimates of their rides by request and are shuffled for that alone; what follows by request finds them together.
    """
    own = stored(itineraries.filter(F.size("legs") > 0).withColumn("_i", F.monotonically_increasing_id()), "assembled")
    leg_id = F.concat_ws("|", "leg.route_id", F.coalesce(F.col("leg.direction_id").cast("string"), F.lit("-")), "leg.dep")
    legs = own.select("request_id", "_i", F.posexplode("legs").alias("pos", "leg")).filter("leg.mode <> 'walk'").withColumn("leg_id", leg_id)
    rides = stored(legs.select("leg_id", "leg.route_id", "leg.direction_id", "leg.dep").distinct(), "legs")
    known = legs.select("request_id", "_i", "pos", "leg_id").join(estimate(rides).select("leg_id", F.col("seconds").cast("long").alias("seconds"), "source"), "leg_id")
    known = known.groupBy("request_id").agg(F.collect_list(F.struct("_i", "pos", "seconds", "source")).alias("_known"))
    mine = F.filter(F.coalesce("_known", F.array()), lambda k: k["_i"] == F.col("_i"))
    out = own.join(known, "request_id", "left").withColumn("_known", mine)
    late = lambda upto: F.aggregate(F.filter("_known", upto), F.lit(0).cast("long"), lambda n, k: n + F.coalesce(k["seconds"], F.lit(0)))
    dep = lambda leg, pos: leg["dep"] + late(lambda k: k["pos"] < pos)
    arr = lambda leg, pos: leg["arr"] + late(lambda k: k["pos"] <= pos)
    expected = F.transform("legs", lambda leg, pos: F.struct(pos.alias("pos"), dep(leg, pos).alias("expected_dep"), arr(leg, pos).alias("expected_arr")))
    sources = F.array_sort(F.array_distinct(F.array_compact(F.transform("_known", lambda k: k["source"]))))
    out = out.withColumn("expected_legs", expected).withColumn("expected_arr", F.element_at("expected_legs", -1)["expected_arr"]).withColumn("sources", sources).drop("_i", "_known")
    out = out.withColumn("expected_minutes", X.minutes_between("requested", "expected_arr"))
    return out.withColumn("expected_delay_minutes", F.bround((F.col("expected_arr") - F.col("arr")) / 60.0).cast("long"))


def _signature(transit_only: bool) -> Column:
    """What makes two itineraries alike, as text: routes and directions of the rides, or modes, trips and ends of all legs."""
    text = lambda x, *names: F.concat_ws("/", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])
    if transit_only:
        return F.array_join(F.transform(F.filter("legs", lambda x: x["mode"] != "walk"), lambda x: text(x, "route_id", "direction_id", "route_short_name")), " ")
    return F.array_join(F.transform("legs", lambda x: text(x, "mode", "trip_id", "from_id", "to_id")), " ")


def soft_filter_itineraries(itineraries: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Within equal ride sequences, drop those that walk over 4 minutes more than the lightest without gaining 3 minutes."""
    first, last = F.col("legs")[0], F.element_at("legs", -1)
    walk = F.when(F.size("legs") > 1, F.when(first["mode"] == "walk", first["minutes"]).otherwise(0) + F.when(last["mode"] == "walk", last["minutes"]).otherwise(0)).otherwise(0)
    i = itineraries.withColumn("_sig", _signature(True)).withColumn("_walk", walk)
    w = Window.partitionBy("request_id", "_sig")
    i = i.withColumn("_best", F.min(F.struct("_walk", "expected_minutes")).over(w))
    keep = (F.col("_walk") - F.col("_best._walk") <= cfg.walk_slack_min) | (F.col("_best.expected_minutes") - F.col("expected_minutes") >= cfg.time_gain_min)
    return i.filter(keep).drop("_sig", "_walk", "_best")


def walking_itineraries(requests: DataFrame, ends: DataFrame, transit: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Straight walks worth showing: short ones that no ride beats, ones that beat every ride clearly, or the only way."""
    at = lambda side, p: ends.filter(F.col("side") == side).select("request_id", F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon")).distinct()
    r = requests.select("request_id", "origin_id", "destination_id", _requested(cfg).alias("requested")).join(at("origin", "a"), "request_id").join(at("destination", "b"), "request_id")
    meters = X.equirect_distance_m("a_lat", "a_lon", "b_lat", "b_lon")
    r = r.withColumn("legs", F.array(_walk(F.col("origin_id"), F.col("destination_id"), F.col("requested"), meters, cfg.walking_mps)))
    r = r.withColumn("arr", F.col("legs")[0]["arr"]).withColumn("expected_minutes", X.minutes_between("requested", "arr"))
    best = transit.groupBy("request_id").agg(F.min("expected_minutes").alias("best"))
    r = r.join(best, "request_id", "left")
    m = F.col("expected_minutes")
    ok = F.when(F.col("best").isNull(), m <= cfg.max_walk_only_min).when(m <= cfg.walk_first_max_min, m <= F.col("best")).otherwise(F.col("best") - m >= cfg.walk_gain_min)
    return r.filter(ok).select(
        "request_id", _itinerary_id().alias("itinerary_id"), "requested", F.lit("walk").alias("kind"), "legs", F.col("requested").alias("dep"), "arr",
        F.col("expected_minutes").alias("total_minutes"), F.lit(0).cast("long").alias("waiting_minutes"), F.lit(0).alias("transfers"), F.col("arr").alias("expected_arr"),
        F.array(F.struct(F.lit(0).alias("pos"), F.col("requested").alias("expected_dep"), F.col("arr").alias("expected_arr"))).alias("expected_legs"),
        F.array(F.lit("walking")).alias("sources"), "expected_minutes", F.lit(0).cast("long").alias("expected_delay_minutes"),
    )


def itinerary_dedupe_topk(itineraries: DataFrame, k: int = DEFAULT.itineraries) -> DataFrame:
    """By expected arrival, transfers and departure: the first of each leg signature, then the first ``k`` of each request."""
    order = ["expected_arr", "transfers", "dep", "itinerary_id"]
    same = Window.partitionBy("request_id", "_sig").orderBy(*order)
    i = itineraries.withColumn("_sig", _signature(False)).withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return i.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).filter(F.col("rank") <= k).drop("_sig", "_n")


def with_geometry(itineraries: DataFrame, ends: DataFrame, trips: DataFrame, stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """``geometries``: the path of each leg, one array of [lat, lon] for each of ``legs``; a walk is a straight line.

    A path is made once for each shape and pair of points, and only for the itineraries at hand.
    """
    one = ["request_id", "itinerary_id"]
    legs = itineraries.select(*one, F.posexplode("legs").alias("pos", "leg")).select(*one, "pos", "leg.mode", "leg.trip_id", "leg.from_id", "leg.to_id")
    legs = legs.join(trips.select("trip_id", "shape_id"), "trip_id", "left")
    spots = stops.select(F.col("stop_id").alias("id"), F.struct(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")).alias("at"))
    asked = ends.select("request_id", F.col("endpoint_id").alias("id"), F.struct("lat", "lon").alias("own")).distinct()
    for side in ("from", "to"):
        legs = legs.withColumnRenamed(f"{side}_id", "id").join(asked, ["request_id", "id"], "left").join(spots, "id", "left")
        # A walk from or to an endpoint meets the endpoint itself, a ride its stop.
        point = F.when(F.col("mode") == "walk", F.coalesce("own", "at")).otherwise(F.col("at"))
        legs = legs.withColumn(f"{side}_lat", point["lat"]).withColumn(f"{side}_lon", point["lon"]).drop("id", "own", "at")
    corners = ["from_lat", "from_lon", "to_lat", "to_lon"]
    legs = stored(legs.withColumn("path_id", F.concat_ws("|", F.coalesce("shape_id", F.lit("")), *corners)), "drawn_legs")
    paths = leg_geometry(legs.select(F.col("path_id").alias("leg_id"), "shape_id", *corners).distinct(), shapes)
    drawn = legs.join(paths.withColumnRenamed("leg_id", "path_id"), "path_id", "left")
    drawn = drawn.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("pos", "geometry"))).alias("g"))
    return itineraries.join(drawn.select(*one, F.col("g.geometry").alias("geometries")), one)


def plan_trips(requests: DataFrame, timetable: dict[str, DataFrame], predictions: DataFrame, features: DataFrame, events: DataFrame, as_of: Column, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """At most ``itineraries`` per request, best first, with expected times; with ``shapes`` in the timetable, also with ``geometries``."""
    t = timetable
    search = prepared_search(requests, stop_places(t["stops"]), t["calendar"], t["trips"], t["stop_times"], cfg)
    ends, found = search[0], found_itineraries(search, t["stops"], cfg)
    found = assemble_itineraries(found, requests, t["routes"], cfg)
    found = apply_expected_delays(found, lambda legs: leg_delay_estimate(legs, predictions, features, events, as_of, cfg.timezone))
    # The first rides of a request, found while it lies together, are all that can be among its first itineraries: walks only take places of theirs,
    # and the soonest ride, with which walks are compared, is one of them.
    found = stored(itinerary_dedupe_topk(soft_filter_itineraries(found, cfg), cfg.itineraries).drop("rank"), "itineraries")
    best = itinerary_dedupe_topk(found.unionByName(walking_itineraries(requests, ends, found, cfg)), cfg.itineraries)
    return with_geometry(stored(best, "best"), ends, search[2], t["stops"], t["shapes"]) if "shapes" in t else best


# --- shapes and map ------------------------------------------------------------------------------------------------------


SPOT = ["shape_id", "lat", "lon"]


def _shape_index(shapes: DataFrame, cell_m: float) -> DataFrame:
    """The positions of each shape with the first sequence number there, and the cell ``cy, cx`` that each lies in."""
    step = cell_m / X.METERS_PER_DEGREE
    some = shapes.filter("shape_pt_lat is not null and shape_pt_lon is not null and shape_pt_sequence is not null")
    at = some.groupBy("shape_id", "shape_pt_lat", "shape_pt_lon").agg(F.min("shape_pt_sequence").alias("shape_pt_sequence"))
    return at.withColumn("cy", F.floor(F.col("shape_pt_lat") / step)).withColumn("cx", F.floor(F.col("shape_pt_lon") / step))


def _ring(spots: DataFrame, index: DataFrame, cell_m: float) -> DataFrame:
    """Each spot with the indexed positions of the nine cells around it; a spot with none there keeps its rows."""
    step = cell_m / X.METERS_PER_DEGREE
    around = F.expr("flatten(transform(array(-1,0,1), dy -> transform(array(-1,0,1), dx -> struct(dy, dx))))")
    near = spots.withColumn("o", F.explode(around))
    near = near.withColumn("cy", F.floor(F.col("lat") / step) + F.col("o.dy")).withColumn("cx", F.floor(F.col("lon") / step) + F.col("o.dx")).drop("o")
    return near.join(index, ["shape_id", "cy", "cx"], "left")


def _reachable(spots: DataFrame, index: DataFrame) -> DataFrame:
    """Cells that may hold the nearest position of a spot: those whose box is no farther than the farthest corner of the best box.

    ``spots`` may bring ``best``, the distance of some position already met, as a further bound.
    """
    edges = [F.min("shape_pt_lat").alias("south"), F.max("shape_pt_lat").alias("north"), F.min("shape_pt_lon").alias("west"), F.max("shape_pt_lon").alias("east")]
    b = spots.join(index.groupBy("shape_id", "cy", "cx").agg(*edges), "shape_id")
    near = X.equirect_distance_m("lat", "lon", F.greatest("south", F.least("north", "lat")), F.greatest("west", F.least("east", "lon")))
    farther = lambda v, lo, hi: F.when(F.abs(F.col(v) - F.col(lo)) > F.abs(F.col(v) - F.col(hi)), F.col(lo)).otherwise(F.col(hi))
    far = X.equirect_distance_m("lat", "lon", farther("lat", "south", "north"), farther("lon", "west", "east"))
    b = b.withColumn("near", near).withColumn("bound", F.least(F.min(far).over(Window.partitionBy(*SPOT)), "best"))
    return b.filter(F.col("near") <= F.col("bound") * X.CELL_SLACK).select(*SPOT, "cy", "cx")


def nearest_on_shapes(spots: DataFrame, shapes: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Per distinct ``shape_id, lat, lon`` the sequence of the nearest shape point, the first among equals.

    A spot meets the positions of the nine cells around its own.  What lies outside them is at least one cell's width away, east
    and west measured at the spot's latitude; so a position found nearer than that is the nearest of all.  Only the other spots
    go on: they meet the boxes of their shape's cells, and then the positions of those cells that the bounds leave.
    A spot or shape point without a position, and a shape without points, give no row.
    """
    index = _shape_index(shapes, cfg.shape_cell_m)
    spots = spots.select(*SPOT).filter("shape_id is not null and lat is not null and lon is not null").distinct()
    meters = X.equirect_distance_m("lat", "lon", "shape_pt_lat", "shape_pt_lon")
    first = F.min(F.when(meters.isNotNull(), F.struct(meters.alias("meters"), "shape_pt_sequence"))).alias("first")
    ringed = stored(_ring(spots, index, cfg.shape_cell_m).groupBy(*SPOT).agg(first), "ringed")
    proven = F.coalesce(F.col("first.meters") * X.CELL_SLACK < cfg.shape_cell_m * F.cos(F.radians("lat")), F.lit(False))
    rest = _reachable(ringed.filter(~proven).select(*SPOT, F.col("first.meters").alias("best")), index)
    rest = rest.join(index, ["shape_id", "cy", "cx"]).groupBy(*SPOT).agg(first)
    return ringed.filter(proven).unionByName(rest).select(*SPOT, "first.shape_pt_sequence")


def nearest_shape_index(points: DataFrame, shapes: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Per point (``point_id, shape_id, lat, lon``) the sequence of the nearest shape point, the first among equals."""
    return points.join(nearest_on_shapes(points, shapes, cfg), SPOT).select("point_id", "shape_id", "shape_pt_sequence")


def shape_parts(shapes: DataFrame, size: int = DEFAULT.shape_part) -> DataFrame:
    """Shapes of two points or more in parts of ``size`` points: ``shape_id, part`` and ``pts``, an array of (n, y, x) in order.

    ``n`` numbers a shape's points from 0 without gaps, whatever its sequence numbers are.
    """
    one = Window.partitionBy("shape_id")
    p = shapes.filter("shape_id is not null and shape_pt_lat is not null and shape_pt_lon is not null and shape_pt_sequence is not null")
    p = p.withColumn("n", F.row_number().over(one.orderBy("shape_pt_sequence", "shape_pt_lat", "shape_pt_lon")) - 1)
    p = p.withColumn("of", F.count(F.lit(1)).over(one)).filter("of >= 2")
    point = F.struct("n", F.col("shape_pt_lat").alias("y"), F.col("shape_pt_lon").alias("x"))
    return p.groupBy("shape_id", F.floor(F.col("n") / size).alias("part")).agg(F.sort_array(F.collect_list(point)).alias("pts"))


def leg_geometry(legs: DataFrame, shapes: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """``leg_id`` and its path: the shape between the points nearest to both ends (reversed if travelled backwards), with the ends.

    ``legs``: ``leg_id, shape_id, from_lat, from_lon, to_lat, to_lon``, one row a leg.  A shape of fewer than two points gives a
    straight line, and so does an end without a position.  A leg meets only those parts of its shape that it runs through.
    """
    parts = stored(shape_parts(shapes, cfg.shape_part), "shapes")
    flat = parts.select("shape_id", F.explode("pts").alias("p"))
    flat = flat.select("shape_id", F.col("p.n").alias("shape_pt_sequence"), F.col("p.y").alias("shape_pt_lat"), F.col("p.x").alias("shape_pt_lon"))
    side = lambda e: [f"{e}_lat", f"{e}_lon"]
    spot = lambda e: legs.select("shape_id", *[F.col(c).alias(n) for c, n in zip(side(e), ("lat", "lon"), strict=True)])
    at = nearest_on_shapes(spot("from").unionByName(spot("to")), flat, cfg)
    run = legs.withColumn("leg_id", F.col("leg_id").cast("string"))
    for e in ("from", "to"):
        names = dict(zip(("lat", "lon", "shape_pt_sequence"), (*side(e), f"{e}_n"), strict=True))
        run = run.join(at.withColumnsRenamed(names), ["shape_id", *side(e)])
    lo, hi = F.least("from_n", "to_n"), F.greatest("from_n", "to_n")
    run = run.select("leg_id", "shape_id", lo.alias("lo"), hi.alias("hi"), (F.col("from_n") > F.col("to_n")).alias("back"))
    run = run.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / cfg.shape_part), F.floor(F.col("hi") / cfg.shape_part))))
    run = run.join(parts, ["shape_id", "part"]).withColumn("pts", F.filter("pts", lambda p: p["n"].between(F.col("lo"), F.col("hi"))))
    run = run.groupBy("leg_id", "back").agg(F.flatten(F.sort_array(F.collect_list("pts"))).alias("pts"))
    inner = F.transform(F.when(F.col("back"), F.reverse("pts")).otherwise(F.col("pts")), lambda p: F.array(p["y"], p["x"]))
    l = legs.withColumn("leg_id", F.col("leg_id").cast("string")).join(run.select("leg_id", inner.alias("inner")), "leg_id", "left")  # noqa: E741
    ends = [F.array(F.array(*side(e))) for e in ("from", "to")]
    l = l.withColumn("_g", F.concat(ends[0], F.coalesce("inner", F.array().cast("array<array<double>>")), ends[1]))  # noqa: E741
    return l.select("leg_id", F.filter("_g", lambda p, i: (i == 0) | (p != F.get("_g", i - 1))).alias("geometry"))


def map_stop_clusters(places: DataFrame, zoom: int, keep_below: int = 120) -> DataFrame:
    """Stop places as map features: clustered by screen cell unless the zoom is high or there are few."""
    own = ["name", "stop_ids", "names"]  # of single places; a cluster has none of its own
    single = places.select(F.lit("stop").alias("type"), F.col("place_id").alias("id"), "lat", "lon", F.col("stop_count").alias("count"), F.lit(1).cast("long").alias("place_count"), *own)
    few = places.limit(keep_below + 1).count() <= keep_below
    if zoom >= 17 or few:
        return single
    radius = 96 if zoom <= 11 else 78 if zoom <= 13 else 58 if zoom <= 15 else 40
    xy = X.web_mercator_xy("lat", "lon", F.lit(zoom))
    p = places.withColumn("gx", F.floor(xy["x"] / radius)).withColumn("gy", F.floor(xy["y"] / radius))
    g = p.groupBy("gx", "gy").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum("stop_count").alias("count"), F.count(F.lit(1)).alias("place_count"), F.min(F.struct("place_id", *own)).alias("only"))
    lone = F.col("place_count") == 1
    cell = F.concat_ws(":", F.lit("cluster"), F.lit(str(zoom)), F.col("gx").cast("string"), F.col("gy").cast("string"))
    return g.select(F.when(lone, "stop").otherwise("cluster").alias("type"), F.when(lone, F.col("only.place_id")).otherwise(cell).alias("id"), "lat", "lon", "count", "place_count", *[F.when(lone, F.col(f"only.{c}")).alias(c) for c in own])
