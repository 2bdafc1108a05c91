"""Operators on small hand-made tables, and the plans of the large joins."""

from __future__ import annotations

from dataclasses import replace

import re

import pytest
from pyspark.sql import functions as F

from tramline.config import DEFAULT
from tramline.operators import matching, ml, planner, telemetry, views
from tramline.plans import fixtures, registry
from tramline.sources import gtfs, sinks
from tramline.sources import telemetry as feeds

UTC = replace(DEFAULT, timezone="UTC")
FIX = "event_id long, vehicle_id string, route_id string, direction_id int, latitude double, longitude double, epoch_s long"


def fixes(spark, rows):
    return spark.createDataFrame(rows, FIX).withColumn("event_time", F.timestamp_seconds("epoch_s"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bunching_edges(spark):
    t = fixes(spark, [(1, "a", "r", 0, 44.4, 26.1, 1000), (2, "b", "r", 0, 44.4, 26.1, 1030), (3, "c", "r", 0, 44.4, 26.1, 1061), (4, "d", "r", None, 44.4, 26.1, 1000), (5, "e", "q", 0, 44.4, 26.1, 1000)])
    got = {(r["vehicle_a_id"], r["vehicle_b_id"], r["gap_seconds"]) for r in telemetry.bunching_events(t).collect()}
    assert got == {("a", "b", 30.0)}
    assert "Cartesian" not in plan_of(telemetry.bunching_events(t))
    assert "NestedLoop" not in plan_of(telemetry.bunching_events(t))


def test_segments_exclude_limits(spark):
    t = fixes(spark, [(k, "v", "r", 0, 44.4 + lat, 26.1, s) for k, (lat, s) in enumerate([(0, 0), (0.001, 5), (0.002, 305), (0.003, 365), (0.003, 425), (0.2, 485)])])
    assert [(r["dt"], round(r["speed_kmh"], 2)) for r in telemetry.consecutive_fix_lag(t).collect()] == [(60, 6.68)]


def test_gap_between_events(spark):
    t = fixes(spark, [(1, "a", "r", 0, 44.4, 26.1, 0), (2, "b", "r", 0, 44.4, 26.1, 600), (3, "b", "r", 0, 44.4, 26.1, 1201), (4, "a", "r", None, 44.4, 26.1, 0), (5, "a", "r", None, 44.4, 26.1, 900)])
    got = sorted((r["direction_id"] is None, r["gap_duration_sec"]) for r in telemetry.service_gap_between_events(t).collect())
    assert got == [(False, 601.0), (True, 900.0)]


@pytest.fixture(scope="module")
def timetable(spark):
    trips = spark.createDataFrame([("t1", "r", "s", 0), ("t2", "r", "s", 1), ("t3", "r", "off", 0)], "trip_id string, route_id string, service_id string, direction_id int")
    cal = spark.createDataFrame([("s", *[1] * 7), ("off", *[0] * 7)], "service_id string, " + ", ".join(f"{d} int" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")))
    cal = cal.withColumn("start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.lit("2024-12-31").cast("date"))
    times = spark.createDataFrame([("t1", 1, "A", 28800, 28800), ("t1", 2, "B", None, 29400), ("t2", 1, "B", 28800, None), ("t3", 1, "A", 28800, 28800)], "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int")
    stops = spark.createDataFrame([("A", 44.4, 26.1), ("B", 44.41, 26.1)], "stop_id string, stop_lat double, stop_lon double")
    return {"trips": trips, "calendar": cal, "stop_times": times, "stops": stops}


def match(spark, timetable, rows, cfg=UTC):
    p = fixes(spark, [r[:7] for r in rows]).join(spark.createDataFrame([(r[0], r[7]) for r in rows], "event_id long, trip_start_time string"), "event_id")
    return {r["event_id"]: r for r in matching.best_match_per_position(matching.match_candidates(p, timetable["trips"], timetable["calendar"], timetable["stop_times"], timetable["stops"], cfg)).collect()}


DAY = 1717200000 + 0  # 2024-06-01 00:00 UTC


def test_matching_rules(spark, timetable):
    at = lambda k, lat, s, start="08:00:00", d=0: (k, "v", "r", d, lat, 26.1, DAY + s, start)
    got = match(spark, timetable, [
        at(1, 44.4, 28860), at(2, 44.4 + 74 / 111320, 28860), at(3, 44.4 + 76 / 111320, 28860), at(4, 44.4, 28800 + 5400), at(5, 44.4, 28800 + 5401), at(6, 44.4, 28860, "09:00:00"),
        at(7, 44.4, 28860, "broken"), at(8, 44.41, 29400), at(9, 44.41, 28800, d=None), at(10, 44.4, 28800 - 60),
    ])
    assert set(got) == {1, 2, 4, 7, 8, 9, 10}
    assert (got[1]["trip_id"], got[1]["delay_sec"], got[10]["delay_sec"]) == ("t1", 60.0, -60.0)
    assert got[7]["match_method"] == "route_direction_geofence" and got[1]["match_method"] == "trip_start_geofence"
    assert (got[9]["trip_id"], got[9]["delay_sec"]) == ("t2", 0.0)  # both trips stop there; the smaller delay wins


def test_match_plan_has_no_cartesian(spark, timetable):
    p = fixes(spark, [(1, "v", "r", 0, 44.4, 26.1, DAY)]).withColumn("trip_start_time", F.lit("08:00:00"))
    plan = plan_of(matching.match_candidates(p, timetable["trips"], timetable["calendar"], timetable["stop_times"], timetable["stops"], UTC))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_previous_service_day(spark):
    trips = spark.createDataFrame([("n", "r", "s", 0)], "trip_id string, route_id string, service_id string, direction_id int")
    cal = spark.createDataFrame([("s", *[1] * 7)], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int")
    cal = cal.withColumn("start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.lit("2024-12-31").cast("date"))
    times = spark.createDataFrame([("n", 1, "A", 91800, 91800)], "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int")
    table = {"trips": trips, "calendar": cal, "stop_times": times, "stops": spark.createDataFrame([("A", 44.4, 26.1)], "stop_id string, stop_lat double, stop_lon double")}
    row = [(1, "v", "r", 0, 44.4, 26.1, DAY + 5400, "25:30:00")]
    assert match(spark, table, row) == {}
    assert match(spark, table, row, replace(UTC, service_day_lookback=1))[1]["delay_sec"] == 0.0


def test_gtfs_load(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,extra\n1,Main,44.4,26.1,x\n2,,,26.2,y\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,stop_id,stop_sequence\nt,25:00:10,1,3\n")
    got = gtfs.gtfs_load(spark, str(tmp_path))
    assert set(got) == {"stops", "stop_times"}
    assert [(r["stop_name"], r["stop_lat"], r["parent_station"]) for r in got["stops"].orderBy("stop_id").collect()] == [("Main", 44.4, None), (None, None, None)]
    assert got["stop_times"].first()["arrival_time"] == 90010 and got["stop_times"].first()["departure_time"] is None


def test_insert_unique_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "k string, d int")
    assert sinks.insert_unique(df.filter("k = 'a'"), df, ("k", "d")).collect() == [("b", 1)]


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 86400), (3, 172800)], "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    sinks.write_partitioned(df, str(tmp_path / "t"), "ts")
    sinks.write_partitioned(df.filter("id = 2").withColumn("id", F.lit(20)), str(tmp_path / "t"), "ts", mode="overwrite")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["id"] for r in back.collect()) == [1, 3, 20]
    day = sinks.read_between(back, "ts", F.timestamp_seconds(F.lit(86400)), F.timestamp_seconds(F.lit(86401)))
    assert [r["id"] for r in day.collect()] == [20] and "PartitionFilters: [isnotnull(event_date" in plan_of(day)


def test_temporal_split(spark):
    rows = spark.createDataFrame([(3, "r"), (1, "r"), (2, "r")], "d int, route_id string").select(F.timestamp_seconds(F.col("d") * 86400).alias("feature_time"), "route_id", F.lit(0).alias("direction_id"))
    train, test = ml.temporal_split(rows, 1 / 3)
    day = lambda df: sorted(r["feature_time"].day - 1 for r in df.collect())
    assert (day(train), day(test)) == ([1, 2], [3])
    with pytest.raises(ValueError):
        ml.temporal_split(rows, 1.0)


def test_unlabelled_rows_are_skipped(spark):
    rows = spark.createDataFrame([("r", None, 1), ("r", 120.0, 2)], "route_id string, target_delay_sec double, vehicle_count int")
    rows = rows.withColumn("direction_id", F.lit(0)).withColumn("feature_time", F.timestamp_seconds(F.lit(0)))
    got = ml.build_training_dataset(rows).collect()
    assert len(got) == 1 and got[0]["target"] == 120.0


def test_leg_geometry_backwards(spark):
    shapes = spark.createDataFrame([("s", 44.0 + k / 100, 26.0, k) for k in range(5)], "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    legs = spark.createDataFrame([("1", "s", 44.03, 26.0, 44.01, 26.0), ("2", "none", 44.0, 26.0, 44.1, 26.0)], "leg_id string, shape_id string, from_lat double, from_lon double, to_lat double, to_lon double")
    got = {r["leg_id"]: r["geometry"] for r in planner.leg_geometry(legs, shapes).collect()}
    assert [round(p[0], 2) for p in got["1"]] == [44.03, 44.02, 44.01]
    assert got["2"] == [[44.0, 26.0], [44.1, 26.0]]


def test_no_service_gives_no_ride(spark, timetable):
    requests = spark.createDataFrame([(1, "A", "B", 28000)], "request_id long, origin_id string, destination_id string, departure_s int").withColumn("service_date", F.lit("2023-01-01").cast("date"))
    stops = timetable["stops"].withColumn("stop_name", F.col("stop_id")).withColumn("location_type", F.lit(0)).withColumn("parent_station", F.lit(""))
    ends = planner.resolve_endpoints(requests, planner.stop_places(stops), UTC)
    trips = timetable["trips"].withColumn("shape_id", F.lit(None).cast("string"))
    assert planner.direct_itineraries(ends, planner.service_windows(requests, timetable["calendar"]), trips, timetable["stop_times"], UTC).count() == 0
    on = requests.withColumn("service_date", F.lit("2024-06-01").cast("date"))
    got = planner.direct_itineraries(ends, planner.service_windows(on, timetable["calendar"]), trips, timetable["stop_times"], UTC).collect()
    assert [(r["leg1_trip_id"], r["leg1_arr_s"]) for r in got] == [("t1", 29400)]


def test_transfer_pairs_plan(spark, timetable):
    pairs = planner.transfer_stop_pairs(timetable["stops"])
    assert sorted((r[0], r[1]) for r in pairs.collect()) == [("A", "A"), ("B", "B")]
    assert "Cartesian" not in plan_of(pairs) and "NestedLoop" not in plan_of(pairs)


def test_geofence_wider_than_any_fixed_cell(spark, timetable):
    # 600 m to the north and 500 m to the east of stop A, with a geofence of a kilometre.
    at = [(1, "v", "r", 0, 44.4 + 600 / 111320, 26.1, DAY + 28860, "08:00:00"), (2, "v", "r", 0, 44.4, 26.1 + 500 / 75000, DAY + 28860, "08:00:00")]
    got = match(spark, timetable, at, replace(UTC, geofence_m=1000.0))
    assert {k: v["stop_id"] for k, v in got.items()} == {1: "B", 2: "A"}


def test_matching_over_a_clock_change(spark):
    # The clocks of the zone go forward on 2024-03-31 at 01:00 UTC: 04:30 is 01:30 UTC, and a fix 5,000 s before it reads 02:06:40.
    trips = spark.createDataFrame([("n", "r", "s", 0)], "trip_id string, route_id string, service_id string, direction_id int")
    cal = spark.createDataFrame([("s", *[1] * 7)], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int")
    cal = cal.withColumn("start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.lit("2024-12-31").cast("date"))
    times = spark.createDataFrame([("n", 2, "A", 16200, 16200)], "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int")
    table = {"trips": trips, "calendar": cal, "stop_times": times, "stops": spark.createDataFrame([("A", 44.4, 26.1)], "stop_id string, stop_lat double, stop_lon double")}
    night = 1711843200  # 2024-03-31 00:00 UTC
    rows = [(1, "v", "r", 0, 44.4, 26.1, night - 1800 + 5400, None), (2, "v", "r", 0, 44.4, 26.1, night + 5400 - 5000, None)]
    got = match(spark, table, rows, replace(DEFAULT, service_day_lookback=0))
    assert {k: (v["stop_sequence"], v["delay_sec"]) for k, v in got.items()} == {1: (2, -1800.0), 2: (2, -5000.0)}


def test_cycle_reads_the_look_back_only(spark, timetable, tmp_path):
    day = lambda k: DAY - k * 86400 + 28860
    p = fixes(spark, [(k, f"v{k}", "r", 0, 44.4, 26.1, day(k)) for k in range(5)]).withColumn("trip_start_time", F.lit("08:00:00"))
    whole = matching.match_stop_delay(p, timetable["trips"], timetable["calendar"], timetable["stop_times"], timetable["stops"], UTC)
    sinks.write_partitioned(whole.filter("vehicle_id <> 'v0'"), str(tmp_path / "matched"), "observed_time")
    matched = spark.read.parquet(str(tmp_path / "matched"))
    as_of = F.timestamp_seconds(F.lit(day(0) + 60))
    edge = sinks.since(as_of, UTC.match_lookback_s, UTC.feature_window_s)
    known = sinks.read_since(matched, "observed_time", edge)
    assert known.count() == 0 and "PartitionFilters: [isnotnull(event_date" in plan_of(known)
    from tramline.operators import telemetry as T

    metrics = {"speed": T.segment_speed(p), "bunching": T.bunching_events(p), "gaps": T.service_gap_between_events(p), "freshness": T.telemetry_freshness(p, F.lit(day(0)))}
    routes = spark.createDataFrame([("r", "R", 3)], "route_id string, route_short_name string, route_type int")
    old = matching.route_delay(whole).withColumn("avg_delay_sec", F.lit(-1.0))
    out = matching.matching_cycle(p, matched, timetable | {"routes": routes}, metrics, as_of, UTC, {"route_delay_metrics": old})
    assert [r["vehicle_id"] for r in out["stop_delay_events"].collect()] == ["v0"]
    assert sorted(r["avg_delay_sec"] for r in out["route_delay_metrics"].collect()) == [-1.0, -1.0, -1.0, -1.0, 60.0]
    assert out["realtime_feature_windows"].count() == 1


def test_insert_unique_takes_the_same_row_every_time(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 3)], "k string, v int")
    assert sinks.insert_unique(df.limit(0), df.repartition(3), ("k",)).collect() == [("a", 1)]


def test_sightings_exactly_the_gap_apart_are_one_session(spark):
    t = fixes(spark, [(1, "v", "r", 0, 44.4, 26.1, 0), (2, "v", "r", 0, 44.4, 26.1, 300), (3, "v", "r", 0, 44.4, 26.1, 601), (4, "v", "r", 1, 44.4, 26.1, 150)])
    assert sorted((r["direction_id"], r["reports"]) for r in telemetry.session_presence(t, 300).collect()) == [(0, 1), (0, 2), (1, 1)]


def test_a_trip_that_serves_two_stops_twice(spark):
    stops = spark.createDataFrame([("A", "A", 44.4, 26.1, 0, ""), ("B", "B", 44.42, 26.1, 0, "")], "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string")
    trips = spark.createDataFrame([("t", "r", "s", 0, None)], "trip_id string, route_id string, service_id string, direction_id int, shape_id string")
    cal = spark.createDataFrame([("s", *[1] * 7)], "service_id string, " + ", ".join(f"{d} int" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")))
    cal = cal.withColumn("start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.lit("2024-12-31").cast("date"))
    times = spark.createDataFrame([("t", k, "AB"[k % 2], 28800 + 600 * k, 28800 + 600 * k) for k in range(4)], "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int")
    routes = spark.createDataFrame([("r", "R", 3)], "route_id string, route_short_name string, route_type int")
    shapes = spark.createDataFrame([], "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    asked = spark.createDataFrame([(1, "A", "B", 28000)], "request_id long, origin_id string, destination_id string, departure_s int").withColumn("service_date", F.lit("2024-06-03").cast("date"))
    predictions = spark.createDataFrame([], "route_id string, direction_id int, target_time timestamp, prediction_time timestamp, predicted_delay_sec double, confidence double")
    features = spark.createDataFrame([], "feature_time timestamp, route_id string, direction_id int, hour_of_day int, day_of_week int, avg_delay_sec double, observation_count long")
    events = spark.createDataFrame([], "observed_time timestamp, scheduled_time timestamp, route_id string, direction_id int, delay_sec double")
    table = {"trips": trips, "calendar": cal, "stop_times": times, "stops": stops, "routes": routes, "shapes": shapes}
    got = planner.plan_trips(asked, table, predictions, features, events, F.timestamp_seconds(F.lit(DAY)), UTC).orderBy("rank").collect()
    assert [(r["kind"], (r["dep"] - 1717372800) // 60, (r["arr"] - 1717372800) // 60) for r in got] == [("walk", 466, 496), ("direct", 480, 490)] or got[0]["kind"] == "direct"
    rides = [r for r in got if r["kind"] == "direct"]
    assert len({r["itinerary_id"] for r in got}) == len(got) and rides[0]["geometries"] == [[[44.4, 26.1], [44.42, 26.1]]]
    found = planner.direct_itineraries(planner.resolve_endpoints(asked, planner.stop_places(stops), UTC), planner.service_windows(asked, cal), trips, times, UTC)
    assert sorted((r["leg1_from_seq"], r["leg1_to_seq"]) for r in found.collect()) == [(0, 1), (0, 3), (2, 3)]


def test_search_plans_have_no_nested_loops(spark, timetable):
    asked = spark.createDataFrame([(1, "A", "B", 28000)], "request_id long, origin_id string, destination_id string, departure_s int").withColumn("service_date", F.lit("2024-06-01").cast("date"))
    stops = timetable["stops"].withColumn("stop_name", F.col("stop_id")).withColumn("location_type", F.lit(0)).withColumn("parent_station", F.lit(""))
    trips = timetable["trips"].withColumn("shape_id", F.lit(None).cast("string"))
    ends, windows = planner.resolve_endpoints(asked, planner.stop_places(stops), UTC), planner.service_windows(asked, timetable["calendar"])
    plan = plan_of(planner.one_transfer_join(ends, windows, trips, timetable["stop_times"], stops, UTC))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert re.search(r"Join \[service_date#\d+, to_stop#\d+, _b#\d+L?\]", plan), "arrivals are met by stretch of the day"


def test_transfer_search_stops_at_the_kth_arrival(spark, monkeypatch):
    """A line to a hub every ten minutes, and ten lines on from it: same rows as the whole search, from fewer last rides."""
    trips, times = [], []
    for k in range(60):
        trips.append((f"a{k}", "A", 0, "S", None))
        times += [(f"a{k}", 0, "O", 28800 + k * 300, 28800 + k * 300), (f"a{k}", 1, "H", 29400 + k * 300, 29400 + k * 300)]
        for line in range(4):
            trips.append((f"b{k}-{line}", f"B{line}", 0, "S", None))
            times += [(f"b{k}-{line}", 0, "H", 29600 + k * 300 + line, 29600 + k * 300 + line), (f"b{k}-{line}", 1, "D", 30200 + k * 300 + line * 7, 30200 + k * 300 + line * 7)]
    trips.append(("lone", "L", 0, "S", None))
    times += [("lone", 0, "H", 31000, 31000), ("lone", 1, "E", 40000, 40000)]
    trips = spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int, service_id string, shape_id string")
    times = spark.createDataFrame(times, "trip_id string, stop_sequence int, stop_id string, arrival_s long, departure_s long")
    stops = spark.createDataFrame([(s, s, 44.0 + k, 26.0, 0, "") for k, s in enumerate("OHDE")], "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string")
    calendar = spark.createDataFrame([("S", *[1] * 7, "2024-01-01", "2024-12-31")], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string")
    asked = spark.createDataFrame([(1, "O", "D", 28000), (2, "O", "E", 28000)], "request_id long, origin_id string, destination_id string, departure_s int").withColumn("service_date", F.lit("2024-06-03").cast("date"))
    ends, windows = planner.resolve_endpoints(asked, planner.stop_places(stops), UTC), planner.service_windows(asked, calendar)
    read = []
    own = planner.last_rides
    monkeypatch.setattr(planner, "last_rides", lambda *a: read.append(own(*a).count()) or own(*a))
    whole = planner.top_per_request(planner.one_transfer_join(ends, windows, trips, times, stops, UTC), UTC.candidates, "leg2_arr_s", "leg1_dep_s")
    pruned = planner.one_transfer_itineraries(ends, windows, trips, times, stops, replace(UTC, probe_sample=1))
    sparse = planner.one_transfer_itineraries(ends, windows, trips, times, stops, replace(UTC, probe_sample=1, probe_s=60))
    cols = sorted(whole.columns)
    rows = lambda df: sorted(map(str, df.select(cols).collect()))
    assert rows(pruned) == rows(sparse) == rows(whole) and {r["request_id"] for r in whole.collect()} == {1, 2}
    assert len(read) == 6 and max(read[1], read[2] + read[3]) < read[0] / 2, read  # the whole; probe, near and far; a probe that says no, and one pass


def test_attribution_against_a_plain_version(spark):
    from tramline.functions import exprs as X

    rows = [(k, f"r{k % 3}", k % 2, float(k * k % 17), float(k % 5)) for k in range(30)]
    df = spark.createDataFrame(rows, "s long, route_id string, direction_id int, avg_delay_sec double, avg_speed_kmh double").withColumn("feature_time", F.timestamp_seconds("s"))
    weight = {"avg_delay_sec": 0.7, "avg_speed_kmh": 0.3}
    mean = lambda i: sum(r[i] for r in rows) / 30
    spread = lambda i: (sum((r[i] - mean(i)) ** 2 for r in rows) / 30) ** 0.5
    got = {(r["route_id"], r["direction_id"], r["feature_name"]): r for r in ml.feature_attribution(df, weight, F.timestamp_seconds(F.lit(99)), UTC).collect()}
    assert len(got) == 6 * len(X.FEATURE_COLUMNS)
    for route, d in {(r[1], r[2]) for r in rows}:
        last = max(r for r in rows if (r[1], r[2]) == (route, d))
        want = sorted((-weight[n] * abs(last[i] - mean(i)) / spread(i), n) for n, i in (("avg_delay_sec", 3), ("avg_speed_kmh", 4)))
        for rank, (score, name) in enumerate(want, 1):
            r = got[route, d, name]
            assert abs(r["contribution_score"] + score) < 1e-9 and (score == 0 or r["feature_rank"] == rank)


def test_model_is_saved_reported_and_replaced_by_the_baseline(spark, tmp_path):
    rows = [(k * 900, f"r{k % 4}", k % 2, float(k % 7), float(60 * (k % 7))) for k in range(80)]
    df = spark.createDataFrame(rows, "s long, route_id string, direction_id int, avg_delay_sec double, target_delay_sec double").withColumn("feature_time", F.timestamp_seconds("s")).withColumn("zone_id", F.lit("network"))
    path, as_of = str(tmp_path / "m"), F.timestamp_seconds(F.lit(79 * 900 + 60))
    plain = ml.score_saved(df, as_of, path, UTC).collect()
    assert {r["model_version"] for r in plain} == {UTC.warm_start_version} and len(plain) == 4
    model, report = ml.train_delay_model(ml.build_training_dataset(df), max_iter=5)
    ml.save_model(model, report, path)
    ml.save_model(model, report, path)  # replaces
    assert {r["metric"]: r["value"] for r in ml.read_report(spark, path).collect()} == {k: float(v) for k, v in report.items()} and report["train_rows"] == 64
    got = {(r["route_id"], r["direction_id"]): r for r in ml.score_saved(df, as_of, path, UTC).collect()}
    assert {r["model_version"] for r in got.values()} == {UTC.model_version} and all(r["confidence"] is None for r in got.values())
    want = {(r["route_id"], r["direction_id"]): r["prediction"] for r in model.transform(ml.build_training_dataset(df.filter(F.col("s") >= 76 * 900))).collect()}
    assert {k: r["predicted_delay_sec"] for k, r in got.items()} == want


def test_prepared_timetable_is_read_without_an_exchange(spark, timetable):
    fixes = spark.range(50).select(
        F.timestamp_seconds(F.lit(DAY + 8 * 3600) + F.col("id") * 60).alias("event_time"), F.col("id").cast("string").alias("vehicle_id"), F.when(F.col("id") % 7 == 0, "q").otherwise("r").alias("route_id"), F.lit(None).cast("int").alias("direction_id"),
        F.lit(44.4).alias("latitude"), F.lit(26.1).alias("longitude"), F.lit(None).cast("string").alias("trip_start_time"),
    )
    t = [timetable[k] for k in ("trips", "calendar", "stop_times", "stops")]
    visits = matching.prepare_timetable(*t, UTC)
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found, plain = matching.match_candidates(fixes, *t, UTC, visits), matching.match_candidates(fixes, *t, UTC)
        dealt = lambda df: len(re.findall(r"Exchange hashpartitioning\(route_id#\d+, stop_id#\d+, weekday#\d+, stretch#\d+L?", plan_of(df)))
        assert (dealt(found), dealt(plain)) == (1, 2), "only the fixes are dealt out"
        rows = sorted(map(str, found.collect()))
        assert rows and rows == sorted(map(str, plain.select(found.columns).collect()))
    finally:
        spark.conf.set(key, was)


def test_first_of_equal_keys_is_inserted(spark):
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None), ("b", 5, "x"), ("c", 1, "known")], "k string, line int, v string").repartition(4)
    got = gtfs.gtfs_insert_idempotent(spark.createDataFrame([("c", 0, "there")], "k string, line int, v string"), new, ["k"], "line")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "early"), ("b", 5, None)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tramline.sources import scratch

    conf = lambda **kw: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kw.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.shared_folder(conf(), "x")
    assert scratch.shared_folder(conf(spark_checkpoint_dir="hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")


def test_jdbc_sink(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    write = sinks.jdbc_sink(url, "facts", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    for k in range(2):
        write(spark.range(k * 10, k * 10 + 10), k)
    back = spark.read.format("jdbc").options(url=url, dbtable="facts", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").load()
    assert sorted(r[0] for r in back.collect()) == list(range(20))


def test_payload_sanitising(spark):
    raw = ['{"id":"1","vehicle":{"trip":{"routeId":"5"},"vehicle":{"id":"v"},"position":{"latitude":44.4,"longitude":"26.1"},"timestamp":7}}', '{"vehicle":{"trip":{"routeId":""},"position":{"latitude":1,"longitude":1}}}', "{oops", '{"vehicle":{"trip":{"routeId":"5"},"position":{"latitude":"x","longitude":1}}}']
    got = feeds.sanitize_vehicle_payload(spark.createDataFrame([(r,) for r in raw], "value string"), F.lit("now")).collect()
    assert len(got) == 1 and (got[0]["vehicle_id"], got[0]["longitude"], got[0]["license_plate"]) == ("v", 26.1, "")


def test_latest_rows_and_top(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "s long, k string").select(F.timestamp_seconds("s").alias("window_start"), "k")
    assert sorted(r["k"] for r in views.latest_rows(df).collect()) == ["b", "c"]


def test_repeated_sides_are_not_broadcast(spark):
    """Stops and places are repeated for nine cells, which Spark's estimates don't see; so are the files' sizes no measure of the rows in them."""
    stops = spark.createDataFrame([("1", 44.02, 25.52)], "stop_id string, stop_lat double, stop_lon double")
    plan = planner.transfer_stop_pairs(stops)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cy" in plan and "Broadcast" not in plan
    t = fixtures.load(spark, "/root/testdata/sf0.001")
    plan = matching.match_candidates(t["telemetry"], t["trips"], t["calendar"], t["stop_times"], t["stops"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cy" in plan and "BroadcastHashJoin [cy" not in plan
    assert float(spark.conf.get(fixtures.FILE_FACTOR[0])) == float(fixtures.FILE_FACTOR[1])


def test_locations_of_towns_far_out(spark):
    """The served area is a setting; the test towns' has no end in the east, where their number grows."""
    places = planner.stop_places(spark.createDataFrame([("1", "A", 44.4, 30.0, 0, "")], "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string"))
    asked = spark.createDataFrame([(1, "loc:44.401,30.001", "loc:46.0,30.0")], "request_id long, origin_id string, destination_id string")
    assert [(r["side"], r["stop_id"]) for r in planner.resolve_endpoints(asked, places, registry.CFG).collect()] == [("origin", "1")]
    assert planner.resolve_endpoints(asked, places, UTC).count() == 0


def test_the_timetable_meets_fixes_on_their_weekdays_only(spark):
    """Stop times are read once for a match, and visits of weekdays without fixes are not shuffled; first times and rows stay the same."""
    trips = spark.createDataFrame([("a", "r", 0, "mon"), ("b", "r", 1, "daily")], "trip_id string, route_id string, direction_id int, service_id string")
    stop_times = spark.createDataFrame([("a", 1, "s", None, 100), ("a", 2, "t", 200, 220), ("b", 3, "s", 300, None), ("b", 4, "t", None, None)], "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int")
    days = "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string"
    calendar = spark.createDataFrame([("mon", 1, 0, 0, 0, 0, 0, 0, "2023-12-01", "2024-03-01"), ("daily", 1, 1, 1, 1, 1, 1, 1, "2023-12-01", "2024-03-01")], days)
    rows = lambda *weekdays: sorted((r["trip_id"], r["stop_sequence"], r["weekday"], r["scheduled_s"], r["first_s"]) for r in matching.keyed_visits(trips, calendar, stop_times, UTC, *weekdays).collect())
    monday = [("a", 1, 0, 100, 100), ("a", 2, 0, 200, 100), ("b", 3, 0, 300, 300)]
    assert rows(spark.createDataFrame([(0,)], "weekday int")) == monday
    assert rows() == sorted([*monday, *[("b", 3, d, 300, 300) for d in range(1, 7)]])
    t = fixtures.load(spark, "/root/testdata/sf0.001")
    plan = matching.match_candidates(t["telemetry"], t["trips"], t["calendar"], t["stop_times"], t["stops"], UTC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 2, "stop times once, trips once"


def test_locations_are_read_once(spark):
    """The pattern stands in the explode only, not again in what follows it."""
    asked = spark.createDataFrame([(1, "loc:44.1,26.0", "2"), (2, "1", "loc:44.1,26.0"), (3, "loc:44.1", "loc:50,26"), (4, None, "loc:44.1")], "request_id int, origin_id string, destination_id string")
    stops = spark.createDataFrame([("1", "A", 44.1, 26.0, 0, ""), ("2", "B", 44.2, 26.2, 0, "")], "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string")
    ends = planner.resolve_endpoints(asked.repartition(2), planner.stop_places(stops), UTC)
    plan = ends._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert {line.strip(" :+-|").split()[0] for line in plan if "regexp_extract" in line} == {"Generate"}
    assert sorted((r["request_id"], r["side"], r["stop_id"]) for r in ends.collect()) == [(1, "destination", "2"), (1, "origin", "1"), (2, "destination", "1"), (2, "origin", "1")]
