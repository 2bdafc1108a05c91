"""What searches leave on disk while they run, and that their leaner steps give the rows of the plain ones."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tramline.config import DEFAULT
from tramline.operators import planner
from tramline.sources.scratch import stored

UTC = replace(DEFAULT, timezone="UTC")


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


@pytest.fixture(scope="module")
def town(spark):
    """A line with a second visit to its first stop, one that it meets at a place beside its own, and requests that differ in what they find."""
    trips, times = [], []
    for k in range(12):
        trips += [(f"a{k}", "A", k % 2, "S", None), (f"b{k}", "B", 0, "S", "s")]
        calls = [("O", 0), ("P", 300), ("O", 600), ("H", 900), ("D", 1500)]
        times += [(f"a{k}", n, s, 28800 + 600 * k + t, None if n == 1 else 28800 + 600 * k + t) for n, (s, t) in enumerate(calls)]
        times += [(f"b{k}", n, s, 30000 + 600 * k + t, 30000 + 600 * k + t) for n, (s, t) in enumerate([("G", 0), ("D", 400), ("E", 700)])]
    trips.append(("off", "A", 0, "never", None))
    times.append(("off", 0, "O", 28800, 28800))
    at = {"O": (44.0, 26.0), "P": (44.05, 26.0), "H": (44.1, 26.0), "G": (44.101, 26.0), "D": (44.2, 26.0), "E": (44.3, 26.0)}
    days = ", ".join(f"{d} int" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    asked = spark.createDataFrame([(1, "O", "D", 28000), (2, "O", "E", 28000), (3, "P", "E", 30000), (4, "E", "O", 28000)], "request_id long, origin_id string, destination_id string, departure_s int")
    return asked.withColumn("service_date", F.lit("2024-06-03").cast("date")), {
        "trips": spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int, service_id string, shape_id string"),
        "stop_times": spark.createDataFrame(times, "trip_id string, stop_sequence int, stop_id string, arrival_s long, departure_s long"),
        "stops": spark.createDataFrame([(s, s, *p, 0, "") for s, p in at.items()], "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string"),
        "calendar": spark.createDataFrame([("S", *[1] * 7, "2024-01-01", "2024-12-31")], f"service_id string, {days}, start_date string, end_date string"),
        "routes": spark.createDataFrame([("A", "1", 3), ("B", "2", 3)], "route_id string, route_short_name string, route_type int"),
    }


def plan(asked, table, cfg):
    search = planner.prepared_search(asked, planner.stop_places(table["stops"]), table["calendar"], table["trips"], table["stop_times"], cfg)
    return search, planner.ranked_rides(*search, cfg)


def test_a_search_leaves_no_shuffle_files(spark, town):
    asked, table = town
    before = shuffle_files(spark)
    search, _ = plan(asked, table, UTC)
    found = planner.found_itineraries(search, table["stops"], UTC)
    assert {(r["request_id"], r["kind"]) for r in found.collect()} == {(1, "direct"), (1, "one_transfer"), (2, "one_transfer"), (3, "one_transfer")}
    assert not shuffle_files(spark) - before


@pytest.mark.parametrize("first_legs", [900, 4])
def test_rides_ranked_once_give_all_direct_rides_and_transfers(town, first_legs):
    asked, table = town
    cfg = replace(UTC, first_legs=first_legs)
    search, ranked = plan(asked, table, cfg)
    cols = ["request_id", "leg1_trip_id", "leg1_route_id", "leg1_shape_id", "leg1_direction_id", "leg1_from_seq", "leg1_to_seq", "leg1_dep_s", "leg1_arr_s", "access_m", "egress_m"]
    rows = lambda df, names: sorted(map(str, df.select(*names).collect()))
    plain = planner.direct_itineraries(*search, cfg)
    assert plain.count() == 24 and rows(planner.direct_itineraries(*search, cfg, ranked), cols) == rows(plain, cols)
    # All connections, one by one in Python.
    routes, calls = {r["trip_id"]: r["route_id"] for r in table["trips"].filter("service_id = 'S'").collect()}, {}
    for r in table["stop_times"].collect():
        if r["trip_id"] in routes:
            calls.setdefault(r["trip_id"], []).append((r["stop_sequence"], r["stop_id"], r["arrival_s"], r["departure_s"] or r["arrival_s"]))
    rides = [(t, a, b) for t, c in calls.items() for a in c for b in c if a[0] < b[0]]
    near = {(s, s) for s in "OPHGDE"} | {("H", "G"), ("G", "H")}
    want = set()
    for q in asked.collect():
        first = [r for r in rides if r[1][1] == q["origin_id"] and q["departure_s"] <= r[1][3] <= q["departure_s"] + cfg.search_window_s]
        for t, a, b in sorted(first, key=lambda r: (r[2][2], r[1][3], r[1][0], r[1][1], r[2][0], r[2][1], r[0]))[:first_legs]:
            for u, c, d in rides:
                if u != t and (b[1], c[1]) in near and d[1] == q["destination_id"] and cfg.min_transfer_s <= c[3] - b[2] <= cfg.min_transfer_s + cfg.transfer_wait_s:
                    want.add((q["request_id"], t, routes[t], a[0], b[0], u, routes[u], c[0], d[0]))
    names = ["request_id", "leg1_trip_id", "leg1_route_id", "leg1_from_seq", "leg1_to_seq", "leg2_trip_id", "leg2_route_id", "leg2_from_seq", "leg2_to_seq"]
    got = [tuple(r) for r in planner.one_transfer_join(*search, table["stops"], cfg, ranked).select(*names).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert not shuffle_files(spark) - before
    assert sorted(r["count"] for r in kept.collect()) == [142, 143, 143, 143, 143, 143, 143]


def itineraries(spark):
    leg = "struct<mode:string,trip_id:string,route_id:string,direction_id:int,route_short_name:string,from_id:string,to_id:string,dep:bigint,arr:bigint,minutes:bigint,meters:double>"
    walk = lambda a, b: ("walk", None, None, None, None, "x", "y", a, b, 1, 10.0)
    ride = lambda route, way, a, b: ("transit", f"t{a}", route, way, route, "x", "y", a, b, 1, None)
    rows = [
        (1, "i1", 0, 1900, [walk(0, 100), ride("A", 0, 100, 700), walk(700, 760), ride("B", None, 900, 1800), walk(1800, 1900)]),
        (1, "i2", 0, 700, [ride("A", 0, 100, 700)]),
        (2, "i2", 50, 1800, [ride("B", None, 900, 1800)]),
        (2, "i3", 50, 400, [ride("C", 1, 100, 400)]),
        (3, "i4", 50, 90, [walk(50, 90)]),
    ]
    return spark.createDataFrame(rows, f"request_id long, itinerary_id string, requested long, arr long, legs array<{leg}>")


def test_delays_add_up_along_an_itinerary_and_shuffle_it_once(spark, monkeypatch):
    given = spark.createDataFrame([("A|0|100", 120, "model"), ("B|-|900", -60, "history")], "leg_id string, seconds int, source string")
    asked = []
    estimate = lambda legs: asked.append(sorted(r["leg_id"] for r in legs.collect())) or given
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        late = planner.apply_expected_delays(itineraries(spark), estimate)
        got = {(r["request_id"], r["itinerary_id"]): r for r in late.collect()}
        plan = planner.soft_filter_itineraries(late, UTC)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert asked == [["A|0|100", "B|-|900", "C|1|100"]] and len(got) == 5
    own = got[1, "i1"]
    assert [tuple(x) for x in own["expected_legs"]] == [(0, 0, 100), (1, 100, 820), (2, 820, 880), (3, 1020, 1860), (4, 1860, 1960)]
    assert (own["expected_arr"], own["sources"], own["expected_minutes"], own["expected_delay_minutes"]) == (1960, ["history", "model"], 33, 1)
    assert [tuple(x) for x in got[2, "i2"]["expected_legs"]] == [(0, 900, 1740)] and got[2, "i2"]["sources"] == ["history"]
    assert (got[2, "i3"]["expected_arr"], got[2, "i3"]["sources"]) == (400, []) and (got[3, "i4"]["expected_arr"], got[3, "i4"]["sources"]) == (90, [])
    assert "_sig" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "_sig" in x], plan
