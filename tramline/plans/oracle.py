"""DuckDB statements of the derived tables, as common table expressions over the driver's tables."""

from __future__ import annotations

import re

from tramline.plans import fixtures

AS_OF = 1704099600  # 2024-01-01 09:00 UTC, the end of the fixture's three hours
NOW = f"make_timestamp({AS_OF}000000)"


def bucket(ts: str, s: int) -> str:
    return f"make_timestamp(cast(floor(epoch({ts}) / {s}) * {s} as bigint) * 1000000)"


def recent(ts: str, s: int) -> str:
    return f"{ts} > {NOW} - interval {s} second"


METERS = "sqrt(pow(({1} - {0}) * 111320e0, 2) + pow(({3} - {2}) * 111320e0 * cos(radians({0})), 2))"


def meters(lat_a: str, lat_b: str, lon_a: str, lon_b: str) -> str:
    return METERS.format(lat_a, lat_b, lon_a, lon_b)


def rnd(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(38,8)), {n}) as double)"


def rollup(cols: str, ts: str, s: int, source: str, name: str = "feature_time") -> str:
    return f"select {bucket(ts, s)} as {name}, route_id, direction_id, {cols} from {source} group by all"


DELAY = "count(distinct vehicle_id) as vehicle_count, avg(delay_sec) as avg_delay_sec, max(delay_sec) as max_delay_sec, min(delay_sec) as min_delay_sec, quantile_cont(delay_sec, 0.95) as p95_delay_sec"
ACTIVE = "d between start_date and end_date and case isodow(d) when 1 then monday when 2 then tuesday when 3 then wednesday when 4 then thursday when 5 then friday when 6 then saturday else sunday end = 1"
PLACE = "coalesce(nullif(parent_station, ''), 'geo:' || md5(lower(regexp_replace(stop_name, '\\s+', ' ', 'g')) || ':' || cast(cast(round(cast(stop_lat as decimal(38,8)), 4) as decimal(38,4)) as varchar) || ':' || cast(cast(round(cast(stop_lon as decimal(38,8)), 4) as decimal(38,4)) as varchar)))"
RISK = "case when {0} >= 600 then 'critical' when {0} >= 300 then 'high' when {0} >= 150 then 'medium' else 'low' end"
WARM = (
    "greatest(-300e0, a + greatest(0e0, p - a) * 0.25e0 + greatest(0e0, m - p) * 0.10e0 + least(d, 60e0) * 2e0 + least(b, 10e0) * 15e0 + least(g, 10e0) * 45e0"
    " + least(h, 5e0) * 90e0 + least(f, 120e0) * 0.05e0)"
)
ROUTE_LABEL = "case route_type when 0 then 'Tram' when 1 then 'Metro' when 3 then 'Bus' when 11 then 'Trolleybus' else 'Other (' || route_type || ')' end"


def span(a: str, b: str) -> str:
    """Two instants as whole seconds, joined."""
    return f"cast(cast({a} as bigint) as varchar) || '-' || cast(cast({b} as bigint) as varchar)"


def label_join(src: str, cols: str = "x.*, r.route_short_name, r.route_type") -> str:
    return f"select {cols} from ({src}) x left join routes r using (route_id)"


CTES: dict[str, str] = fixtures.duck_ctes() | {
    "first_stop": "select trip_id, arg_min(coalesce(departure_s, arrival_s), stop_sequence) as first_s from stop_times where coalesce(departure_s, arrival_s) is not null group by trip_id",
    "visits": "select st.trip_id, st.stop_id, st.stop_sequence, coalesce(arrival_s, departure_s) as scheduled_s, t.route_id as trip_route, t.direction_id as trip_direction, service_id, first_s, stop_lat, stop_lon from stop_times st join trips t using (trip_id) left join first_stop using (trip_id) join stops using (stop_id) where coalesce(arrival_s, departure_s) is not null",
    "fixes": "select *, cast(event_time as date) as d, cast(substr(trip_start_time, 1, 2) as int) * 3600 + cast(substr(trip_start_time, 4, 2) as int) * 60 + cast(substr(trip_start_time, 7, 2) as int) as start_s from telemetry",
    "candidates": f"""
        select p.event_id, p.event_time, p.epoch_s, p.vehicle_id, p.route_id, p.direction_id, d as service_date, start_s, v.trip_id, trip_direction, v.stop_id, v.stop_sequence,
          cast(epoch_s - epoch(d) - scheduled_s as double) as delay_sec, {meters('latitude', 'stop_lat', 'longitude', 'stop_lon')} as distance_to_stop_m,
          make_timestamp(cast((epoch(d) + scheduled_s) as bigint) * 1000000) as scheduled_time
        from fixes p join visits v on v.trip_route = p.route_id and (p.direction_id is null or p.direction_id = v.trip_direction) join calendar c using (service_id)
        where {ACTIVE} and (start_s is null or abs(first_s - start_s) <= 1200) and abs(stop_lat - latitude) <= 75e0 / 111320 and abs(stop_lon - longitude) <= 75e0 / 75000
          and {meters('latitude', 'stop_lat', 'longitude', 'stop_lon')} <= 75 and abs(epoch_s - epoch(d) - scheduled_s) <= 5400""",
    "events_matched": """
        select event_time as observed_time, scheduled_time, service_date, vehicle_id, route_id, coalesce(direction_id, trip_direction) as direction_id, trip_id, stop_id, stop_sequence, delay_sec,
          distance_to_stop_m, greatest(0.05e0, least(1e0, 1 - distance_to_stop_m / 75e0)) as match_confidence, case when start_s is null then 'route_direction_geofence' else 'trip_start_geofence' end as match_method
        from (select *, row_number() over (partition by event_id order by distance_to_stop_m, abs(delay_sec), trip_id, stop_sequence) as n from candidates) where n = 1""",
    "delay": f"select {bucket('observed_time', 60)} as window_start, route_id, direction_id, {DELAY} from events_matched group by all",
    "fresh": f"select {bucket('event_time', 60)} as window_start, route_id, direction_id, count(distinct vehicle_id) as vehicle_count, avg(a) as avg_freshness_sec, max(a) as max_freshness_sec, min(a) as min_freshness_sec, quantile_cont(a, 0.95) as p95_freshness_sec from (select *, cast({AS_OF} - epoch_s as double) as a from telemetry) group by all",
    "bunch": """
        select a.event_time, a.route_id, a.direction_id, a.vehicle_id as vehicle_a_id, b.vehicle_id as vehicle_b_id, cast(abs(a.epoch_s - b.epoch_s) as double) as gap_seconds,
          a.latitude as lat_a, a.longitude as lon_a, b.latitude as lat_b, b.longitude as lon_b
        from telemetry a join telemetry b on a.route_id = b.route_id and a.direction_id = b.direction_id and a.vehicle_id < b.vehicle_id and abs(a.epoch_s - b.epoch_s) <= 30""",
    "gaps": """
        select make_timestamp(p * 1000000) as gap_start, make_timestamp(epoch_s * 1000000) as gap_end, route_id, direction_id, cast(epoch_s - p as double) as gap_duration_sec
        from (select *, lag(epoch_s) over (partition by route_id, direction_id order by epoch_s) as p from telemetry) where epoch_s - p > 60""",
    "segments": f"""
        select * from (select *, case when dt > 0 then {meters('plat', 'latitude', 'plon', 'longitude')} / 1000 / (dt / 3600e0) end as speed_kmh
          from (select *, epoch_s - lag(epoch_s) over w as dt, lag(latitude) over w as plat, lag(longitude) over w as plon from telemetry window w as (partition by vehicle_id order by epoch_s, event_id)))
        where dt > 5 and dt < 300 and speed_kmh > 0 and speed_kmh < 120""",
    "speed": f"select {bucket('event_time', 900)} as window_start, route_id, direction_id, count(*) as vehicle_count, avg(speed_kmh) as avg_speed_kmh, min(speed_kmh) as min_speed_kmh, max(speed_kmh) as max_speed_kmh from segments group by all",
    "dwell": f"select {bucket('observed_time', 3600)} as window_start, route_id, direction_id, stop_id, vehicle_id, count(*) as observation_count, cast(max(epoch(observed_time)) - min(epoch(observed_time)) as double) as avg_dwell_sec from events_matched group by all having count(*) >= 2",
    "hot": f"""
        select *, greatest(0e0, coalesce(avg_delay_sec, 0) / 600) + greatest(0e0, coalesce(p95_delay_sec, 0) / 900) as hotspot_score from (
          select {bucket('observed_time', 900)} as window_start, printf('%.3f', {rnd('stop_lat', 3)}) || ':' || printf('%.3f', {rnd('stop_lon', 3)}) as zone_id, route_id, direction_id, avg(stop_lat) as centroid_lat,
            avg(stop_lon) as centroid_lon, count(*) as observation_count, count(distinct vehicle_id) as active_vehicle_count, avg(delay_sec) as avg_delay_sec, quantile_cont(delay_sec, 0.95) as p95_delay_sec
          from events_matched join stops using (stop_id) group by all)""",
    "f_delay": rollup("sum(vehicle_count) as vehicle_count, count(*) as observation_count, avg(avg_delay_sec) as avg_delay_sec, avg(p95_delay_sec) as p95_delay_sec, max(max_delay_sec) as max_delay_sec", "window_start", 900, "delay"),
    "f_speed": rollup("avg(avg_speed_kmh) as avg_speed_kmh, min(min_speed_kmh) as min_speed_kmh", "window_start", 900, "speed"),
    "f_bunch": rollup("count(*) as bunching_count", "event_time", 900, "bunch"),
    "f_gap": rollup("count(*) as service_gap_count, sum(gap_duration_sec) as total_gap_sec", "gap_start", 900, "gaps"),
    "f_dwell": rollup("avg(avg_dwell_sec) as avg_dwell_sec", "window_start", 900, "dwell"),
    "f_fresh": rollup("avg(avg_freshness_sec) as avg_freshness_sec", "window_start", 900, "fresh"),
    "f_hot": rollup("avg(hotspot_score) as hotspot_score", "window_start", 900, "hot"),
    "features": """
        select a.feature_time, a.route_id, a.direction_id, 'network' as zone_id, route_type, hour(a.feature_time) as hour_of_day, isodow(a.feature_time) as day_of_week, isodow(a.feature_time) >= 6 as is_weekend,
          hour(a.feature_time) between 7 and 9 as is_am_peak, hour(a.feature_time) between 16 and 19 as is_pm_peak, vehicle_count, observation_count, avg_delay_sec, p95_delay_sec, max_delay_sec,
          avg_speed_kmh, min_speed_kmh, greatest(0e0, 15 - coalesce(avg_speed_kmh, 15)) as speed_drop_kmh, coalesce(bunching_count, 0) as bunching_count, coalesce(service_gap_count, 0) as service_gap_count,
          coalesce(total_gap_sec, 0) as total_gap_sec, avg_dwell_sec, coalesce(hotspot_score, 0) as hotspot_score, avg_freshness_sec
        from f_delay a """
    + " ".join(f"left join {t} on {t}.feature_time = a.feature_time and {t}.route_id = a.route_id and {t}.direction_id is not distinct from a.direction_id" for t in ("f_speed", "f_bunch", "f_gap", "f_dwell", "f_fresh", "f_hot"))
    + " left join routes r on r.route_id = a.route_id",
    "latest_feature": f"select * from (select *, row_number() over (partition by route_id, direction_id, zone_id order by feature_time desc) as n from features where {recent('feature_time', 7200)}) where n = 1",
    "predictions": f"""
        select {NOW} as prediction_time, {NOW} + interval 1800 second as target_time, 30 as horizon_minutes, route_id, direction_id, predicted_delay_sec, {RISK.format('predicted_delay_sec')} as risk_level,
          0.35e0 as confidence, 'warm-start-v1' as model_version, feature_time, {NOW} as generated_at
        from (select *, {WARM} as predicted_delay_sec from (select route_id, direction_id, feature_time, coalesce(avg_delay_sec, 0) as a, coalesce(p95_delay_sec, 0) as p, coalesce(max_delay_sec, 0) as m,
          speed_drop_kmh as d, bunching_count as b, service_gap_count as g, hotspot_score as h, coalesce(avg_freshness_sec, 0) as f from latest_feature))""",
    "h_delay": rollup("sum(vehicle_count) as total_observations, avg(avg_delay_sec) as avg_delay_sec, max(max_delay_sec) as max_delay_sec, min(min_delay_sec) as min_delay_sec", "window_start", 3600, "delay", "bucket"),
    "d_delay": rollup("sum(vehicle_count) as total_observations, avg(avg_delay_sec) as avg_delay_sec, max(max_delay_sec) as peak_delay_sec, min(min_delay_sec) as min_delay_sec", "window_start", 86400, "delay", "bucket"),
    "h_bunch": rollup("count(*) as bunching_count, avg(gap_seconds) as avg_gap_seconds, min(gap_seconds) as min_gap_seconds", "event_time", 3600, "bunch", "bucket"),
    "h_speed": rollup("sum(vehicle_count) as total_observations, avg(avg_speed_kmh) as avg_speed_kmh, min(min_speed_kmh) as min_speed_kmh, max(max_speed_kmh) as max_speed_kmh", "window_start", 3600, "speed", "bucket"),
    "h_gap": rollup("count(*) as gap_count, sum(gap_duration_sec) as total_gap_sec, avg(gap_duration_sec) as avg_gap_sec, max(gap_duration_sec) as max_gap_sec", "gap_start", 3600, "gaps", "bucket"),
    "d_fleet": f"select {bucket('event_time', 86400)} as bucket, count(distinct vehicle_id) as unique_vehicles, count(distinct route_id) as unique_routes, count(*) as total_position_reports from telemetry group by all",
    "labelled": "select f.*, g.avg_delay_sec as target_delay_sec from features f left join features g on g.feature_time = f.feature_time + interval 1800 second and g.route_id = f.route_id and g.direction_id is not distinct from f.direction_id and g.zone_id = f.zone_id",
    "places": f"select place_id, min(stop_name) as name, avg(stop_lat) as lat, avg(stop_lon) as lon, list_sort(list(stop_id)) as stop_ids, count(*) as stop_count, list_sort(list(distinct stop_name)) as names from (select *, {PLACE} as place_id from stops where location_type is null or location_type = 0) group by place_id",
    "requests": "select * from od_requests",
    "asked": """
        select request_id, 'origin' as side, origin_id as endpoint_id from od_requests
        union all select request_id, 'destination', destination_id from od_requests""",
    "spots": """
        select *, cast(split_part(substr(endpoint_id, 5), ',', 1) as double) as loc_lat, cast(split_part(endpoint_id, ',', 2) as double) as loc_lon
        from asked where endpoint_id like 'loc:%'""",
    "ends": f"""
        select request_id, side, endpoint_id, lat, lon, unnest(stop_ids) as stop_id, 0e0 as walk_m
        from asked join (select distinct unnest(list_concat([place_id], stop_ids)) as endpoint_id, lat, lon, stop_ids from places) using (endpoint_id)
        union all
        select request_id, side, endpoint_id, loc_lat, loc_lon, unnest(stop_ids), walk_m
        from (select *, row_number() over (partition by request_id, side order by walk_m, place_id) as n
              from (select s.*, place_id, stop_ids, {meters('loc_lat', 'lat', 'loc_lon', 'lon')} as walk_m
                    from spots s join places p on abs(lat - loc_lat) < 0.01 and abs(lon - loc_lon) < 0.02) x
              where walk_m <= 900) y
        where n <= 10""",
    "windows": f"""
        select request_id, d as service_date, earliest_s, service_id
        from (select request_id, cast(service_date - cast(k as int) as date) as d, departure_s + k * 86400 as earliest_s from od_requests, (values (0), (1)) as b(k))
          join calendar on {ACTIVE}""",
    "boards": """
        select e.request_id, w.service_date, e.stop_id as from_stop, e.walk_m as access_m, st.trip_id, stop_sequence, coalesce(departure_s, arrival_s) as dep_s, t.route_id, t.direction_id
        from ends e join stop_times st using (stop_id) join trips t using (trip_id) join windows w on w.request_id = e.request_id and w.service_id = t.service_id
        where side = 'origin' and coalesce(departure_s, arrival_s) - earliest_s between 0 and 21600""",
    "rides": """
        select b.request_id, b.service_date, access_m, b.trip_id as leg1_trip_id, b.route_id as leg1_route_id, b.direction_id as leg1_direction_id, b.from_stop as leg1_from_stop,
          x.stop_id as leg1_to_stop, b.stop_sequence as leg1_from_seq, x.stop_sequence as leg1_to_seq, b.dep_s as leg1_dep_s, coalesce(x.arrival_s, x.departure_s) as leg1_arr_s
        from boards b join stop_times x on x.trip_id = b.trip_id where x.stop_sequence - b.stop_sequence > 0 and coalesce(x.arrival_s, x.departure_s) is not null""",
    "direct": "select r.*, e.walk_m as egress_m from rides r join ends e on e.request_id = r.request_id and e.stop_id = r.leg1_to_stop and e.side = 'destination'",
    "direct30": """
        select * from (select *, row_number() over (partition by request_id, service_date
          order by leg1_arr_s, leg1_dep_s, leg1_from_seq, leg1_from_stop, leg1_to_seq, leg1_to_stop, leg1_trip_id) as n from direct) where n <= 30""",
    "pairs": f"""
        select a.stop_id as from_stop_id, b.stop_id as to_stop_id, {meters('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} as meters
        from stops a join stops b on abs(a.stop_lat - b.stop_lat) < 0.01 and abs(a.stop_lon - b.stop_lon) < 0.01
        where {meters('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} <= 180""",
    "first_legs": """
        select * from (select *, row_number() over (partition by request_id, service_date
          order by leg1_arr_s, leg1_dep_s, leg1_from_seq, leg1_from_stop, leg1_to_seq, leg1_to_stop, leg1_trip_id) as n from rides) where n <= 900""",
    "transfer": """
        select f.*, e.walk_m as egress_m, b.trip_id as leg2_trip_id, t.route_id as leg2_route_id, t.direction_id as leg2_direction_id, b.stop_id as leg2_from_stop, d.stop_id as leg2_to_stop,
          b.stop_sequence as leg2_from_seq, d.stop_sequence as leg2_to_seq, coalesce(b.departure_s, b.arrival_s) as leg2_dep_s, coalesce(d.arrival_s, d.departure_s) as leg2_arr_s, p.meters as transfer_m
        from first_legs f join pairs p on p.from_stop_id = f.leg1_to_stop join stop_times b on b.stop_id = p.to_stop_id join trips t on t.trip_id = b.trip_id
          join (select distinct request_id, service_date, service_id from windows) w on w.request_id = f.request_id and w.service_date = f.service_date and w.service_id = t.service_id
          join stop_times d on d.trip_id = b.trip_id and d.stop_sequence - b.stop_sequence > 0 join ends e on e.request_id = f.request_id and e.side = 'destination' and e.stop_id = d.stop_id
        where b.trip_id <> f.leg1_trip_id and coalesce(b.departure_s, b.arrival_s) - f.leg1_arr_s between 120 and 3720 and coalesce(d.arrival_s, d.departure_s) is not null""",
    "transfer30": """
        select * from (select * exclude (n), row_number() over (partition by request_id, service_date order by leg2_arr_s, leg1_dep_s, leg1_arr_s, leg1_from_seq, leg1_from_stop, leg1_to_seq,
          leg1_to_stop, leg1_trip_id, leg2_dep_s, leg2_from_seq, leg2_from_stop, leg2_to_seq, leg2_to_stop, leg2_trip_id) as n from transfer) where n <= 30""",
    # Candidates as itineraries: times of walks, the times of the whole, and what tells itineraries apart.
    "found": """
        select 'direct' as kind, * from direct30 union all by name select 'one_transfer' as kind, * from transfer30""",
    "timed": """
        select f.*, q.origin_id, q.destination_id, epoch(q.service_date) + q.departure_s as requested, epoch(f.service_date) as midnight, r1.route_short_name as short1, r2.route_short_name as short2,
          case when access_m > 0 then ceil(access_m / 1.25e0) else 0 end as access_s, case when egress_m > 0 then ceil(egress_m / 1.25e0) else 0 end as egress_s,
          epoch(f.service_date) + leg1_dep_s as dep1, epoch(f.service_date) + leg1_arr_s as arr1, epoch(f.service_date) + leg2_dep_s as dep2, epoch(f.service_date) + leg2_arr_s as arr2
        from found f join od_requests q using (request_id) left join routes r1 on r1.route_id = leg1_route_id left join routes r2 on r2.route_id = leg2_route_id""",
    "itins": f"""
        select *, greatest(0, ceil((arr - requested) / 60)) as total_minutes, greatest(0, ceil((dep - requested) / 60)) as waiting_minutes, md5(sig || '@' || times) as itinerary_id
        from (
          select *, case when access_m > 0 then requested else dep1 end as dep, midnight + coalesce(leg2_arr_s, leg1_arr_s) + egress_s as arr, case when kind = 'direct' then 0 else 1 end as transfers,
            1 + cast(access_m > 0 as int) + cast(egress_m > 0 as int) + case when kind = 'direct' then 0 else 2 end as legs,
            case when access_m > 0 then greatest(1, ceil(access_s / 60)) else 0 end + case when egress_m > 0 then greatest(1, ceil(egress_s / 60)) else 0 end as walk_minutes,
            leg1_route_id || '/' || coalesce(cast(leg1_direction_id as varchar), '') || '/' || coalesce(short1, '')
              || case when kind = 'direct' then '' else ' ' || leg2_route_id || '/' || coalesce(cast(leg2_direction_id as varchar), '') || '/' || coalesce(short2, '') end as rides_sig,
            case when access_m > 0 then 'walk//' || origin_id || '/' || leg1_from_stop || ' ' else '' end || 'transit/' || leg1_trip_id || '/' || leg1_from_stop || '/' || leg1_to_stop
              || case when kind = 'direct' then '' else ' walk//' || leg1_to_stop || '/' || leg2_from_stop || ' transit/' || leg2_trip_id || '/' || leg2_from_stop || '/' || leg2_to_stop end
              || case when egress_m > 0 then ' walk//' || coalesce(leg2_to_stop, leg1_to_stop) || '/' || destination_id else '' end as sig,
            case when access_m > 0 then {span('requested', 'requested + access_s')} || ' ' else '' end || {span('dep1', 'arr1')}
              || case when kind = 'direct' then '' else ' ' || {span('arr1', 'arr1 + ceil(transfer_m / 1.25e0)')} || ' ' || {span('dep2', 'arr2')} end
              || case when egress_m > 0 then ' ' || {span('coalesce(arr2, arr1)', 'coalesce(arr2, arr1) + egress_s')} else '' end as times
          from timed where dep1 >= requested + access_s) x""",
    "est_legs": """
        select distinct route_id || '|' || coalesce(cast(direction_id as varchar), '-') || '|' || cast(cast(dep as bigint) as varchar) as leg_id, route_id, direction_id, dep
        from (select leg1_route_id as route_id, leg1_direction_id as direction_id, dep1 as dep from itins
              union all select leg2_route_id, leg2_direction_id, dep2 from itins where kind = 'one_transfer') x""",
    "delayed": """
        select *, greatest(0, ceil((expected_arr - requested) / 60)) as expected_minutes, round_even((expected_arr - arr) / 60e0, 0) as expected_delay_minutes
        from (select i.*, arr + e1.seconds + coalesce(e2.seconds, 0) as expected_arr
              from itins i join est e1 on e1.leg_id = leg1_route_id || '|' || coalesce(cast(leg1_direction_id as varchar), '-') || '|' || cast(cast(dep1 as bigint) as varchar)
                left join est e2 on e2.leg_id = leg2_route_id || '|' || coalesce(cast(leg2_direction_id as varchar), '-') || '|' || cast(cast(dep2 as bigint) as varchar)) x""",
    "soft": """
        select * from (select *, first_value(walk_minutes) over w as best_walk, first_value(expected_minutes) over w as best_minutes
                       from delayed window w as (partition by request_id, rides_sig order by walk_minutes, expected_minutes)) x
        where walk_minutes - best_walk <= 4 or best_minutes - expected_minutes >= 3""",
    "walks": f"""
        select request_id, origin_id, destination_id, requested, requested + s as arr, ceil(s / 60) as expected_minutes, 'walk//' || origin_id || '/' || destination_id as sig
        from (select q.*, epoch(service_date) + departure_s as requested, ceil({meters('a.lat', 'b.lat', 'a.lon', 'b.lon')} / 1.25e0) as s
              from od_requests q join (select distinct request_id, lat, lon from ends where side = 'origin') a using (request_id)
                join (select distinct request_id, lat, lon from ends where side = 'destination') b using (request_id)) x
          left join (select request_id, min(expected_minutes) as best from soft group by request_id) y using (request_id)
        where case when best is null then ceil(s / 60) <= 45 when ceil(s / 60) <= 15 then ceil(s / 60) <= best else best - ceil(s / 60) >= 8 end""",
    "planned": f"""
        select * from (
          select *, row_number() over (partition by request_id order by expected_arr, transfers, dep, itinerary_id) as rank from (
            select *, row_number() over (partition by request_id, sig order by expected_arr, transfers, dep, itinerary_id) as same from (
              select request_id, kind, dep, arr, total_minutes, waiting_minutes, transfers, legs, expected_arr, expected_minutes, sig, itinerary_id, access_m, egress_m, origin_id, destination_id,
                leg1_trip_id, leg1_from_stop, leg1_to_stop, leg2_trip_id, leg2_from_stop, leg2_to_stop from soft
              union all by name
              select request_id, 'walk' as kind, requested as dep, arr, expected_minutes as total_minutes, 0 as waiting_minutes, 0 as transfers, 1 as legs, arr as expected_arr, expected_minutes, sig,
                md5(sig || '@' || {span('requested', 'arr')}) as itinerary_id, origin_id, destination_id from walks) u) v where same = 1) w
        where rank <= 5""",
    "plan_legs": """
        select request_id, itinerary_id, 0 as pos, null as trip_id, origin_id as from_id, coalesce(leg1_from_stop, destination_id) as to_id from planned where kind = 'walk' or access_m > 0
        union all select request_id, itinerary_id, 1, leg1_trip_id, leg1_from_stop, leg1_to_stop from planned where kind <> 'walk'
        union all select request_id, itinerary_id, 2, null, leg1_to_stop, leg2_from_stop from planned where kind = 'one_transfer'
        union all select request_id, itinerary_id, 3, leg2_trip_id, leg2_from_stop, leg2_to_stop from planned where kind = 'one_transfer'
        union all select request_id, itinerary_id, 4, null, coalesce(leg2_to_stop, leg1_to_stop), destination_id from planned where egress_m > 0""",
    "own_ends": "select distinct request_id, endpoint_id, lat, lon from ends",
    "plan_lines": """
        select l.request_id || '|' || l.itinerary_id || '|' || l.pos as leg_id, l.request_id, l.itinerary_id, t.shape_id,
          case when l.trip_id is null then coalesce(a.lat, s.stop_lat) else s.stop_lat end as from_lat, case when l.trip_id is null then coalesce(a.lon, s.stop_lon) else s.stop_lon end as from_lon,
          case when l.trip_id is null then coalesce(b.lat, z.stop_lat) else z.stop_lat end as to_lat, case when l.trip_id is null then coalesce(b.lon, z.stop_lon) else z.stop_lon end as to_lon
        from plan_legs l left join trips t using (trip_id) left join stops s on s.stop_id = l.from_id left join stops z on z.stop_id = l.to_id
          left join own_ends a on a.request_id = l.request_id and a.endpoint_id = l.from_id left join own_ends b on b.request_id = l.request_id and b.endpoint_id = l.to_id""",
    "town_lines": """
        select a.stop_id as leg_id, cast(cast(a.stop_id as int) // 100 * 4 + cast(a.stop_id as int) % 4 as varchar) as shape_id, a.stop_lat as from_lat, a.stop_lon as from_lon,
          b.stop_lat as to_lat, b.stop_lon as to_lon
        from stops a join stops b on cast(b.stop_id as int) = cast(a.stop_id as int) // 100 * 100 + 99 - cast(a.stop_id as int) % 100""",
}
CLAMP = "cast(round_even(greatest(-120e0, least(1800e0, {0})), 0) as bigint)"
HOUR = "hour(make_timestamp(cast(dep as bigint) * 1000000))"
DOW = "isodow(make_timestamp(cast(dep as bigint) * 1000000))"
FPROF = f"""
select route_id, direction_id, hour_of_day, day_of_week, avg(avg_delay_sec) as delay_sec, sum(observation_count) as observations,
  least(0.85e0, 0.35e0 + sum(observation_count) / 200e0) as confidence
from features where avg_delay_sec is not null and {recent('feature_time', 60 * 86400)} group by all"""
EPROF = f"""
select route_id, direction_id, hour(scheduled_time) as hour_of_day, isodow(scheduled_time) as day_of_week, avg(delay_sec) as delay_sec, count(*) as observations,
  least(0.7e0, 0.25e0 + count(*) / 300e0) as confidence
from events_matched where {recent('observed_time', 60 * 86400)} group by all"""


def asof(legs: str) -> str:
    """The nearest prediction of each leg of ``legs`` (leg_id, route_id, direction_id, dep)."""
    return f"""
        select leg_id, {CLAMP.format('predicted_delay_sec')} as seconds, confidence from (
          select *, row_number() over (partition by leg_id order by abs(epoch(target_time) - dep), prediction_time desc, target_time desc, coalesce(p.direction_id, -1)) as n
          from {legs} l join predictions p on p.route_id = l.route_id and (l.direction_id is null or p.direction_id is null or p.direction_id = l.direction_id)
            and abs(epoch(target_time) - dep) <= 5400) x where n = 1"""


def history(legs: str, profile: str, base: str, top: str, per: str) -> str:
    return f"""
        select leg_id, {CLAMP.format('sum(delay_sec * observations) / sum(observations)')} as seconds, least({top}, {base} + sum(observations) / {per}) as confidence
        from {legs} l join ({profile}) p on p.route_id = l.route_id and p.hour_of_day = {HOUR} and p.day_of_week = {DOW}
          and (l.direction_id is null or p.direction_id is null or p.direction_id = l.direction_id)
        group by leg_id"""


def feature_history(legs: str) -> str:
    return history(legs, FPROF, "0.35e0", "0.85e0", "200e0")


def estimates(legs: str) -> str:
    """``leg_id, seconds, source, confidence``: the first of prediction, window history, event history and timetable."""
    return f"""
        select l.leg_id, coalesce(a.seconds, f.seconds, e.seconds, 0) as seconds,
          case when a.leg_id is not null then 'model_prediction' when f.leg_id is not null then 'historical_feature_windows' when e.leg_id is not null then 'historical_stop_events'
            else 'static_schedule' end as source, coalesce(a.confidence, f.confidence, e.confidence) as confidence
        from {legs} l left join ({asof(legs)}) a using (leg_id) left join ({feature_history(legs)}) f using (leg_id)
          left join ({history(legs, EPROF, '0.25e0', '0.7e0', '300e0')}) e using (leg_id)"""


CTES["est"] = estimates("est_legs")


def paths(lines: str) -> str:
    """``leg_id, o, lat, lon`` of the points along each leg of ``lines`` (leg_id, shape_id, from and to), in the order of ``o``."""
    ends = " union all ".join(f"select leg_id, shape_id, '{e}' as e, {side}_lat as y, {side}_lon as x from {lines}" for e, side in (("a", "from"), ("b", "to")))
    nearest = f"""
        select leg_id, e, s from (select leg_id, e, shape_pt_sequence as s, row_number() over (partition by leg_id, e
          order by {meters('y', 'shape_pt_lat', 'x', 'shape_pt_lon')}, shape_pt_sequence) as n from ({ends}) p join shapes using (shape_id)) q where n = 1"""
    whole = "select shape_id from shapes group by shape_id having count(*) >= 2"
    points = f"""
        select leg_id, -1 as o, from_lat as lat, from_lon as lon from {lines}
        union all select l.leg_id, case when a.s <= b.s then shape_pt_sequence - a.s else a.s - shape_pt_sequence end, shape_pt_lat, shape_pt_lon
        from {lines} l join ({nearest}) a on a.leg_id = l.leg_id and a.e = 'a' join ({nearest}) b on b.leg_id = l.leg_id and b.e = 'b'
          join shapes h on h.shape_id = l.shape_id and shape_pt_sequence between least(a.s, b.s) and greatest(a.s, b.s) where l.shape_id in ({whole})
        union all select leg_id, 1000000000, to_lat, to_lon from {lines}"""
    return f"""
        select leg_id, o, lat, lon from (select *, lag(lat) over w as before_lat, lag(lon) over w as before_lon from ({points}) x window w as (partition by leg_id order by o)) y
        where before_lat is null or lat <> before_lat or lon <> before_lon"""


CTES["plan_points"] = paths("plan_lines")


def statement(spec: list[tuple[str, str]], sql: str) -> str:
    """One statement: the expressions that ``sql`` needs, then its columns cast by ``spec``."""
    kinds = {"s": "cast({0} as varchar)", "l": "cast({0} as bigint)", "d": "round(cast({0} as double), 6)", "c": "round(cast({0} as double), 8)", "b": "cast({0} as boolean)", "t": "cast(epoch({0}) as bigint)", "D": "cast(cast({0} as date) as varchar)"}
    cols = ", ".join(f"{kinds[k].format(c)} as {c}" for c, k in spec)
    need: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(from|join)\s+\(?{name}\b|,\s*{name}\b", text):
                add(CTES[name])
                if name not in need:
                    need.append(name)

    add(sql)
    ctes = ", ".join(f"{n} as materialized ({CTES[n]})" for n in need)
    return (f"with {ctes} " if ctes else "") + f"select {cols} from ({sql}) q"
