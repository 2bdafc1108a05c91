"""Transit tables derived from the driver's star schema by SQL that means the same in Spark and DuckDB.

They stand for ``n`` towns, one for each hundred parts, so that every table grows with the driver's and no town does: its hundred
stops are the parts (a grid of 10 by 10), its five routes are suppliers, its trips are orders, its vehicles are users of ``events``, and
every customer asks for one journey in a town, a third of them between coordinates.  Towns stand side by side, 24 to a column.

Two spots differ and are filled in per engine: ``{us}`` (microseconds of ``ts``) and ``{div}`` (integer division); ``{ts}``
turns epoch seconds into a timestamp.  ``{n}``, ``{south}`` and ``{west}`` are the number of towns and a town's corner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
VIEWS = {
    "towns": "select greatest(1, count(*) {div} 100) as n from part",
    "telemetry_base": """
        select event_id, user_id, user_id % {n} as town, user_id {div} {n} as car, 1704088800 + ({us} - 1704067200000000) {div} 240000000 as epoch_s
        from events""",
    "telemetry": """
        select event_id, epoch_s, cast(user_id as string) as vehicle_id, cast(town + {n} * ((car % 10) {div} 4) as string) as route_id,
          case when event_id % 17 = 0 then null else cast((event_id {div} 5) % 2 as int) end as direction_id, cast(user_id % 5 as string) as agency_id,
          {south} + (event_id % 10) * 0.004e0 + (event_id % 7) * 0.0002e0 as latitude, {west} + ((event_id {div} 10) % 10) * 0.004e0 + (event_id % 5) * 0.0001e0 as longitude,
          'B' || lpad(cast(user_id as string), 5, '0') as license_plate,
          case when event_id % 13 = 0 then null else '0' || cast(6 + ((event_id % 8) * 20) {div} 60 as string) || ':'
            || lpad(cast(((event_id % 8) * 20) % 60 as string), 2, '0') || ':00' end as trip_start_time,
          {ts} as event_time
        from telemetry_base""",
    "telemetry_sparse": "select event_id, epoch_s, vehicle_id, vehicle_id as route_id, 0 as direction_id, latitude, longitude, event_time from telemetry",
    "agency": "select cast(r_regionkey as string) as agency_id, r_name as agency_name, 'Europe/Bucharest' as agency_timezone from region",
    "routes": """
        select cast(s_suppkey as string) as route_id, cast(s_nationkey % 5 as string) as agency_id, s_name as route_short_name,
          case s_suppkey % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 11 end as route_type
        from supplier""",
    "calendar": """
        select * from (values ('0',1,1,1,1,1,0,0, date '2023-12-01', date '2024-03-01'), ('1',0,0,0,0,0,1,1, date '2023-12-01', date '2024-03-01'),
          ('2',1,1,1,1,1,1,1, date '2023-12-01', date '2024-03-01'))
          as t(service_id, monday, tuesday, wednesday, thursday, friday, saturday, sunday, start_date, end_date)""",
    "stops": """
        select cast(p_partkey as string) as stop_id, p_name as stop_name, {south} + (p_partkey % 10) * 0.004e0 as stop_lat,
          {west} + ((p_partkey % 100) {div} 10) * 0.004e0 as stop_lon, case when p_partkey % 25 = 24 then 1 else 0 end as location_type,
          case when p_partkey % 9 = 0 then 'P' || cast(p_partkey {div} 18 as string) else '' end as parent_station
        from (select *, p_partkey {div} 100 as town from part) x""",
    "shapes": """
        select cast(town * 4 + p_partkey % 4 as string) as shape_id, cast((p_partkey % 100) {div} 4 as int) as shape_pt_sequence,
          {south} + ((p_partkey % 100) {div} 4) * 0.0016e0 as shape_pt_lat, {west} + (p_partkey % 4) * 0.01e0 as shape_pt_lon
        from (select *, p_partkey {div} 100 as town from part) x""",
    "trips": """
        select cast(k as string) as trip_id, cast(town + {n} * ((turn % 10) {div} 4) as string) as route_id, cast((turn {div} 3) % 3 as string) as service_id,
          cast(turn % 2 as int) as direction_id, cast(town * 4 + turn % 4 as string) as shape_id
        from (select distinct l_orderkey as k, l_orderkey % {n} as town, l_orderkey {div} {n} as turn from lineitem) x""",
    "stop_times": """
        select cast(k as string) as trip_id, n as stop_sequence, cast((k % {n}) * 100 + p % 100 as string) as stop_id,
          case when (k + n) % 11 = 0 or (k + n) % 37 = 0 then null else t end as arrival_s, case when (k + n) % 37 = 0 then null else t + 20 end as departure_s
        from (select l_orderkey as k, l_linenumber as n, min(l_partkey) as p,
            21600 + (l_orderkey % 8) * 1200 + l_linenumber * 180 + case when l_orderkey % 40 = 39 then 64800 else 0 end as t
          from lineitem group by l_orderkey, l_linenumber) x""",
    "od_requests": """
        select c_custkey as request_id, case when c_custkey % 3 = 0 then {from_at} else cast(town * 100 + turn % 50 as string) end as origin_id,
          case when c_custkey % 3 = 0 then {to_at} else cast(town * 100 + 50 + (turn * 7) % 50 as string) end as destination_id,
          date '2024-01-01' as service_date, 21600 + (c_custkey % 6) * 600 as departure_s
        from (select c_custkey, c_custkey % {n} as town, c_custkey {div} {n} as turn from customer) x""",
}
FILE_FACTOR = ("spark.sql.sources.fileCompressionFactor", "30")
N = "(select n from towns)"
TOWN = {"{south}": "44.02e0 + (town % 24) * 0.04e0", "{west}": "25.52e0 + (town {div} 24) * 0.04e0"}


def _at(y: str, x: str) -> str:
    """``loc:lat,lon`` of a point of a town's grid, from whole thousandths, so that both engines write the same text."""
    north, east = f"(20 + (town % 24) * 40 + {y} * 4 + 1)", f"(25520 + (town {{div}} 24) * 40 + {x} * 4 + 1)"
    return f"'loc:44.' || lpad(cast({north} as string), 3, '0') || ',' || cast({east} {{div}} 1000 as string) || '.' || lpad(cast({east} % 1000 as string), 3, '0')"


SHARED = TOWN | {"{from_at}": _at("(turn % 10)", "((turn {div} 10) % 3)"), "{to_at}": _at("((turn * 3) % 10)", "(6 + (turn {div} 7) % 3)"), "{n}": N}
SPARK = {"{us}": "unix_micros(cast(ts as timestamp))", "{div}": "div", "{ts}": "timestamp_seconds(epoch_s)"}
DUCK = {"{us}": "epoch_us(ts)", "{div}": "//", "{ts}": "make_timestamp(epoch_s * 1000000)"}


def _filled(sql: str, parts: dict[str, str]) -> str:
    for k, v in (SHARED | parts).items():
        sql = sql.replace(k, v)
    return sql


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The base tables and the derived ones, by name.  Their SQL refers to them as temporary views and reads times in UTC, so
    the session's zone is set to that, as DuckDB has it.

    Rows of these tables take some thirty times the room in memory that they take in their files, where keys follow one another and texts
    repeat.  Unless the session has a factor of its own, Spark is told so: what it would broadcast by its files' sizes can be too large for the driver.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if float(spark.conf.get(FILE_FACTOR[0])) == 1.0:
        spark.conf.set(*FILE_FACTOR)
    out = {}
    for name in BASE:
        out[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        out[name] = spark.sql(_filled(sql, SPARK))
        out[name].createOrReplaceTempView(name)
    return out


def duck_ctes() -> dict[str, str]:
    return {name: _filled(sql, DUCK) for name, sql in VIEWS.items()}
