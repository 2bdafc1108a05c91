"""GTFS timetable tables: schemas, loading, integrity and idempotent append."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions import exprs as X

# The columns that each table keeps, with their types (``gtfs_time`` is seconds of the service day).
SCHEMAS = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_phone string, agency_fare_url string, agency_email string",
    "calendar": "service_id string, monday smallint, tuesday smallint, wednesday smallint, thursday smallint, friday smallint, saturday smallint, sunday smallint, start_date date, end_date date",
    "routes": "route_id string, agency_id string, route_short_name string, route_type smallint, route_color string, route_text_color string, route_long_name string",
    "stops": "stop_id string, stop_name string, stop_desc string, stop_lat double, stop_lon double, location_type smallint, platform_code string, parent_station string, level_id string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "trips": "trip_id string, route_id string, service_id string, trip_headsign string, trip_short_name string, direction_id smallint, block_id string, shape_id string, wheelchair_accessible smallint, bikes_allowed smallint",
    "stop_times": "trip_id string, arrival_time gtfs_time, departure_time gtfs_time, stop_id string, stop_sequence int, stop_headsign string, pickup_type smallint, drop_off_type smallint, shape_dist_traveled double, timepoint smallint",
}
KEYS = {
    "agency": ["agency_id"], "calendar": ["service_id"], "routes": ["route_id"], "stops": ["stop_id"],
    "shapes": ["shape_id", "shape_pt_sequence"], "trips": ["trip_id"], "stop_times": ["trip_id", "stop_sequence"],
}
REFERENCES = [
    ("routes", "agency_id", "agency"), ("trips", "route_id", "routes"), ("trips", "service_id", "calendar"),
    ("stop_times", "trip_id", "trips"), ("stop_times", "stop_id", "stops"),
]


def gtfs_columns(raw: DataFrame, table: str) -> DataFrame:
    """All-string columns to the table's schema: extra ones go, missing ones are null, blanks are null, values are cast."""
    out = []
    for field in SCHEMAS[table].split(", "):
        name, kind = field.split(" ")
        c = F.nullif(F.col(name), F.lit("")) if name in raw.columns else F.lit(None).cast("string")
        c = {"gtfs_time": X.gtfs_time_to_seconds, "date": X.gtfs_date_parse}.get(kind, lambda v, k=kind: v.try_cast(k))(c)
        out.append(c.alias(name))
    return raw.select(out)


def gtfs_load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables found in an unpacked feed, by name; absent files are left out."""
    out = {}
    for table in SCHEMAS:
        try:
            raw = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
        except AnalysisException:
            continue
        out[table] = gtfs_columns(raw, table)
    return out


def gtfs_insert_idempotent(existing: DataFrame, new: DataFrame, keys: list[str], first_by: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one per key: the first by ``first_by`` (a line number, a load time), then in column
    order, nulls first."""
    order = ([first_by] if first_by else []) + [c for c in new.columns if c not in keys and c != first_by]
    one = new.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, "_first.*").select(new.columns) if order else new.distinct()
    return one.join(existing.select(keys).distinct(), keys, "left_anti")


def gtfs_integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of keys and references: one row per broken rule and table, with how many keys break it."""
    found = []
    for table, keys in KEYS.items():
        if table in tables and all(k in tables[table].columns for k in keys):
            twice = tables[table].groupBy(*keys).count().filter("count > 1")
            found.append(twice.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit("primary_key").alias("rule"), "violations"))
    for table, column, target in REFERENCES:
        if table in tables and target in tables and column in tables[table].columns:
            lost = tables[table].filter(F.col(column).isNotNull()).select(column).distinct().join(tables[target].select(F.col(KEYS[target][0]).alias(column)), column, "left_anti")
            found.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(f"{column}->{target}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, found).filter("violations > 0")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(SCHEMAS[table].replace("gtfs_time", "int")))
