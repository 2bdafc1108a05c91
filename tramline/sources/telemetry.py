"""Telemetry sources: the flat topic schema, the nested raw payload, and the positions fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "vehicle_id string, label string, license_plate string, route_id string, direction_id int, agency_id string, trip_start_time string, "
    "latitude double, longitude double, timestamp long, ingested_at string"
)
RAW = (
    "id string, vehicle struct<trip:struct<routeId:string,directionId:string,agencyId:string,startTime:string>,"
    "vehicle:struct<id:string,label:string,licensePlate:string>,position:struct<latitude:string,longitude:string>,timestamp:long>"
)


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages to typed rows; broken JSON is skipped; ``event_time`` comes from the epoch seconds."""
    m = df.select(F.from_json(F.col(value).cast("string"), MESSAGE, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    m = m.filter(F.coalesce(*[F.col(c.split(" ")[0]).cast("string") for c in MESSAGE.split(", ")]).isNotNull())
    return m.withColumn("event_time", F.timestamp_seconds("timestamp")).withColumn("epoch_s", F.col("timestamp"))


def telemetry_source(spark: SparkSession, path: str | None = None, stream: bool = True, **options) -> DataFrame:
    """Messages from a folder of JSON-line text files, or from Kafka when options such as ``subscribe`` are given."""
    reader = spark.readStream if stream else spark.read
    if path is None:
        return parse_messages(reader.format("kafka").options(**options).load())
    return parse_messages(reader.format("text").options(**options).load(path))


def sanitize_vehicle_payload(df: DataFrame, ingested_at: Column, value: str = "value") -> DataFrame:
    """Nested raw records to flat ones; rows without a numeric position or a route are dropped, absent ids become blank."""
    r = df.select(F.from_json(F.col(value).cast("string"), RAW, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flat = r.select(
        F.coalesce(F.col("vehicle.vehicle.id"), F.col("id"), F.lit("")).alias("vehicle_id"),
        text("vehicle.vehicle.label").alias("label"),
        text("vehicle.vehicle.licensePlate").alias("license_plate"),
        text("vehicle.trip.routeId").alias("route_id"),
        F.col("vehicle.trip.directionId").try_cast("int").alias("direction_id"),
        text("vehicle.trip.agencyId").alias("agency_id"),
        text("vehicle.trip.startTime").alias("trip_start_time"),
        F.col("vehicle.position.latitude").try_cast("double").alias("latitude"),
        F.col("vehicle.position.longitude").try_cast("double").alias("longitude"),
        F.col("vehicle.timestamp").alias("timestamp"),
        ingested_at.alias("ingested_at"),
    )
    return flat.filter("latitude is not null and longitude is not null and route_id <> ''")


def positions_passthrough(df: DataFrame, ingested_at: Column) -> DataFrame:
    """Every event as a row of the positions fact, event time to milliseconds."""
    return df.select(
        F.date_trunc("MILLISECOND", "event_time").alias("event_time"),
        "vehicle_id", "route_id", F.col("direction_id").cast("smallint").alias("direction_id"), "agency_id", "latitude", "longitude",
        "license_plate", "trip_start_time", ingested_at.alias("ingested_at"),
    )
