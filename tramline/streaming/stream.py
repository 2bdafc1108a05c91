"""Structured Streaming forms of the telemetry metrics; those with timers and ordered state are in ``ordered``.

Streams carry ``vehicle_id, route_id, direction_id, latitude, longitude, epoch_s, event_time`` (and ``event_id`` if there is one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tramline.config import DEFAULT, TransitConfig
from tramline.operators import matching

RD = ("route_id", "direction_id")


def watermarked(df: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    return df.withWatermark("event_time", f"{cfg.watermark_s} seconds")


def dedup(df: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """One report per vehicle and instant, as an idempotent producer would send."""
    return watermarked(df, cfg).dropDuplicatesWithinWatermark(["vehicle_id", "epoch_s"])


def _windowed(df: DataFrame, duration: str, *aggs) -> DataFrame:
    out = df.groupBy(F.window("event_time", duration).alias("w"), *RD).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *RD, *[c for c in out.columns if c not in ("w", *RD)])


def freshness(df: DataFrame, as_of=None, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """One-minute freshness; distinct vehicles are counted exactly as a set, since streams refuse distinct counts."""
    now = F.unix_timestamp(F.current_timestamp()) if as_of is None else as_of
    aged = watermarked(df, cfg).withColumn("age", (now - F.col("epoch_s")).cast("double"))
    return _windowed(
        aged, "1 minute", F.size(F.collect_set("vehicle_id")).alias("vehicle_count"), F.avg("age").alias("avg_freshness_sec"), F.max("age").alias("max_freshness_sec"),
        F.min("age").alias("min_freshness_sec"), F.percentile("age", 0.95).alias("p95_freshness_sec"),
    )


def service_gap(df: DataFrame, threshold_s: float = 600, cfg: TransitConfig = DEFAULT, max_vehicles: int = 1) -> DataFrame:
    out = _windowed(
        watermarked(df, cfg), "10 minutes", F.min("epoch_s").alias("lo"), F.max("epoch_s").alias("hi"), F.size(F.collect_set("vehicle_id")).alias("vehicles")
    )
    out = out.filter((F.col("vehicles") <= max_vehicles) & (F.col("hi") - F.col("lo") > threshold_s))
    return out.select(F.timestamp_seconds("lo").alias("gap_start"), F.timestamp_seconds("hi").alias("gap_end"), *RD, (F.col("hi") - F.col("lo")).cast("double").alias("gap_duration_sec"))


def bunching(df: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Stream-stream interval join; the range condition lets both sides' state expire."""
    span = cfg.bunching_join_s
    cols = ["vehicle_id", *RD, "latitude", "longitude", "epoch_s", "event_time"]
    a = watermarked(df.select(*[F.col(c).alias(f"a_{c}") if c != "event_time" else F.col(c) for c in cols]), cfg).withColumnRenamed("event_time", "a_event_time")
    z = watermarked(df.select(*[F.col(c).alias(f"z_{c}") if c != "event_time" else F.col(c) for c in cols]), cfg).withColumnRenamed("event_time", "z_event_time")
    gap = F.abs(F.col("a_epoch_s") - F.col("z_epoch_s"))
    near = F.expr(f"z_event_time between a_event_time - interval {span} seconds and a_event_time + interval {span} seconds")
    j = a.join(z, (F.col("a_route_id") == F.col("z_route_id")) & (F.col("a_direction_id") == F.col("z_direction_id")) & (F.col("a_vehicle_id") < F.col("z_vehicle_id")) & near & (gap < cfg.bunching_s))
    return j.select(
        F.col("a_event_time").alias("event_time"), F.col("a_route_id").alias("route_id"), F.col("a_direction_id").alias("direction_id"), F.col("a_vehicle_id").alias("vehicle_a_id"),
        F.col("z_vehicle_id").alias("vehicle_b_id"), gap.cast("double").alias("gap_seconds"),
    )


def session_presence(df: DataFrame, gap_s: int = 600, cfg: TransitConfig = DEFAULT) -> DataFrame:
    w = F.session_window("event_time", f"{gap_s} seconds")
    out = watermarked(df, cfg).groupBy(w.alias("w"), *RD).agg(F.count(F.lit(1)).alias("reports"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *RD, "reports")


def write_table(df: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "60 seconds") -> StreamingQuery:
    """One checkpointed query into Parquet."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def multi_sink(streams: dict[str, DataFrame], root: str, available_now: bool = True) -> dict[str, StreamingQuery]:
    """One query per metric, each with its own checkpoint, so that one slow sink holds up no other."""
    return {name: write_table(df, f"{root}/{name}", f"{root}/_checkpoints/{name}", available_now) for name, df in streams.items()}


def foreach_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def match_stops(df: DataFrame, timetable: dict[str, DataFrame], path: str, checkpoint: str, cfg: TransitConfig = DEFAULT, available_now: bool = True) -> StreamingQuery:
    """Match each micro-batch to the timetable, which is prepared once (or given as ``visits``): no batch shuffles it again.

    A micro-batch overwrites its own partition, so retries leave no duplicates.
    """
    t = timetable
    visits = t["visits"] if "visits" in t else matching.prepare_timetable(t["trips"], t["calendar"], t["stop_times"], t["stops"], cfg)

    def write(batch: DataFrame, batch_id: int) -> None:
        m = matching.match_stop_delay(batch, t["trips"], t["calendar"], t["stop_times"], t["stops"], cfg, visits)
        m.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return foreach_batch(df, write, checkpoint, available_now)


def run_to_table(df: DataFrame, root: str, spark: SparkSession) -> DataFrame:
    """Process all that is there and read the result back."""
    write_table(df, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")
