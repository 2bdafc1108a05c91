"""Writing facts: time-partitioned Parquet, JDBC batches, idempotent appends, range refresh and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import exprs as X
from tramline.sources.chunks import Chunked

# Days that each table keeps.
RETENTION_DAYS = {
    "vehicle_positions": 7, "bunching_events": 30, "service_gap_alerts": 30, "route_delay_predictions": 30, "bunching_predictions": 30,
    "delay_feature_attributions": 30, "route_delay_metrics": 90, "segment_speed_stats": 90, "telemetry_freshness_metrics": 90,
    "stop_delay_events": 180, "stop_dwell_times": 180, "realtime_feature_windows": 180, "geo_delay_hotspots": 180,
    "hourly": 365, "daily": 730,
}
STOP_DELAY_KEY = ("observed_time", "vehicle_id", "route_id", "direction_id", "trip_id", "stop_id")


def time_partitioned(df: DataFrame, ts: str, by: str = "day") -> DataFrame:
    """Adds the partition column: ``event_date``, or ``event_hour`` for positions."""
    return df.withColumn("event_hour", F.date_format(ts, "yyyy-MM-dd-HH")) if by == "hour" else df.withColumn("event_date", F.to_date(ts))


def write_partitioned(df: DataFrame, path: str, ts: str, by: str = "day", mode: str = "append") -> None:
    """One writer per partition value and task; with mode overwrite only the partitions at hand are replaced."""
    part = "event_hour" if by == "hour" else "event_date"
    time_partitioned(df, ts, by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def read_between(df: DataFrame, ts: str, start: Column, end: Column, part: str = "event_date") -> DataFrame:
    """Rows of a partitioned fact in [start, end), with the partition predicate that lets whole folders be skipped."""
    return df.filter(F.col(part).between(F.to_date(start), F.to_date(end)) & (F.col(ts) >= start) & (F.col(ts) < end))


def read_since(df: DataFrame, ts: str, edge: Column, part: str = "event_date") -> DataFrame:
    """Rows from ``edge`` on; where the table has the partition column, older folders are not opened."""
    fresh = df.filter(F.col(ts) >= edge)
    return fresh.filter(F.col(part) >= F.to_date(edge)) if part in df.columns else fresh


def insert_unique(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = STOP_DELAY_KEY) -> DataFrame:
    """Rows of ``new`` whose key, nulls being equal, isn't there yet; of several with one key, the smallest in column order."""
    old = existing.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(new.columns) if rest else new.distinct()
    return one.join(old, same, "left_anti")


def since(as_of: Column, lookback_s: int, bucket_s: int) -> Column:
    """The start of the bucket that the look-back reaches into."""
    return X.bucket(as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_s)), bucket_s)


def refresh_from(existing: DataFrame, recomputed: DataFrame, ts: str, edge: Column) -> DataFrame:
    """The table with everything from ``edge`` on replaced."""
    return existing.filter(F.col(ts) < edge).unionByName(recomputed.filter(F.col(ts) >= edge))


def apply_retention(spark: SparkSession, name: str, table: Chunked, as_of_s: int) -> int:
    """Drops what is older than the days that the table of that name keeps; returns the number of chunks that went whole."""
    return table.drop_before(spark, as_of_s - RETENTION_DAYS[name] * 86400)


def predictions_append(df: DataFrame, path: str) -> None:
    df.withColumn("prediction_date", F.to_date("prediction_time")).write.mode("append").partitionBy("prediction_date").parquet(path)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def jdbc_sink(url: str, table: str, batch: int = 500, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends micro-batches over JDBC."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch, **options).save()

    return write


def parquet_sink(path: str, ts: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that is safe to repeat: a micro-batch owns its folder and overwrites it on retry."""

    def write(df: DataFrame, batch_id: int) -> None:
        time_partitioned(df, ts).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write
