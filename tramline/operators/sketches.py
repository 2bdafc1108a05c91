"""Mergeable minute states for quantiles and distinct counts, beside the exact aggregates.

An exact 95th percentile or distinct count needs all values of an hour again; here a minute keeps a quantile sketch and a distinct-count sketch
of bounded size, and hours, days or late minutes are merged from those.  A state grows neither with the rows of its window nor,
in a stream, with how long the window stays open.

Error bounds, at three standard deviations: the share of values below a quantile is off by at most ``RANK_ERROR`` (the sketch
holds all of the first ``QUANTILE_K`` values, and is exact up to there), a distinct count by ``COUNT_ERROR`` of itself or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X

RD = ("route_id", "direction_id")
QUANTILE_K = 800
RANK_ERROR = 3 * 2.296 / QUANTILE_K**0.9021
COUNT_BITS = 12
COUNT_ERROR = 3 * 1.04 / 2 ** (COUNT_BITS / 2)


def states(value: str, who: str) -> list[Column]:
    """Aggregates that can be merged later, of a measure and of who reported it."""
    v = F.col(value).cast("double")
    return [
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, QUANTILE_K).alias("quantiles"),
        F.hll_sketch_agg(F.col(who).cast("string"), COUNT_BITS).alias("distinct"),
    ]


def minute_states(df: DataFrame, ts: str, value: str, who: str, seconds: int = 60) -> DataFrame:
    """``bucket`` and the states of each window and route direction; rows without the measure are left out."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(X.bucket(ts, seconds).alias("bucket"), *RD).agg(*states(value, who))


def merged(minutes: DataFrame, seconds: int) -> DataFrame:
    """Longer windows from shorter ones."""
    return minutes.groupBy(X.bucket("bucket", seconds).alias("bucket"), *RD).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    )


def estimates(held: DataFrame, share: float = 0.95) -> DataFrame:
    """``vehicle_count, avg, max, min`` and the quantile of each window."""
    out = held.withColumn("quantile", F.kll_sketch_get_quantile_double("quantiles", F.lit(share)))
    return out.select("bucket", *RD, F.col("n").alias("observations"), F.hll_sketch_estimate("distinct").alias("vehicle_count"), (F.col("total") / F.col("n")).alias("avg"), F.col("high").alias("max"), F.col("low").alias("min"), "quantile")


def checked(found: DataFrame, df: DataFrame, ts: str, value: str, who: str, seconds: int, share: float = 0.95) -> DataFrame:
    """The estimates beside the rows they stand for: whether quantile and distinct count are within their bounds."""
    rows = df.filter(F.col(value).isNotNull()).select(X.bucket(ts, seconds).alias("_b"), *[F.col(c).alias(f"_{c}") for c in RD], F.col(value).cast("double").alias("_v"), F.col(who).alias("_who"))
    same = (F.col("bucket") == F.col("_b")) & F.col("route_id").eqNullSafe(F.col("_route_id")) & F.col("direction_id").eqNullSafe(F.col("_direction_id"))
    below, upto = F.avg((F.col("_v") < F.col("quantile")).cast("double")), F.avg((F.col("_v") <= F.col("quantile")).cast("double"))
    off = F.abs(F.first("vehicle_count") - F.count_distinct("_who"))
    return found.join(rows, same).groupBy("bucket", *RD).agg(
        F.first("observations").alias("observations"), F.first("avg").alias("avg"), F.first("max").alias("max"), F.first("min").alias("min"),
        ((below <= share + RANK_ERROR) & (upto >= share - RANK_ERROR)).alias("quantile_within"), (off <= F.greatest(F.lit(1.0), COUNT_ERROR * F.count_distinct("_who"))).alias("count_within"),
    )


def stream_states(df: DataFrame, value: str, who: str, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """The minute states of a stream, each told once the watermark has passed its minute."""
    marked = df.filter(F.col(value).isNotNull()).withWatermark("event_time", f"{cfg.watermark_s} seconds")
    out = marked.groupBy(F.window("event_time", "1 minute").alias("w"), *RD).agg(*states(value, who))
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])
