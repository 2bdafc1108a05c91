"""Labels, training and scoring of route-delay models with spark.ml."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X
from tramline.operators.views import newest_per
from tramline.sources.scratch import shared_folder

RD = ("route_id", "direction_id")
MIN_ROWS = 20


def label_future_window(features: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Each window with the delay of the same route, direction and zone exactly one horizon later as its target."""
    ahead = features.select(
        F.timestamp_seconds(X.epoch("feature_time") - cfg.horizon_minutes * 60).alias("_t"), F.col("route_id").alias("_r"), F.col("direction_id").alias("_d"), F.col("zone_id").alias("_z"),
        F.col("avg_delay_sec").alias("target_delay_sec"),
    )
    same = (F.col("feature_time") == F.col("_t")) & (F.col("route_id") == F.col("_r")) & F.col("direction_id").eqNullSafe(F.col("_d")) & (F.col("zone_id") == F.col("_z"))
    return features.join(ahead, same, "left").drop("_t", "_r", "_d", "_z")


def training_rows(features: DataFrame, start: Column, end: Column, cfg: TransitConfig = DEFAULT) -> DataFrame:
    rows = label_future_window(features, cfg)
    return rows.filter((F.col("feature_time") >= start) & (F.col("feature_time") < end) & F.col("target_delay_sec").isNotNull())


def build_training_dataset(rows: DataFrame) -> DataFrame:
    """Keys, normalised features and ``target``; rows without a target are skipped."""
    keyed = rows.filter("target_delay_sec is not null").withColumn("target", F.col("target_delay_sec").cast("double"))
    return X.normalize_features(keyed, ("feature_time", *RD, "target"))


def temporal_split(rows: DataFrame, test_fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The earliest ``max(1, int(n * (1 - f)))`` rows to train on, the others to test on; ties are split by route and direction.

    The cut is found on counts by instant, so that no global ordering of rows is needed: only the instant that the cut falls
    into is ranked.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    n = rows.count()
    want = max(1, int(n * (1 - test_fraction)))
    by_time = rows.groupBy("feature_time").count()
    run = by_time.withColumn("upto", F.sum("count").over(Window.orderBy("feature_time").rowsBetween(Window.unboundedPreceding, 0)))
    cut = run.filter(F.col("upto") >= want).orderBy("feature_time").limit(1).select(F.col("feature_time").alias("_cut"), (F.lit(want) - F.col("upto") + F.col("count")).alias("_take"))
    keys = [c for c in (*RD, "zone_id") if c in rows.columns]
    j = rows.join(F.broadcast(cut))  # one row
    rank = F.row_number().over(Window.partitionBy("feature_time").orderBy(*keys))
    at = j.filter(F.col("feature_time") == F.col("_cut")).withColumn("_n", rank)
    train = j.filter(F.col("feature_time") < F.col("_cut")).select(rows.columns).union(at.filter("_n <= _take").select(rows.columns))
    test = j.filter(F.col("feature_time") > F.col("_cut")).select(rows.columns).union(at.filter("_n > _take").select(rows.columns))
    return train, test


def fit_trees(train: DataFrame, max_iter: int = DEFAULT.trees, step: float = DEFAULT.tree_step, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on normalised features and ``target``."""
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:  # the trees cut their lineage every few rounds if they can
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    trees = GBTRegressor(featuresCol="features", labelCol="target", maxIter=max_iter, stepSize=step, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(X.FEATURE_COLUMNS), outputCol="features"), trees]).fit(train)


def train_delay_model(dataset: DataFrame, test_fraction: float = 0.2, max_iter: int = DEFAULT.trees, step: float = DEFAULT.tree_step, seed: int = 42) -> tuple[PipelineModel, dict[str, float]]:
    """Gradient-boosted trees on a temporal split, with MAE and RMSE on the later part."""
    if dataset.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} labelled rows are needed")
    train, test = temporal_split(dataset, test_fraction)
    model = fit_trees(train, max_iter, step, seed)
    scored = model.transform(test)
    metric = lambda m: RegressionEvaluator(labelCol="target", metricName=m).evaluate(scored)
    return model, {"mae": metric("mae"), "rmse": metric("rmse"), "train_rows": train.count(), "test_rows": test.count()}


def save_model(model: PipelineModel, report: dict[str, float], path: str) -> None:
    """The model and, beside it, the report of its training; each replaces what is there."""
    model.write().overwrite().save(f"{path}/model")
    rows = SparkSession.active().createDataFrame([(k, float(v)) for k, v in sorted(report.items())], "metric string, value double")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, value double").json(f"{path}/report")


def load_model(path: str) -> PipelineModel | None:
    """The saved model, or None if there is none."""
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model/metadata")
    return PipelineModel.load(f"{path}/model") if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def importances(model: PipelineModel) -> dict[str, float]:
    """The feature importances of the model's trees, by feature."""
    return dict(zip(X.FEATURE_COLUMNS, model.stages[-1].featureImportances.toArray().tolist(), strict=True))


def score_saved(features: DataFrame, as_of: Column, path: str, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """``score_latest_features`` by the model saved in ``path``, or by the closed-form baseline as long as there is none."""
    return score_latest_features(features, as_of, load_model(path), cfg)


def score_latest_features(features: DataFrame, as_of: Column, model: PipelineModel | None = None, cfg: TransitConfig = DEFAULT, version: str | None = None) -> DataFrame:
    """Prediction rows for the latest windows, by the model or by the closed-form baseline."""
    latest = newest_per(X.recent_filter(features, "feature_time", as_of, 7200), [*RD, "zone_id"], [F.col("feature_time").desc()])
    rows = X.normalize_features(latest, ("feature_time", *RD))
    rows = rows.withColumn("predicted_delay_sec", X.warm_start_score()) if model is None else model.transform(rows).withColumnRenamed("prediction", "predicted_delay_sec")
    warm = model is None
    return rows.select(
        as_of.alias("prediction_time"), F.timestamp_seconds(X.epoch(as_of) + cfg.horizon_minutes * 60).alias("target_time"), F.lit(cfg.horizon_minutes).alias("horizon_minutes"), *RD,
        "predicted_delay_sec", F.lit(None).cast("double").alias("prediction_lower_sec"), F.lit(None).cast("double").alias("prediction_upper_sec"),
        X.risk_level("predicted_delay_sec", cfg.high_delay_s).alias("risk_level"), F.lit(cfg.warm_start_confidence if warm else None).cast("double").alias("confidence"),
        F.lit(version or (cfg.warm_start_version if warm else cfg.model_version)).alias("model_version"), "feature_time", as_of.alias("generated_at"),
    )


def prediction_targets(features: DataFrame, bunching: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Delay at the horizon, whether it is high, and whether vehicles bunch within the horizon."""
    rows = label_future_window(features, cfg).select("feature_time", *RD, "zone_id", "target_delay_sec", X.high_delay_label("target_delay_sec", cfg.high_delay_s).alias("high_delay"))
    span = cfg.horizon_minutes * 60
    b = bunching.select(F.explode(F.array(F.floor(X.epoch("event_time") / span), F.floor(X.epoch("event_time") / span) - 1)).alias("_b"), F.col("route_id").alias("_r"), F.col("direction_id").alias("_d"), X.epoch("event_time").alias("_t")).distinct()
    t = X.epoch("feature_time")
    hit = rows.withColumn("_b0", F.floor(t / span)).join(
        b, (F.col("_b0") == F.col("_b")) & (F.col("route_id") == F.col("_r")) & (F.col("direction_id") == F.col("_d")) & (F.col("_t") > t) & (F.col("_t") <= t + span), "left_semi"
    ).select("feature_time", *RD, F.lit(1).alias("_hit")).distinct()
    for k in RD:
        hit = hit.withColumnRenamed(k, f"_{k}")
    hit = hit.withColumnRenamed("feature_time", "_ft")
    out = rows.join(hit, (F.col("feature_time") == F.col("_ft")) & (F.col("route_id") == F.col("_route_id")) & F.col("direction_id").eqNullSafe(F.col("_direction_id")), "left")
    return out.withColumn("bunching_ahead", F.coalesce("_hit", F.lit(0))).drop("_ft", "_route_id", "_direction_id", "_hit")


def baseline_predictions(features: DataFrame, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Labelled windows beside two baselines: the present delay, and the mean of their route, direction and hour."""
    rows = label_future_window(features, cfg).filter("target_delay_sec is not null")
    hourly = rows.groupBy(F.col("route_id").alias("_r"), F.col("direction_id").alias("_d"), F.col("hour_of_day").alias("_h")).agg(F.avg("target_delay_sec").alias("hour_of_day_delay"))
    same = (F.col("route_id") == F.col("_r")) & F.col("direction_id").eqNullSafe(F.col("_d")) & (F.col("hour_of_day") == F.col("_h"))
    return rows.join(hourly, same).select("feature_time", *RD, "target_delay_sec", F.col("avg_delay_sec").alias("persistence_delay"), "hour_of_day_delay")


def feature_attribution(features: DataFrame, importances: dict[str, float], as_of: Column, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Associations, not causes: each latest window's features ranked by importance times distance from the mean in deviations."""
    rows = X.normalize_features(features, ("feature_time", *RD))
    stats = rows.agg(*[F.struct(F.avg(c).alias("m"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("s")).alias(f"_{c}") for c in X.FEATURE_COLUMNS])
    latest = newest_per(rows, list(RD), [F.col("feature_time").desc()]).join(F.broadcast(stats))  # one row
    z = lambda c: F.when(F.col(f"_{c}.s") > 0, F.abs(F.col(c) - F.col(f"_{c}.m")) / F.col(f"_{c}.s")).otherwise(0.0)
    long = latest.select("feature_time", *RD, F.explode(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("feature_value"), (z(c) * importances.get(c, 0.0)).alias("contribution_score")) for c in X.FEATURE_COLUMNS])).alias("f"))
    rank = F.row_number().over(Window.partitionBy(*RD).orderBy(F.col("f.contribution_score").desc(), "f.feature_name"))
    return long.select(as_of.alias("attribution_time"), "feature_time", *RD, "f.*", rank.alias("feature_rank"), F.lit(cfg.model_version).alias("model_version"))


def bunching_prediction(features: DataFrame, bunching: DataFrame, as_of: Column, cfg: TransitConfig = DEFAULT, max_iter: int = 20) -> DataFrame:
    """Probability that a route direction's vehicles bunch within the horizon, from a logistic regression on its windows."""
    targets = prediction_targets(features, bunching, cfg).select("feature_time", *RD, F.col("bunching_ahead").cast("double").alias("label"))
    keys = ["feature_time", *RD]
    t = targets
    for k in keys:
        t = t.withColumnRenamed(k, f"_{k}")
    rows = features.join(t, (F.col("feature_time") == F.col("_feature_time")) & (F.col("route_id") == F.col("_route_id")) & F.col("direction_id").eqNullSafe(F.col("_direction_id")))
    data = X.normalize_features(rows, (*keys, "label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(X.FEATURE_COLUMNS), outputCol="features"), LogisticRegression(maxIter=max_iter, regParam=0.01)]).fit(data)
    latest = newest_per(X.normalize_features(features, tuple(keys)), list(RD), [F.col("feature_time").desc()])
    p = F.col("probability")
    from pyspark.ml.functions import vector_to_array

    return model.transform(latest).select(as_of.alias("prediction_time"), F.timestamp_seconds(X.epoch(as_of) + cfg.horizon_minutes * 60).alias("target_time"), *RD, vector_to_array(p)[1].alias("bunching_probability"), "feature_time")
