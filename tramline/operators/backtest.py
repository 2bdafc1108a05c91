"""Rolling-origin backtests: at each of several cut-offs a model is fitted on what was known then and measured on what followed.

A labelled window is known at a cut-off if its target lies before it.  Beside the model stand two baselines: persistence (the present delay)
and the mean delay of the route, direction and hour, of the route and direction where the hour is new, of all where those are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DEFAULT, TransitConfig
from tramline.functions import exprs as X
from tramline.operators import ml
from tramline.sources.scratch import stored

RD = ("route_id", "direction_id")
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def origins(rows: DataFrame, cuts: list[int], step_s: int, cfg: TransitConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Labelled rows by cut-off (``cut``): those known at it, and those of the ``step_s`` seconds after it."""
    t = X.epoch("feature_time")
    known = rows.withColumn("cut", F.explode(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: t + cfg.horizon_minutes * 60 <= c)))
    after = rows.withColumn("cut", F.explode(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: (t >= c) & (t < c + step_s))))
    return known, after


def with_baselines(known: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with ``persistence`` and ``hour_of_day``, from ``known`` only; both may be null where nothing is known."""
    out = after.withColumn("persistence", F.coalesce(F.col("avg_delay_sec"), F.lit(0.0)))
    means = []
    for k, keys in enumerate((["cut", *RD, "hour_of_day"], ["cut", *RD], ["cut"])):
        mean = known.groupBy(*keys).agg(F.avg("target_delay_sec").alias(f"_m{k}")).select(*[F.col(c).alias(f"_{c}") for c in keys], f"_m{k}")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        out = out.join(mean, on, "left").drop(*[f"_{c}" for c in keys])
        means.append(f"_m{k}")
    return out.withColumn("hour_of_day_mean", F.coalesce(*means)).drop(*means)


def errors(scored: DataFrame, methods: dict[str, str]) -> DataFrame:
    """``cut, method, n, mae, rmse, skill``: of each method (name to column), ``skill`` being the part of persistence's MAE that it saves."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), (F.col(c) - F.col("target_delay_sec")).alias("e")) for k, c in methods.items()])).alias("x")
    out = scored.select("cut", one).filter("x.e is not null").groupBy("cut", "x.method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("x.e")).alias("mae"), F.sqrt(F.avg(F.col("x.e") * F.col("x.e"))).alias("rmse"))
    base = out.filter("method = 'persistence'").select("cut", F.col("mae").alias("_base"))
    return out.join(base, "cut", "left").withColumn("skill", F.when(F.col("_base") > 0, 1 - F.col("mae") / F.col("_base"))).drop("_base")


def backtest(features: DataFrame, cuts: list[int], step_s: int, fit: Fit | None = None, cfg: TransitConfig = DEFAULT) -> DataFrame:
    """Errors of the baselines and, with ``fit``, of the model at each cut-off.

    ``fit`` takes the known rows and gives a function that adds ``prediction`` to others.  Cut-offs with fewer than ``ml.MIN_ROWS`` known rows
    have no model.
    """
    rows = stored(ml.label_future_window(features, cfg).filter("target_delay_sec is not null"), "labelled")
    known, after = origins(rows, cuts, step_s, cfg)
    scored = stored(with_baselines(known, after), "baselines")
    out = errors(scored, {"persistence": "persistence", "hour_of_day": "hour_of_day_mean"})
    for cut in cuts if fit is not None else ():
        own = known.filter(F.col("cut") == cut)
        if own.limit(ml.MIN_ROWS).count() == ml.MIN_ROWS:
            found = fit(own)(after.filter(F.col("cut") == cut))
            modelled = errors(found.withColumn("persistence", F.coalesce("avg_delay_sec", F.lit(0.0))), {"model": "prediction", "persistence": "persistence"})
            out = out.unionByName(modelled.filter("method = 'model'"))
    return out


def boosted(max_iter: int, step: float, seed: int = 42) -> Fit:
    """The delay model of ``ml`` as a ``fit``."""

    def fit(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = ml.fit_trees(ml.build_training_dataset(known), max_iter, step, seed)

        def score(rows: DataFrame) -> DataFrame:
            keep = ("cut", "feature_time", *RD, "target_delay_sec", "_present")
            return model.transform(X.normalize_features(rows.withColumn("_present", F.col("avg_delay_sec")), keep)).withColumn("avg_delay_sec", F.col("_present"))

        return score

    return fit


def binary_report(scored: DataFrame, label: str, probability: str, at: float = 0.5) -> DataFrame:
    """``metric, value``: rows, positives, ROC AUC, precision, recall and F1 at a cut."""
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=probability, metricName="areaUnderROC").evaluate(scored)
    yes, hit = F.col(label) == 1, F.col(probability) >= at
    n = lambda c: F.count_if(c).cast("double")
    counts = scored.agg(F.count(F.lit(1)).cast("double").alias("rows"), n(yes).alias("positives"), n(yes & hit).alias("tp"), n(~yes & hit).alias("fp"), n(yes & ~hit).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    named = {"rows": F.col("rows"), "positives": F.col("positives"), "roc_auc": F.lit(float(auc)), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in named.items()])))


def class_weight(rows: DataFrame, label: str) -> Column:
    """Weights under which both classes count alike."""
    n, yes = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    return F.when(F.col(label) == 1, F.lit(n / (2 * yes) if yes else 1.0)).otherwise(F.lit(n / (2 * (n - yes)) if n > yes else 1.0))


def evaluate_bunching(features: DataFrame, bunching: DataFrame, test_fraction: float = 0.2, cfg: TransitConfig = DEFAULT, max_iter: int = 20) -> DataFrame:
    """The bunching model, both classes weighing alike, fitted on the earlier part of the windows and reported on the later one."""
    targets = ml.prediction_targets(features, bunching, cfg).select(*[F.col(c).alias(f"_{c}") for c in ("feature_time", *RD)], F.col("bunching_ahead").cast("double").alias("label"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("feature_time", *RD)]
    data = stored(X.normalize_features(features.join(targets, same), ("feature_time", *RD, "label")), "bunching")
    train, test = ml.temporal_split(data, test_fraction)
    stages = [VectorAssembler(inputCols=list(X.FEATURE_COLUMNS), outputCol="features"), LogisticRegression(maxIter=max_iter, regParam=0.01, weightCol="weight")]
    model = Pipeline(stages=stages).fit(train.withColumn("weight", class_weight(train, "label")))
    return binary_report(stored(model.transform(test).select("label", vector_to_array("probability")[1].alias("p")), "scored"), "label", "p")
