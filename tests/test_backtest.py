"""Backtests and classification reports against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tramline.config import DEFAULT
from tramline.functions import exprs as X
from tramline.operators import backtest, ml

STEP = 900


def windows(spark, n=60, routes=3):
    """Delays that swing with the hour, so that the present one misleads and a model can know better."""
    rng = random.Random(1)
    rows = []
    for r in range(routes):
        for k in range(n):
            speed = 10.0 + 5 * (k % 4)
            rows.append((k * STEP, f"r{r}", None if r == 2 else r, "network", float(60 * ((k + r) % 4) + rng.random()), speed, k * STEP // 3600 % 24))
    df = spark.createDataFrame(rows, "s long, route_id string, direction_id int, zone_id string, avg_delay_sec double, avg_speed_kmh double, hour_of_day int")
    return df.withColumn("feature_time", F.timestamp_seconds("s")), rows


def test_backtest_against_plain_errors(spark):
    df, rows = windows(spark)
    cuts, horizon = [20 * STEP, 40 * STEP, 10**9], DEFAULT.horizon_minutes * 60
    target = {(s, r): v for s, r, _, _, v, _, _ in rows}
    want = {}
    for cut in cuts:
        known, tests = defaultdict(list), []
        for s, r, _, _, v, _, h in rows:
            y = target.get((s + horizon, r))
            if y is not None and s + horizon <= cut:
                for key in ((r, h), r, None):
                    known[key].append(y)
            if y is not None and cut <= s < cut + 10 * STEP:
                tests.append((r, h, v, y))
        mean = lambda v: sum(v) / len(v)
        guess = lambda r, h, known=known: mean(known.get((r, h)) or known.get(r) or known[None])
        for name, es in (("persistence", [v - y for _, _, v, y in tests]), ("hour_of_day", [guess(r, h) - y for r, h, _, y in tests])):
            if es:
                want[cut, name] = (len(es), mean([abs(e) for e in es]), mean([e * e for e in es]) ** 0.5)
    got = {(r["cut"], r["method"]): r for r in backtest.backtest(df, cuts, 10 * STEP).collect()}
    assert got.keys() == want.keys() and len(want) == 4
    for key, (n, mae, rmse) in want.items():
        assert got[key]["n"] == n and got[key]["mae"] == pytest.approx(mae) and got[key]["rmse"] == pytest.approx(rmse)
        assert got[key]["skill"] == pytest.approx(1 - mae / want[key[0], "persistence"][1])


def test_model_is_refitted_at_each_cut_and_beats_persistence(spark, monkeypatch):
    df, _ = windows(spark)
    full = df
    for c in X.FEATURE_COLUMNS:
        if c not in full.columns:
            full = full.withColumn(c, F.lit(0.0))
    seen = []
    own = ml.fit_trees
    monkeypatch.setattr(ml, "fit_trees", lambda train, *a: seen.append(train.agg(F.max("feature_time")).first()[0].timestamp()) or own(train, *a))
    cuts = [2 * STEP, 30 * STEP, 45 * STEP]
    got = {(r["cut"], r["method"]): r for r in backtest.backtest(full, cuts, 10 * STEP, backtest.boosted(15, 0.3)).collect()}
    assert seen == [28 * STEP, 43 * STEP], "nothing of the future, and no model from too few rows"
    assert (cuts[0], "model") not in got and all(got[c, "model"]["skill"] > 0.5 and got[c, "model"]["n"] == got[c, "persistence"]["n"] for c in cuts[1:])


def test_binary_report_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(float(y := int(rng.random() < 0.3)), round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), 2)) for _ in range(400)]
    got = {r["metric"]: r["value"] for r in backtest.binary_report(spark.createDataFrame(rows, "label double, p double"), "label", "p").collect()}
    yes, no = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / len(yes) / len(no)
    tp, fp = sum(p >= 0.5 for p in yes), sum(p >= 0.5 for p in no)
    assert got["rows"] == 400 and got["positives"] == len(yes) and got["roc_auc"] == pytest.approx(auc, abs=1e-6)
    assert got["f1"] == pytest.approx(2 * tp / (tp + fp + len(yes))) and got["precision"] == pytest.approx(tp / (tp + fp)) and got["recall"] == pytest.approx(tp / len(yes))


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 8, "label double")
    sums = {r[0]: r[1] for r in df.withColumn("w", backtest.class_weight(df, "label")).groupBy("label").agg(F.sum("w")).collect()}
    assert sums == {1.0: 5.0, 0.0: 5.0}
