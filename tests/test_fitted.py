"""Least squares on ill-scaled input, fitted models on series of any length, decomposition periods per series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from ridegauge.config import BacktestConfig
from ridegauge.operators import backtest as bt, diagnosis as dg, kmeans as km, models as md
from ridegauge.operators.linear import fleet_ols


def test_least_squares_with_large_offset_and_trend(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(1e6 + i), 1e9 + 3.0 * i + float(rng.normal())) for k in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for r in fleet_ols(df, ["k"], ["x"], "y").collect():
        x, y = (np.array([row[i] for row in rows if row[0] == r["k"]]) for i in (1, 2))
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        rest = y - y.mean() - slope * (x - x.mean())
        assert r["coefficients"][1] == pytest.approx(slope, rel=1e-9)
        assert r["coefficients"][0] == pytest.approx(y.mean() - slope * x.mean(), rel=1e-9)
        assert r["sse"] == pytest.approx((rest**2).sum(), rel=1e-6) and r["nobs"] == 400
        assert r["standard_errors"][1] == pytest.approx(np.sqrt((rest**2).sum() / 398 / ((x - x.mean()) ** 2).sum()), rel=1e-6)


def test_null_regressors_and_constant_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 2.0), ("a", 2.0, 5.0, 4.0), ("a", None, 5.0, 0.0), ("a", 3.0, 5.0, None)], "k string, x double, c double, y double")
    filled = fleet_ols(df, ["k"], ["x", "c"], "y", null_regressor=0.0).first()
    assert filled["nobs"] == 3 and filled["coefficients"][1] == pytest.approx(2.0) and filled["coefficients"][2] == 0.0
    assert fleet_ols(df, ["k"], ["x"], "y").first()["nobs"] == 2
    assert fleet_ols(df, [], ["x"], "y", intercept=False, null_regressor=0.0).first()["coefficients"][0] == pytest.approx(2.0)


@pytest.mark.parametrize("make", [md.ets, md.fourier_regression, md.differenced_regression])
def test_every_series_gets_a_forecast(spark, make):
    day = dt.date(2024, 1, 1)
    lengths = {"one": 1, "six": 6, "ten": 10, "twenty": 20, "long": 90}
    rows = [(k, day + dt.timedelta(i), float(10 + i % 7)) for k, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, date date, target double")
    out = make(df, ["series_id"], 9).collect()
    for k, n in lengths.items():
        mine = sorted((r["horizon_step"], r["date"], r["prediction"]) for r in out if r["series_id"] == k)
        assert [(s, d) for s, d, _ in mine] == [(s, day + dt.timedelta(n - 1 + s)) for s in range(1, 10)]
        assert all(p is not None and p >= 0 for _, _, p in mine)
    assert {r["prediction"] for r in out if r["series_id"] == "one"} == {10.0}


def test_smoothing_keeps_season_slots_over_missing_values(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(i), None if i in (30, 31, 47) else float(100 * (i % 7 == 2))) for i in range(70)]
    out = md.ets(spark.createDataFrame(rows, "series_id string, date date, target double"), ["series_id"], 7).collect()
    peak = max(out, key=lambda r: r["prediction"])
    assert (70 - 1 + peak["horizon_step"]) % 7 == 2


def test_decomposition_periods_follow_the_length(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(k, start + dt.timedelta(i), float(i % 7)) for k, n in (("s", 20), ("m", 100), ("l", 800), ("t", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, timestamp timestamp, value_filled double")
    found = {r["series_id"]: r for r in dg.fitting_decomposition(df, ["series_id"], (7, 30, 365), 7).collect()}
    assert {k: r["decomposition_periods_used"] for k, r in found.items()} == {"t": "7", "s": "7", "m": "7|30", "l": "7|30|365"}
    assert found["t"]["decomposition_status"] == "insufficient_history" and found["l"]["decomposition_status"] == "ok"


def test_elbow_seeds_are_spread_over_all_points(spark):
    points = spark.range(5_000).selectExpr("id AS label", "CAST(id AS DOUBLE) AS x", "CAST(0 AS DOUBLE) AS y")
    row = km.elbow(points, (4,), 4).first()
    assert row["wcss"] == pytest.approx(4 * sum((i - 624.5) ** 2 for i in range(1_250)), rel=1e-3)


def test_fitted_models_are_scored_on_every_fold(spark):
    day = dt.date(2024, 1, 1)
    rows = [(k, day + dt.timedelta(i), float(20 + 5 * (i % 7) + (i if k == "b" else 0))) for k in ("a", "b") for i in range(120)]
    df = spark.createDataFrame(rows, "series_id string, date date, target double")
    config = BacktestConfig(horizons=(7,), initial_train_size=80, step_size=14, max_folds=2)
    base = bt.baseline_backtest(df, ["series_id"], config)
    fitted = md.fitted_backtest(df, ["series_id"], config)
    assert fitted.columns == base.columns
    every = base.unionByName(fitted)
    found = {(r["series_id"], r["model_name"].removesuffix("_fallback"), r["fold_id"]): r["count"] for r in every.groupBy("series_id", "model_name", "fold_id").count().collect()}
    names = {"naive", *(f"seasonal_naive_{p}" for p in config.seasonal_naive_periods), *md.FITTED}
    assert set(found) == {(k, n, f) for k in ("a", "b") for n in names for f in (1, 2)} and set(found.values()) == {7}
    best = bt.compare_models(bt.metrics(every.filter("series_id = 'a'"), ["model_name", "fold_id", "horizon"]), ("model_name", "horizon"))
    assert best.first()["mean_mae"] < 1e-6
