"""Registered queries run the whole configuration."""

from __future__ import annotations

import datetime as dt

import pytest

import __spark_entry__ as entry
from ridegauge.catalog import forecasting as fc, models as cm
from ridegauge.config import BacktestConfig, SeriesDiagnosisConfig, StationConfig
from ridegauge.operators import backtest as bt, models as md

QUERIES = entry.queries()
SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def fitted(spark):
    return rows_of(spark, "m03_fitted_forecasts")


def test_fitted_backtest_holds_every_fold_and_day(spark, fitted):
    config = BacktestConfig()
    plain = bt.baseline_backtest(fc.target(spark, SF), ["series_id"], config).filter("model_name = 'naive'").collect()
    days = {(r["series_id"], r["fold_id"], r["horizon"], r["date"]) for r in plain}
    assert {h for _, _, h, _ in days} == set(config.horizons)
    for model in md.FITTED:
        mine = [(r["series_id"], r["fold_id"], r["horizon"], r["date"]) for r in fitted if r["model_name"].removesuffix("_fallback") == model]
        assert len(mine) == len(set(mine)) and set(mine) == days
    assert all(r["prediction"] >= 0 for r in fitted)


def test_ranked_models_follow_from_the_forecasts(spark, fitted):
    found = {(r["series_id"], r["model_name"], r["horizon"]): r for r in rows_of(spark, "m10_rank_all_models")}
    folds = {}
    for r in fitted:
        if r["actual"] is not None:
            folds.setdefault((r["series_id"], r["model_name"], r["horizon"]), {}).setdefault(r["fold_id"], []).append(r["prediction"] - r["actual"])
    for key, errors in folds.items():
        means = [(sum(map(abs, e)) / len(e), sum(e) / len(e)) for e in errors.values()]
        assert found[key]["mean_mae"] == pytest.approx(sum(m for m, _ in means) / len(means), abs=1e-4)
        assert found[key]["mean_bias"] == pytest.approx(sum(b for _, b in means) / len(means), abs=1e-4)
        assert found[key]["folds"] == len(errors)


def test_fitted_folds_against_fits_of_cut_series(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(i), float(20 + 5 * (i % 7) + i % 11)) for i in range(120)]
    frame = lambda part: spark.createDataFrame(part, "series_id string, date date, target double")
    config = BacktestConfig(horizons=(7, 14), initial_train_size=80, step_size=14, max_folds=2)
    got = {}
    for r in md.fitted_backtest(frame(rows), ["series_id"], config).collect():
        got.setdefault((r["horizon"], r["train_end"]), {})[r["model_name"], r["date"]] = r["prediction"]
    assert {h for h, _ in got} == {7, 14} and len(got) == 4
    (h, end), found = max(got.items())
    want = {}
    for make in md.FITTED.values():
        for r in make(frame([x for x in rows if x[1] <= end]), ["series_id"], h).collect():
            want[r["model_name"], r["date"]] = r["prediction"]
    assert found == pytest.approx(want, rel=1e-6)


def test_clusters_of_the_whole_configuration(spark):
    config = StationConfig()
    labelled = rows_of(spark, "j14_cluster_stations")
    selection = rows_of(spark, "j07_j09_cluster_selection")
    eligible = [r for r in labelled if r["cluster_eligible"]]
    if len(eligible) < config.min_cluster_eligible:
        assert not selection and {r["cluster_label"] for r in labelled} <= {"not_clustered_not_eligible", "not_clustered_insufficient_eligible_stations"}
    else:
        assert [r["candidate_k"] for r in sorted(selection)] == [k for k in config.k_values if k < len(eligible)]
        chosen = [r["candidate_k"] for r in selection if r["selected"]]
        assert len(chosen) == 1 and len({r["cluster_label"] for r in eligible}) <= chosen[0]
        assert all(-1 <= r[c] <= 1 for r in selection for c in ("silhouette_score", "seed_stability_ari", "bootstrap_stability_ari"))
    assert len({r["station_id"] for r in labelled}) == len(labelled)
    assert {r["station_id"] for r in rows_of(spark, "a13_slice_lookup")} == {r["station_id"] for r in labelled}


TREE_QUERIES = {"l09_tune", "l08_l10_station_trees"}


def test_trees_of_the_whole_grid(spark):
    """The grid's values with few trees each: candidates, choice and forecasts; the registered queries differ in the number of trees only."""
    few = {family: [{**p, "n_estimators": 3 + i} for i, p in enumerate(grid)] for family, grid in md.TREE_GRID.items()}
    panel = fc.station_panel(spark, SF)
    tuned = md.tune_families(cm.tree_rows(panel), few, 30)
    for family, (params, table) in tuned.items():
        rows = sorted(table.collect())
        assert [(r["learning_rate"], r["max_depth"], r["n_estimators"]) for r in rows] == [(p["learning_rate"], p["max_depth"], p["n_estimators"]) for p in few[family]]
        assert [r["selected"] for r in rows].count(True) == 1 and params == few[family][[r["selected"] for r in rows].index(True)]
        scored = [r for r in rows if r["validation_mae"] is not None]
        assert not scored or min(scored, key=lambda r: r["validation_mae"])["selected"]
    out = md.station_tree_families(panel, 30, {family: params for family, (params, _) in tuned.items()}).collect()
    stations = {r["station_id"] for r in panel.select("station_id").distinct().collect()}
    keys = {(r["model_name"], r["station_id"], r["horizon_step"]) for r in out}
    assert keys == {(f, s, h) for f in few for s in stations for h in range(1, 31)} and len(out) == len(keys)
    assert all(r["prediction"] >= 0 for r in out) and TREE_QUERIES <= set(QUERIES)


@pytest.mark.parametrize("name", ["h16_acf", "h16_acf_all_lags", "h16_pacf"])
def test_autocorrelation_reaches_the_last_lag(spark, name):
    assert QUERIES[name](spark, SF).agg({"lag": "max"}).first()[0] == SeriesDiagnosisConfig().max_acf_lag


def test_trip_detail_reads_timestamps_once_a_trip(spark):
    """Repeated station ids multiply trips, so nothing but columns is left to do above the lookups."""
    plan = QUERIES["f05_trip_detail"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan.split("Join", 1)[0]
