"""Trees boosted in one task: GBTRegressor's results without its jobs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from ridegauge.operators import boosting, models as md

COLUMNS = ["a", "b", "c", "d", "e"]


def sample(spark, n=1500):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(n):
        a, b, c, d = float(rng.integers(0, 7)), float(rng.normal()), float(rng.random() < 0.03), float(rng.integers(1, 100))
        rows.append((a, b, c, d, 5.0, 3 * a + (d / 5 if b > 0.3 else 0) + 20 * c + float(rng.normal())))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, target double").coalesce(1).cache()


@pytest.mark.parametrize("depth, rate", [(3, 0.3), (7, 0.05)])
def test_same_trees_as_spark(spark, depth, rate):
    rows = sample(spark)
    params = {"learning_rate": rate, "max_depth": depth, "n_estimators": 5}
    theirs = [r["_p"] for r in md.fit_trees(rows, params, COLUMNS).transform(rows).collect()]
    (forest,) = md.fit_all(rows, [params], COLUMNS)
    assert [r["_p"] for r in forest.transform(rows).collect()] == pytest.approx(theirs, rel=1e-9)


def test_large_tables_keep_spark_trees(spark, monkeypatch):
    rows = sample(spark, 60)
    params = {"learning_rate": 0.3, "max_depth": 2, "n_estimators": 2}
    (forest,) = md.fit_all(rows, [params], COLUMNS)
    monkeypatch.setattr(md, "TASK_ROWS", 59)
    (model,) = md.fit_all(rows, [params], COLUMNS)
    assert not isinstance(model, boosting.Forest)
    assert [r["_p"] for r in forest.transform(rows).collect()] == pytest.approx([r["_p"] for r in model.transform(rows).collect()])


def test_odd_rows(spark):
    schema = "a double, target double"
    params = {"learning_rate": 0.1, "max_depth": 3, "n_estimators": 4}
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], schema)
    assert [r["_p"] for r in boosting.fit(flat, [params], ["a"])[0].transform(flat).collect()] == pytest.approx([3.0, 3.0])
    one = spark.createDataFrame([(1.0, 2.0)], schema)
    assert boosting.fit(one, [params], ["a"])[0].transform(one).first()["_p"] == 2.0
    for bad in ([(None, 2.0), (1.0, 3.0)], [(float("nan"), 2.0), (1.0, 3.0)], []):
        with pytest.raises(Exception):  # noqa: B017
            boosting.fit(spark.createDataFrame(bad, schema), [params], ["a"])


def test_jobs_do_not_grow_with_trees(spark):
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(day + dt.timedelta(i % 50), float(i % 9), float(i % 7), float(i % 9 * 2)) for i in range(400)], "date date, a double, b double, target double")
    grids = {"x": [{"learning_rate": 0.1, "max_depth": 3, "n_estimators": n} for n in (30, 31)]}
    context = spark.sparkContext
    context.setJobGroup("trees", "trees")
    try:
        params, table = md.tune_families(rows, grids, 7, ["a", "b"])["x"]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert params in grids["x"] and all(r["validation_mae"] is not None for r in table.collect())
    assert len(context.statusTracker().getJobIdsForGroup("trees")) < 60
