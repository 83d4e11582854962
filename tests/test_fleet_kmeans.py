"""Many k-means fits in one pass: against plain Lloyd iterations, exact resamples, silhouettes and agreement of the Spark library."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ridegauge.config import StationConfig
from ridegauge.operators import clustering as cl, fleet_kmeans as fk


def blobs(n: int = 120) -> np.ndarray:
    rng = np.random.default_rng(3)
    middles = np.array([[0, 0, 0], [6, 0, 1], [0, 7, 2], [9, 9, 0]], float)
    return middles[np.arange(n) % 4] + rng.normal(0, 0.8, (n, 3))


def frame(spark, x: np.ndarray):
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "station_id string, features array<double>").repartition(4)


def lloyd(x, w, centers):
    centers = centers.copy()
    for _ in range(fk.ROUNDS):
        label = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        cost = (w * ((x - centers[label]) ** 2).sum(1)).sum()
        moved = centers.copy()
        for c in range(len(centers)):
            if w[label == c].sum():
                moved[c] = np.average(x[label == c], axis=0, weights=w[label == c])
        shift = np.sqrt(((moved - centers) ** 2).sum(1)).max()
        centers = moved
        if shift <= fk.TOLERANCE:
            break
    return centers, cost


def test_all_models_against_plain_iterations(spark):
    x = blobs()
    points = fk.prepared(frame(spark, x), len(x), [40, 96], [5, 6])
    rows = points.collect()
    data, weights = np.array([r["features"] for r in rows]), np.array([r["weights"] for r in rows])
    assert weights[:, 0].tolist() == [1] * len(x) and weights[:, 1].sum() == 40 and weights[:, 2].sum() == 96
    models = [fk.Model(k, w, seed) for k in (2, 4, 5) for w in (0, 1, 2) for seed in (1, 2)]
    fits = fk.fit(points, models)
    sample = points.select("features", "weights").orderBy(F.xxhash64("features"), "features").collect()
    start, mass = np.array([r["features"] for r in sample]), np.array([r["weights"] for r in sample], float)
    for m, f in zip(models, fits, strict=True):
        centers, cost = lloyd(data, weights[:, m.weight].astype(float), fk.plus_plus(start, mass[:, m.weight], m.k, np.random.default_rng(m.seed)))
        assert f.centers == pytest.approx(centers, abs=1e-9) and f.cost == pytest.approx(cost)
    kept = fk.best(fits, lambda m: (m.k, m.weight))
    assert all(kept[m.k, m.weight].cost <= f.cost for m, f in zip(models, fits, strict=True))


def test_silhouettes_sizes_and_agreement(spark):
    x = blobs()
    points = fk.prepared(frame(spark, x), len(x), [], [])
    fits = fk.fit(points, [fk.Model(4, 0, 1), fk.Model(3, 0, 2), fk.Model(2, 0, 3)])
    labelled = fk.labels(points, fits).cache()
    judge = ClusteringEvaluator(featuresCol="v", predictionCol="p")
    for i, (sizes, score) in enumerate(fk.sizes_and_silhouettes(points, fits)):
        one = points.join(labelled, "station_id").select(array_to_vector("features").alias("v"), F.get("labels", F.lit(i)).alias("p"))
        assert score == pytest.approx(judge.evaluate(one))
        assert sorted(sizes) == sorted(r["count"] for r in one.groupBy("p").count().collect())
    both = labelled.select(F.get("labels", F.lit(0)).alias("a"), F.get("labels", F.lit(1)).alias("b"))
    assert fk.agreements(labelled, [(0, 1), (0, 0)]) == pytest.approx([cl.ari(both, "a", "b").first()[0], 1.0])


def test_fewer_distinct_points_than_clusters(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 1.0]], 20, 0)
    points = fk.prepared(frame(spark, x), len(x), [12], [1])
    fits = fk.fit(points, [fk.Model(6, 0, 1), fk.Model(6, 1, 2)])
    assert [f.cost for f in fits] == [0.0, 0.0]
    sizes, score = fk.sizes_and_silhouettes(points, fits[:1])[0]
    assert sizes == [20, 20] and score == pytest.approx(1.0)
    alone = fk.fit(points.limit(1), [fk.Model(2, 0, 1)])
    assert math.isnan(fk.sizes_and_silhouettes(points.limit(1), alone)[0][1])


@pytest.mark.parametrize("n", [1, 4_095, 4_096, 9_000])
def test_resamples_have_their_exact_size_in_every_block(n):
    for size, totals in zip((7, 5_000), fk.draw(n, [7, 5_000], [1, 2]), strict=True):
        assert totals.sum() == size and len(totals) == -(-n // fk.RANK_BLOCK)


def test_selection_finds_the_planted_clusters(spark):
    x = blobs(160)
    matrix = spark.createDataFrame([(f"{i:05d}", *map(float, v)) for i, v in enumerate(x)], "station_id string, a double, b double, c double")
    config = StationConfig(k_values=(2, 3, 4, 5))
    rows, centers = cl.evaluate_k(matrix, config)
    assert [r["candidate_k"] for r in rows] == [2, 3, 4, 5] and {k: len(c) for k, c in centers.items()} == {2: 2, 3: 3, 4: 4, 5: 5}
    best = max(rows, key=lambda r: r["silhouette_score"])
    assert best["candidate_k"] == 4 and best["bootstrap_stability_ari"] > 0.95 and best["seed_stability_ari"] == pytest.approx(1.0)
    assert (best["min_cluster_size"], best["max_cluster_size"], best["all_clusters_valid"]) == (40, 40, True)
    assert all(type(v) in (int, float, bool) for r in rows for v in r.values())
    assert cl.evaluate_k(matrix.limit(2), config) == ([], {})


def test_few_jobs(spark):
    x = blobs()
    matrix = spark.createDataFrame([(f"{i:05d}", *map(float, v)) for i, v in enumerate(x)], "station_id string, a double, b double, c double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fleet-kmeans", "count jobs")
    try:
        cl.evaluate_k(matrix, StationConfig())
        # Adaptive execution makes a job of each stage of a pass.
        assert len(tracker.getJobIdsForGroup("fleet-kmeans")) <= 2 * (fk.ROUNDS + 10)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
