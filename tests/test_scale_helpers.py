"""Helpers that must stay exact under skew, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridegauge.operators import clustering as cl, geo
from ridegauge.operators.keyed import assert_unique, exact_quantiles, first_per_key, global_rank, last_per_key


def test_exact_quantiles_match_numpy_on_a_hot_key(spark):
    rng = random.Random(7)
    data = [("hot", rng.gauss(0, 100)) for _ in range(4000)] + [("flat", 3.0)] * 500 + [("tiny", 1.0), ("tiny", 2.0)]
    data += [("steps", float(rng.randint(0, 5))) for _ in range(900)] + [("hot", None)]
    probs = {"a": 0.025, "b": 0.5, "c": 0.999, "d": 0.0, "e": 1.0}
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in ("hot", "flat", "tiny", "steps"):
        values = [v for k, v in data if k == key and v is not None]
        assert got[key].n == len(values)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    everything = exact_quantiles(df, [], "v", {"m": 0.37}).collect()[0]
    assert everything.m == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.37))


def test_exact_quantiles_weighted(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (10.0, 4)], "v double, c int")
    row = exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.9}, weight="c").collect()[0]
    flat = [1.0] * 5 + [2.0] + [10.0] * 4
    assert (row.n, row.m, row.q) == (10, np.quantile(flat, 0.5), np.quantile(flat, 0.9))


def test_global_rank_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    ranked = global_rank(df, ["v"]).collect()
    order = sorted(r.v for r in ranked)
    assert {r.v: r["rank"] for r in ranked} == {v: i + 1 for i, v in enumerate(order)}


@pytest.mark.parametrize("shape", ["spread", "clumped", "far", "single"])
def test_nearest_join_is_exact(spark, shape):
    rng = np.random.default_rng(3)
    right = {
        "spread": rng.uniform(0, 100, (700, 2)),
        "clumped": np.vstack([rng.normal(0, 1e-4, (500, 2)), rng.normal(90, 3, (40, 2))]),
        "far": rng.uniform(1000, 1001, (300, 2)),
        "single": np.array([[5.0, 5.0]]),
    }[shape]
    left = np.vstack([rng.uniform(-20, 120, (300, 2)), np.repeat(rng.uniform(0, 1, (1, 2)), 150, axis=0)])
    ldf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(left)], "id long, latitude double, longitude double")
    rdf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(right)], "zip_code long, latitude double, longitude double")
    got = {r.id: r.zip_code for r in geo.nearest_join(ldf, rdf, "id", "zip_code").collect()}
    d = ((left[:, None, :] - right[None, :, :]) ** 2).sum(axis=2)
    assert len(got) == len(left)
    for i, z in got.items():
        assert d[i, z] == pytest.approx(d[i].min(), abs=1e-12)


def test_last_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {r.k: r.v for r in last_per_key(df, ["k"], ["seq"]).collect()} == {"a": None, "b": "z"}
    assert {r.k: r.v for r in first_per_key(df, ["k"], ["seq"]).collect()} == {"a": "x", "b": "z"}


def test_unique_key(spark):
    with pytest.raises(ValueError):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_ari_of_itself(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("a"), ((F.col("id") + 1) % 4).alias("b"))
    assert cl.ari(df, "a", "a").collect()[0].ari == pytest.approx(1.0)
    assert cl.ari(df, "a", "b").collect()[0].ari == pytest.approx(1.0)


def test_nearest_join_with_repeated_keys(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 9.0), (2, None, 1.0)], "k int, latitude double, longitude double")
    right = spark.createDataFrame([("a", 0.1, 0.1), ("b", 8.0, 8.0)], "zip string, latitude double, longitude double")
    rows = {(r["k"], r["latitude"]): r["zip"] for r in geo.nearest_join(left, right, "k", "zip").collect()}
    assert rows == {(1, 0.0): "a", (1, 9.0): "b", (2, None): None}


def test_nearest_join_broadcasts_no_large_side(spark, monkeypatch):
    """Left points of a crowd, of a hole and far off, against a brute-force search; many right points stay off the driver."""
    rng = np.random.default_rng(8)
    right = np.vstack([rng.uniform(0, 100, (70_000, 2)), rng.normal(50, 1e-3, (3_000, 2))])
    right = right[(np.abs(right - 20) > 4).any(axis=1)]
    left = np.vstack([rng.uniform(0, 100, (60, 2)), rng.normal(50, 2e-3, (20, 2)), rng.uniform(17, 23, (20, 2)), rng.uniform(-900, 900, (20, 2))])
    make = lambda key, rows: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], f"{key} long, latitude double, longitude double")
    found = geo.nearest_join(make("id", left), make("zip_code", right), "id", "zip_code")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "salt" not in plan
    got = {r.id: r.zip_code for r in found.collect()}
    d = ((left[:, None, :] - right[None, :, :]) ** 2).sum(axis=2)
    assert len(got) == len(left) and all(d[i, z] == pytest.approx(d[i].min(), abs=1e-12) for i, z in got.items())
    monkeypatch.setattr(geo, "BROADCAST_ROWS", 0)
    merged = geo.nearest_join(make("id", left), make("zip_code", right), "id", "zip_code")
    assert "BroadcastHashJoin [px" not in merged._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.zip_code for r in merged.collect()} == got
