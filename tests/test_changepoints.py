"""Change points against a plain optimal partitioning that tries every last change."""

from __future__ import annotations

import datetime as dt
import math
import random
import time

import pytest

from ridegauge.catalog import series as cs
from ridegauge.operators import changepoints as cp

START = dt.datetime(2024, 1, 1)


def slow(values: list[float | None], least: int = 2) -> list[int]:
    x = [math.log1p(max(v or 0.0, 0.0)) for v in values]
    n = len(x)
    mean = sum(x) / n
    penalty = max(math.log(n) * sum((v - mean) ** 2 for v in x) / n, 1.0)
    s, q = [0.0], [0.0]
    for v in x:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)
    best: list[tuple[float, list[int]] | None] = [(-penalty, [])] + [None] * n
    for t in range(1, n + 1):
        for k in range(t - least + 1):
            if best[k] is not None:
                cost = best[k][0] + penalty + q[t] - q[k] - (s[t] - s[k]) ** 2 / (t - k)
                if best[t] is None or cost < best[t][0] - 1e-12:
                    best[t] = (cost, best[k][1] + ([k] if k else []))
    return best[n][1]


def series(rng: random.Random) -> list[float | None]:
    out: list[float | None] = []
    for _ in range(rng.randint(1, 6)):
        level = rng.choice([0, 2, 10, 60, 300, 3000])
        out += [max(0.0, level * rng.uniform(0.6, 1.4)) for _ in range(rng.randint(1, 50))]
    return [None if rng.random() < 0.03 else v for v in out]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(4)
    found = {f"s{i}": series(rng) for i in range(60)}
    return found | {None: [5.0] * 30 + [500.0] * 30, "flat": [3.0] * 60, "short": [1.0, 900.0] * 10, "minus": [-5.0] * 50}


def frame(spark, many):
    rows = [(k, START + dt.timedelta(days=i), v) for k, values in many.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, timestamp timestamp, value_filled double")


@pytest.mark.parametrize("least,block", [(2, None), (1, None), (7, None), (2, 16)])
def test_change_points_against_all_partitions(spark, many, least, block):
    got: dict = {k: [] for k in many}
    for r in cp.change_points(frame(spark, many), ["series_id"], least=least, block=block).collect():
        got[r["series_id"]].append(r["position"])
        assert r["timestamp"] == START + dt.timedelta(days=r["position"] - 1) and r["label"] == "detected_level_shift"
    want = {k: slow(v, least) if len(v) >= cp.MIN_POINTS else [] for k, v in many.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(map(len, want.values())) > 20 and want[None] == [30] and not want["flat"]


def test_shift_is_the_difference_of_levels(spark):
    r = cp.change_points(frame(spark, {"a": [5.0] * 30 + [500.0] * 30}), ["series_id"]).first()
    assert r["shift"] == pytest.approx(math.log1p(500) - math.log1p(5))


def test_status_and_empty_table(spark, many):
    found = {r["series_id"]: r for r in cp.level_shift_status(frame(spark, many), ["series_id"]).collect()}
    assert found["short"]["level_shift_detection_status"] == "insufficient_history" and found["flat"]["level_shift_detection_status"] == "ok"
    assert cp.change_points(frame(spark, many).limit(0), ["series_id"]).count() == 0


def test_query_against_all_partitions(spark):
    sf = "/root/testdata/sf0.001"
    values: dict = {}
    for r in cs.prepared(spark, sf).select("series_id", "timestamp", "value_filled").collect():
        values.setdefault(r["series_id"], []).append((r["timestamp"], r["value_filled"]))
    got: dict = {k: [] for k in values}
    for r in cs.change_points(spark, sf).collect():
        got[r["series_id"]].append(r["position"])
    # Plain search is quadratic: the shortest series and the front of none.
    for k in sorted(values, key=lambda k: len(values[k]))[:2]:
        assert sorted(got[k]) == slow([v for _, v in sorted(values[k])]), k


def test_poorly_pruned_series_in_time(spark):
    """Level noise prunes few candidates; the work of a position must stay in proportion to them (minutes before)."""
    rng = random.Random(9)
    values = {f"s{i}": [1000 * rng.uniform(0.95, 1.05) for _ in range(2_400)] for i in range(3)}
    df = frame(spark, values).cache()
    df.count()
    began = time.monotonic()
    assert cp.change_points(df, ["series_id"]).count() == 0
    assert time.monotonic() - began < 60
