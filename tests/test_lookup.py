"""Lookups in a side whose keys repeat, and the marts that use them."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ridegauge.operators import keyed, marts

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1_000, 0])
def test_lookup_is_an_inner_join(spark, most):
    left = [(k, i) for i, k in enumerate([1, 1, 1, 2, 2, 3, 3, 4, None, 9, 9])] + [(1, 0)]
    right = [(1, f"a{i % 200}") for i in range(250)] + [(2, "b"), (2, "b"), (3, None), (7, "c"), (None, "d")]
    df, side = spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right, "k int, name string")
    found = keyed.lookup(df, side, "k", most)
    assert found.columns == ["k", "v", "name"]
    want = Counter((k, v, n) for k, v in left for j, n in right if k is not None and k == j)
    assert Counter(map(tuple, found.collect())) == want


@pytest.mark.parametrize("most", [1_000, 0])
def test_rows_of_one_key_are_made_in_several_tasks(spark, most, monkeypatch):
    """A join that shuffles by the key makes all of them in one."""
    monkeypatch.setattr(keyed, "LOOKUP_REPEATS", 10)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = keyed.deal(spark.range(400).select(F.lit(1).alias("k"), "id"))
        side = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("other"))
        tasks = keyed.lookup(df, side, "k", most).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 40_000 and len(tasks) > 2
    assert max(r["count"] for r in tasks) < 30_000


@pytest.mark.parametrize("name, joins", [("f03_start_detail", 1), ("f05_trip_detail", 2), ("f10_trip_mart", 2)])
def test_station_lookups_come_last_and_read_columns(spark, name, joins):
    """Above the even shares there are the station lookups only: no parts of timestamps, casts of coordinates or class joins for multiplied rows."""
    top, rest = optimized(QUERIES[name](spark, SF)).split("Repartition", 1)
    assert top.count("Join Inner") == joins
    assert "date_format" not in top and "cast(start_lat" not in top and "date_format" in rest


def test_mart_of_repeated_stations_and_classes(spark):
    at = dt.datetime(2020, 5, 17, 8, 9, 10)
    trips = spark.createDataFrame(
        [(i, d, at, at + dt.timedelta(hours=i), a, 1.0, 2.0, b, 3.0, 4.0, "r", "p", 7, "t") for i, (d, a, b) in enumerate([(5, 1, 2), (5, 1, 1), (6, 2, 1), (7, 2, 2), (5, 3, 2), (5, 2, 9), (5, 4, 2)])],
        "trip_id int, duration_minutes int, start_time timestamp_ntz, end_time timestamp_ntz, start_station int, start_lat double, start_lon double, "
        "end_station int, end_lat double, end_lon double, trip_route_category string, passholder_type string, bike_id int, bike_type string",
    )
    places = [(1, "x", 1, "on"), (1, "y", 2, "off"), (1, "y", 2, "off"), (2, "z", 3, "on"), (3, None, 4, None), (None, "n", 5, "on")]
    stations = spark.createDataFrame([(k, r, dt.date(2019, 1, d), s) for k, r, d, s in places], "station_id int, region string, go_live_date date, status string")
    durations = spark.createDataFrame([(5, 1), (6, 4)], "label int, class int")
    classes = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "label int, class int")
    mart = marts.trip_mart(trips, stations, durations, classes)
    assert mart.columns[0] == "start_station" and mart.columns[-1] == "start_station_class" and len(mart.columns) == 28
    label = {5: "long_trip_low_frequency", 6: "very_short_trip_very_high_frequency"}
    traffic = {1: "mid_trafic", 2: "very_low_trafic", 3: "high_trafic"}
    want = Counter(
        (t["trip_id"], label[t["duration_minutes"]], a[1], b[1], dt.date(2019, 1, b[2]), b[3], traffic[t["start_station"]], f"{8 + t['trip_id']:02d}:09:10")
        for t in trips.collect() if t["duration_minutes"] in label and t["start_station"] in traffic
        for a in places if a[0] == t["start_station"] for b in places if b[0] == t["end_station"]
    )
    picked = mart.select("trip_id", "duration_class", "region_start", "region_end", "station_start_date", "status", "start_station_class", "time_end")
    assert Counter(map(tuple, picked.collect())) == want and len(want) > 5
