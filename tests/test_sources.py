"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ridegauge import schemas
from ridegauge.functions import cleaning as fx
from ridegauge.operators import cleaning as op, geo
from ridegauge.plans.station import slice_lookup
from ridegauge.sources import readers, sinks

HEADER = ",".join(schemas.TRIPS_RAW.names)
ROW = "7,12,7/7/2016 4:17,2016-07-07 04:29:00,3014,34.05,-118.23,3014,34.05,-118.23,6281,30,round trip,monthly pass,standard"


def test_trip_scan(spark, tmp_path):
    (tmp_path / "trips-2019-q1.csv").write_text(f"{HEADER}\n{ROW}\n")
    (tmp_path / "trips-2020-q4.csv").write_text(f"{HEADER}\n{ROW.replace('7,12', '8,999', 1)}\n{ROW.replace(',30,', ',999,')}\n")
    raw = readers.read_trips(spark, str(tmp_path / "*.csv"))
    assert {(r.source_year, r.source_quarter) for r in raw.collect()} == {(2019, 1), (2020, 4)}
    clean = {r.trip_id: r for r in op.clean_trips(raw).collect()}
    assert set(clean) == {7, 8}
    assert clean[7].start_time == dt.datetime(2016, 7, 7, 4, 17) and clean[7].passholder_type == "Monthly Pass"


def test_station_snapshot(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("3000,Virtual Station,7/7/2016,N/A,Active\n3005,7th & Flower,7/7/2016,DTLA,Active\n3006,Olive,#N/A,DTLA,Active\n")
    rows = {r.station_id: r for r in op.clean_stations(readers.read_stations(spark, str(path)), ("Virtual Station",)).collect()}
    assert set(rows) == {3005, 3006}
    assert rows[3005].go_live_date == dt.date(2016, 7, 7) and rows[3006].go_live_date == dt.date(1111, 11, 11)


def test_manifest_domain(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("x\n1\n")
    (tmp_path / "raw" / "b.txt").write_text("x\n2\n")
    manifest = {"domains": [{"name": "d", "path": "raw", "pattern": "*.csv"}]}
    assert [r.x for r in readers.read_domain(spark, manifest, "d", str(tmp_path)).collect()] == ["1"]
    with pytest.raises(ValueError):
        readers.read_domain(spark, manifest, "nope", str(tmp_path))


def test_census_and_zip_files(spark, tmp_path):
    census = tmp_path / "census.csv"
    census.write_text('Zip,Pop,Age,M,F,H,S\n91371,"1,234",73.5,0,1,1,1.5\n')
    row = readers.read_census(spark, str(census)).collect()[0]
    assert (row.zip_code, row.total_population, row.median_age) == (91371, 1234, 73.5)
    zips = tmp_path / "zip.csv"
    zips.write_text("zip,lat,lon\n90001,33.97,-118.25\n")
    assert readers.read_zip_location(spark, str(zips)).collect()[0].latitude == 33.97
    land = tmp_path / "land.csv"
    land.write_text("zip,area\n90001,3.5\n")
    assert readers.read_zip_land(spark, str(land)).collect()[0].land_area == 3.5


def test_transit_document(spark, tmp_path):
    path = tmp_path / "metro.json"
    path.write_text(json.dumps({"features": [{"attributes": {"Name": "Pershing Metro Station", "city": "LA", "latitude": 34.05, "longitude": -118.25}}]}))
    rows = geo.transit_rows(geo.explode_features(readers.read_json_document(spark, str(path)), "attributes"), "metro_station", "California")
    row = rows.collect()[0]
    assert (row.station_name, row.latitude, row.state) == ("Pershing ", 34.05, "California")


@pytest.mark.parametrize("suffix", ["parquet", "csv", "csv.gz"])
def test_station_daily_by_suffix(spark, tmp_path, suffix):
    path = str(tmp_path / f"daily.{suffix}")
    source = spark.createDataFrame([("2024-01-01", " A ", "3"), ("bad", "B", "x")], "d string, s string, t string")
    sinks.write_table(source, path)
    rows = readers.load_station_daily(spark, path, "d", "s", "t").orderBy("station_id").collect()
    assert [(r.date, r.station_id, r.target) for r in rows] == [(dt.date(2024, 1, 1), "A", 3.0), (None, "B", None)]


def test_summary_sinks(spark, tmp_path):
    df = spark.range(1).select(F.lit(1).alias("n"), F.array(F.lit(7), F.lit(30)).alias("periods"))
    flat = sinks.write_summary(df, str(tmp_path / "s.csv"))
    assert readers.read_table(spark, flat).collect()[0].periods == "[7,30]"
    nested = sinks.write_summary(df, str(tmp_path / "s.json"))
    assert spark.read.json(nested).collect()[0].periods == [7, 30]


def test_stored_table_is_reused(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "calibration.parquet")
    assert sinks.stored_or_computed(spark, path, compute).count() == 3
    assert sinks.stored_or_computed(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_stored_slices_last_row_wins(spark):
    stored = spark.createDataFrame([("A", "young", 1), ("A", "mature", 2)], "station_id string, history_group string, seq int")
    rows = slice_lookup(None, stored, order="seq").collect()
    assert [(r.station_id, r.history_group) for r in rows] == [("A", "mature")]


def test_empty_filter_is_an_error(spark):
    df = spark.createDataFrame([("system_total", "all")], "segment_type string, segment_id string")
    with pytest.raises(ValueError):
        readers.filter_dataset(df, "start_station")


def test_external_prefixes():
    with pytest.raises(ValueError):
        readers.check_known_future_names(["date", "rain"])
    assert readers.check_known_future_names(["date", "known_rain"]) == ["known_rain"]


@pytest.mark.parametrize(
    "text,want",
    [("round trip", "Round Trip"), ("walk-up", "Walk-up"), ("One Day Pass", "One Day Pass"), ("a b c d", "0"), ("null", "0"), (None, "0")],
)
def test_check_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(fx.check_text(F.col("c"))).collect()[0][0] == want
