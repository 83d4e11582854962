"""Mobility inputs derived from the star-schema tables, as SQL both Spark and the oracle read.

Every binding covers all rows of its tables; dirty text is planted by key arithmetic so that each converter meets it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ridegauge.session import prepare

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

TRIP_BASE = """
SELECT o_orderkey AS k, o_orderdate AS d, CAST(floor(o_totalprice) AS BIGINT) AS p,
       3000 + CAST(floor(o_custkey / 15) AS BIGINT) AS s, 3000 + (o_orderkey * 7 + o_custkey) % 97 AS e
FROM orders
"""

RAW_TRIPS = f"""
SELECT CAST(k + 10 AS STRING) AS trip_id,
       CASE k % 41 WHEN 0 THEN '12.5' WHEN 1 THEN '12a' WHEN 2 THEN '' WHEN 3 THEN NULL
            ELSE CAST(1 + p % 120 AS STRING) END AS duration,
       CASE WHEN k % 53 = 0 THEN 'not a date'
            WHEN k % 2 = 0 THEN CAST(month(d) AS STRING) || '/' || CAST(day(d) AS STRING) || '/' ||
                 CAST(year(d) AS STRING) || ' ' || CAST(p % 22 AS STRING) || ':' || lpad(CAST(p % 60 AS STRING), 2, '0')
            ELSE CAST(year(d) AS STRING) || '-' || lpad(CAST(month(d) AS STRING), 2, '0') || '-' ||
                 lpad(CAST(day(d) AS STRING), 2, '0') || ' ' || lpad(CAST(p % 22 AS STRING), 2, '0') || ':' ||
                 lpad(CAST(p % 60 AS STRING), 2, '0') || ':00' END AS start_time,
       CASE WHEN k % 59 = 0 THEN NULL
            ELSE CAST(year(d) AS STRING) || '-' || lpad(CAST(month(d) AS STRING), 2, '0') || '-' ||
                 lpad(CAST(day(d) AS STRING), 2, '0') || ' ' || lpad(CAST(p % 22 + 1 + p % 2 AS STRING), 2, '0') || ':' ||
                 lpad(CAST(p % 60 AS STRING), 2, '0') || ':00' END AS end_time,
       CASE WHEN k % 61 = 0 THEN 's12' ELSE CAST(s AS STRING) END AS start_station,
       CASE WHEN k % 71 = 0 THEN '0.0' ELSE '34.' || lpad(CAST(s * 37 % 10000 AS STRING), 4, '0') END AS start_lat,
       CASE WHEN k % 73 = 0 THEN '-118' ELSE '-118.' || lpad(CAST(s * 53 % 10000 AS STRING), 4, '0') END AS start_lon,
       CAST(e AS STRING) AS end_station,
       CASE WHEN k % 79 = 0 THEN '' ELSE '34.' || lpad(CAST(e * 37 % 10000 AS STRING), 4, '0') END AS end_lat,
       '-118.' || lpad(CAST(e * 53 % 10000 AS STRING), 4, '0') AS end_lon,
       CASE WHEN k % 89 = 0 THEN 'b' || CAST(k AS STRING) WHEN k % 83 = 0 THEN NULL
            ELSE CAST(6000 + k % 211 AS STRING) END AS bike_id,
       CASE k % 31 WHEN 0 THEN '999' WHEN 1 THEN 'x' WHEN 2 THEN '365' ELSE CAST(1 + k % 30 AS STRING) END AS plan_duration,
       CASE k % 19 WHEN 0 THEN 'round trip' WHEN 1 THEN 'a b c d' WHEN 2 THEN 'null' WHEN 3 THEN NULL
            ELSE 'One Way' END AS trip_route_category,
       CASE k % 17 WHEN 0 THEN 'walk-up' WHEN 1 THEN 'testing' WHEN 2 THEN 'ONE DAY PASS' WHEN 3 THEN 'flex2'
            ELSE 'Monthly Pass' END AS passholder_type,
       CASE k % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'electric' ELSE 'smart' END AS bike_type,
       'trips-' || CAST(year(d) AS STRING) || '-q' || CAST(quarter(d) AS STRING) || '.csv' AS source_file,
       year(d) AS source_year, quarter(d) AS source_quarter
FROM ({TRIP_BASE}) AS base
"""

# Names of the stations that exist for administration only.
ADMINISTRATIVE = ("Virtual Station", "Free Bikes", "Out of Service Area")
RAW_STATIONS = """
SELECT CASE WHEN s_suppkey % 29 = 5 THEN 'n/a' ELSE CAST(3000 + s_suppkey AS STRING) END AS station_id,
       CASE s_suppkey % 37 WHEN 1 THEN 'Virtual Station' WHEN 2 THEN 'Free Bikes'
            WHEN 3 THEN 'Out of Service Area' ELSE s_name END AS station_name,
       CASE s_suppkey % 7 WHEN 0 THEN '#N/A' WHEN 1 THEN '2020-03-1x'
            ELSE CAST(1 + s_suppkey % 12 AS STRING) || '/' || CAST(1 + s_suppkey % 28 AS STRING) || '/2019' END AS go_live_date,
       r_name AS region, CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# The zip side of the geography: one centroid per customer of the account-balance plane.
PLACES = "SELECT c_custkey AS zip_code, c_acctbal / 100 AS latitude, (c_custkey * 7919 % 10007) / 100 AS longitude FROM customer"
SPOTS = """
SELECT o_orderkey AS spot, (o_totalprice - floor(o_totalprice / 100) * 100) AS latitude,
       CAST(o_orderkey * 104729 % 10007 AS DOUBLE) / 100 AS longitude
FROM orders
"""

SYSTEM_DAILY = "SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target FROM orders GROUP BY 1"
SEGMENT_DAILY = """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target
FROM orders GROUP BY 1, 2
"""
DENSE_DAILY = """
SELECT CAST(l_suppkey AS STRING) AS station_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS target
FROM lineitem GROUP BY 1, 2
"""
SPARSE_DAILY = """
SELECT CAST(o_custkey AS STRING) AS station_id, CAST(o_orderdate AS DATE) AS date,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS DOUBLE) AS target
FROM orders GROUP BY 1, 2
"""
EVENT_TRIPS = """
SELECT event_id AS trip_id, ts AS start_time, user_id AS bike_id, event_type AS start_station, value AS duration_minutes
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a binding against the tables of one scale directory."""
    named = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b")
    used = {m.group(2) for m in named.finditer(sql)}
    text = named.sub(r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
