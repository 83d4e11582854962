"""Sources, converters and staging relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge import schemas
from ridegauge.catalog.base import query, rounded
from ridegauge.functions import cleaning as fx
from ridegauge.operators import cleaning as op
from ridegauge.operators.keyed import duplicate_keys
from ridegauge.plans.bindings import ADMINISTRATIVE, DENSE_DAILY, RAW_STATIONS, RAW_TRIPS, SYSTEM_DAILY, bind, table
from ridegauge.sources import readers

TS = (
    "coalesce(try_strptime({0}, '%m/%d/%Y %H:%M'), try_strptime({0}, '%Y-%m-%d %H:%M:%S'), "
    "try_strptime({0}, '%Y-%m-%d %H:%M'), try_strptime({0}, '%Y-%m-%dT%H:%M:%S'))"
)
INT = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN CAST({0} AS INT) ELSE {1} END"
LOC = "CASE WHEN regexp_matches({0}, '^[-+]?[0-9]{{1,3}}[.][0-9]*$') THEN CAST({0} AS DOUBLE) ELSE 0 END"
OKTEXT = "coalesce(regexp_matches({0}, '^[A-Za-z]+([ +-][A-Za-z]+)?([ +][A-Za-z]+)?$') AND {0} <> 'null', false)"
INITCAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
TEXT = (
    "CASE WHEN NOT (" + OKTEXT + ") THEN '0' WHEN contains({0}, '-') THEN "
    + INITCAP.replace("{0}", "split_part({0}, '-', 1)") + " || '-' || lower(split_part({0}, '-', 2)) ELSE " + INITCAP + " END"
)
SENTINEL_TS = "TIMESTAMP '1111-11-11 11:11:11'"
CLEAN = f"""raw AS ({RAW_TRIPS}), clean AS (
SELECT * FROM (SELECT {INT.format('trip_id', 1)} AS trip_id, {INT.format('duration', 1111111111)} AS duration_minutes,
  coalesce({TS.format('start_time')}, {SENTINEL_TS}) AS start_time, coalesce({TS.format('end_time')}, {SENTINEL_TS}) AS end_time,
  {INT.format('start_station', 1)} AS start_station, {LOC.format('start_lat')} AS start_lat, {LOC.format('start_lon')} AS start_lon,
  {INT.format('end_station', 1)} AS end_station, {LOC.format('end_lat')} AS end_lat, {LOC.format('end_lon')} AS end_lon,
  {INT.format('bike_id', 1)} AS bike_id, {INT.format('plan_duration', 1111)} AS plan_duration,
  {TEXT.format('trip_route_category')} AS trip_route_category, {TEXT.format('passholder_type')} AS passholder_type,
  {TEXT.format('bike_type')} AS bike_type, source_file, source_year, source_quarter
  FROM raw WHERE coalesce(plan_duration <> '999', true)) t
WHERE passholder_type <> 'Testing' AND NOT (start_lat = 0 OR start_lon = 0 OR end_lat = 0 OR end_lon = 0))"""
CLEAN_STATIONS = f"""raw_st AS ({RAW_STATIONS}), stations AS (SELECT {INT.format('station_id', 1)} AS station_id, station_name,
 coalesce(CAST(try_strptime(go_live_date, '%m/%d/%Y') AS DATE), CAST(try_strptime(go_live_date, '%Y-%m-%d') AS DATE), DATE '1111-11-11') AS go_live_date,
 region, status FROM raw_st WHERE station_name NOT IN ({', '.join(f"'{n}'" for n in ADMINISTRATIVE)}))"""


def raw_trips(spark, sf):
    return bind(spark, sf, RAW_TRIPS)


def trips(spark, sf):
    return op.clean_trips(raw_trips(spark, sf))


def stations(spark, sf):
    return op.clean_stations(bind(spark, sf, RAW_STATIONS), ADMINISTRATIVE)


def flat(df):
    """Coordinates as doubles for comparison."""
    return df.select(*[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


_IDS = ["trip_id", "duration", "start_station", "bike_id", "plan_duration"]


@query(
    "b01_is_integer",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, "
    + ", ".join(f"coalesce(regexp_matches({c}, '^[0-9]+$'), false) AS {c}_ok" for c in _IDS[1:])
    + " FROM raw",
)
def _(spark, sf):
    return raw_trips(spark, sf).select("trip_id", *[fx.is_integer(F.col(c)).alias(f"{c}_ok") for c in _IDS[1:]])


@query(
    "b02_check_ids",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, {INT.format('trip_id', 1)} AS id, {INT.format('start_station', 1)} AS station, "
    f"{INT.format('bike_id', 1)} AS bike, {INT.format('plan_duration', 1111)} AS plan FROM raw",
)
def _(spark, sf):
    return raw_trips(spark, sf).select(
        "trip_id",
        fx.check_id(F.col("trip_id")).alias("id"),
        fx.check_station(F.col("start_station")).alias("station"),
        fx.check_bike(F.col("bike_id")).alias("bike"),
        fx.check_plan_duration(F.col("plan_duration")).alias("plan"),
    )


@query(
    "b03_check_date",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, {TS.format('start_time')} IS NOT NULL AS start_ok, "
    f"coalesce({TS.format('start_time')}, {SENTINEL_TS}) AS start_ts, coalesce({TS.format('end_time')}, {SENTINEL_TS}) AS end_ts FROM raw",
)
def _(spark, sf):
    return raw_trips(spark, sf).select(
        "trip_id",
        fx.is_date(F.col("start_time")).alias("start_ok"),
        fx.check_date(F.col("start_time")).alias("start_ts"),
        fx.check_date(F.col("end_time")).alias("end_ts"),
    )


@query(
    "b04_check_duration",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, {INT.format('duration', 1111111111)} AS minutes, "
    f"CAST({INT.format('duration', 1111111111)} AS BIGINT) * 60 AS interval_seconds FROM raw",
)
def _(spark, sf):
    from_zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return raw_trips(spark, sf).select(
        "trip_id",
        fx.check_duration_minutes(F.col("duration")).alias("minutes"),
        F.unix_timestamp(from_zero + fx.check_duration(F.col("duration"))).alias("interval_seconds"),
    )


@query(
    "b07_impute_bikes",
    f"""WITH raw AS ({RAW_TRIPS}), t AS (SELECT *, {TS.format('start_time')} AS s, {TS.format('end_time')} AS e,
      coalesce(regexp_matches(bike_id, '^[0-9]+$'), false) AS ok FROM raw),
    u AS (SELECT source_year, source_quarter, start_station, bike_type, trip_route_category, CAST(bike_id AS INT) AS bike, count(*) AS n
      FROM t WHERE ok GROUP BY ALL),
    best AS (SELECT source_year, source_quarter, start_station, bike_type, bike, max(n) AS n FROM u GROUP BY ALL),
    cand AS (SELECT *, row_number() OVER (PARTITION BY source_year, source_quarter, start_station, bike_type ORDER BY n DESC, bike) AS r FROM best),
    bad AS (SELECT * FROM t WHERE NOT ok),
    free AS (SELECT b.source_year, b.source_quarter, b.trip_id, c.bike, c.r FROM bad b JOIN cand c
      USING (source_year, source_quarter, start_station, bike_type)
      WHERE b.s IS NOT NULL AND b.e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t g WHERE g.ok AND g.source_year = b.source_year AND g.source_quarter = b.source_quarter
        AND CAST(g.bike_id AS INT) = c.bike AND g.s <= b.e AND g.e >= b.s))
    SELECT source_year, source_quarter, trip_id, min_by(bike, r) AS imputed_bike FROM free GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    typed = (
        raw_trips(spark, sf)
        .withColumn("start_time", fx.parse_timestamp(F.col("start_time")))
        .withColumn("end_time", fx.parse_timestamp(F.col("end_time")))
    )
    return op.impute_bikes(typed, ("source_year", "source_quarter"))


@query(
    "b08_check_lat_lon",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, " + ", ".join(f"{LOC.format(c)} AS {c}" for c in op.COORDINATES) + " FROM raw",
)
def _(spark, sf):
    return raw_trips(spark, sf).select(
        "trip_id", *[fx.check_lat_lon(F.col(c)).cast("double").alias(c) for c in op.COORDINATES]
    )


@query(
    "b10_check_text",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, "
    + ", ".join(f"{OKTEXT.format(c)} AS {c}_ok, {TEXT.format(c)} AS {c}" for c in ("trip_route_category", "passholder_type", "bike_type"))
    + " FROM raw",
)
def _(spark, sf):
    out = []
    for c in ("trip_route_category", "passholder_type", "bike_type"):
        out += [fx.is_text(F.col(c)).alias(f"{c}_ok"), fx.check_text(F.col(c)).alias(c)]
    return raw_trips(spark, sf).select("trip_id", *out)


@query(
    "b11_valid_date",
    f"WITH {CLEAN_STATIONS} SELECT s_suppkey, coalesce(CAST(try_strptime(g, '%m/%d/%Y') AS DATE), DATE '1111-11-11') AS go_live "
    "FROM (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '#N/A' WHEN 1 THEN '2020-03-1x' ELSE CAST(1 + s_suppkey % 12 AS VARCHAR) || '/' || CAST(1 + s_suppkey % 28 AS VARCHAR) || '/2019' END AS g FROM supplier) t",
)
def _(spark, sf):
    text = F.expr(
        "CASE s_suppkey % 7 WHEN 0 THEN '#N/A' WHEN 1 THEN '2020-03-1x' "
        "ELSE (1 + s_suppkey % 12) || '/' || (1 + s_suppkey % 28) || '/2019' END"
    )
    return table(spark, sf, "supplier").select("s_suppkey", fx.valid_date(text).alias("go_live"))


@query(
    "b12_null_to_zero",
    "SELECT event_id, regexp_replace('{\"a\":null,\"p\":' || props || ',\"z\":null,\"y\":1}', ':null,', ':0,', 'g') AS repaired FROM events",
)
def _(spark, sf):
    text = F.concat(F.lit('{"a":null,"p":'), F.col("props"), F.lit(',"z":null,"y":1}'))
    return table(spark, sf, "events").select("event_id", fx.null_to_zero(text).alias("repaired"))


@query(
    "b13_station_names",
    "SELECT s_suppkey, replace(s_name || ' Metro Station', 'Metro Station', '') AS stripped, "
    "split_part(s_name || ', CA', ',', 1) AS first_part FROM supplier",
)
def _(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        fx.strip_suffix(F.concat("s_name", F.lit(" Metro Station")), "Metro Station").alias("stripped"),
        fx.first_part(F.concat("s_name", F.lit(", CA"))).alias("first_part"),
    )


@query(
    "b14_coercion",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, try_cast(nullif(duration, '') AS DOUBLE) AS number, {TS.format('start_time')} AS moment FROM raw",
)
def _(spark, sf):
    return raw_trips(spark, sf).select(
        "trip_id", fx.to_numeric(F.col("duration")).alias("number"), fx.to_datetime(F.col("start_time")).alias("moment")
    )


@query(
    "a07_station_daily",
    f"""WITH raw AS ({RAW_TRIPS}) SELECT CAST({TS.format('start_time')} AS DATE) AS date, trim('  ' || start_station || ' ') AS station_id,
    try_cast(nullif(duration, '') AS DOUBLE) AS target FROM raw""",
)
def _(spark, sf):
    messy = raw_trips(spark, sf).withColumn("start_station", F.concat(F.lit("  "), "start_station", F.lit(" ")))
    return readers.normalise_station_daily(messy, "start_time", "start_station", "duration")


AGG = """agg AS (SELECT 'system_total' AS segment_type, 'all' AS segment_id, CAST(o_orderdate AS DATE) AS bucket_start, count(*) AS trip_count
 FROM orders GROUP BY 3 UNION ALL SELECT 'start_station', CAST(o_custkey AS VARCHAR), CAST(o_orderdate AS DATE), count(*) FROM orders GROUP BY 2, 3)"""


def stored_aggregate(spark, sf):
    orders = table(spark, sf, "orders").withColumn("bucket_start", F.to_date("o_orderdate"))
    total = orders.groupBy("bucket_start").agg(F.count(F.lit(1)).alias("trip_count")).select(
        F.lit("system_total").alias("segment_type"), F.lit("all").alias("segment_id"), "bucket_start", "trip_count"
    )
    per = orders.groupBy(F.col("o_custkey").cast("string").alias("segment_id"), "bucket_start").agg(
        F.count(F.lit(1)).alias("trip_count")
    ).select(F.lit("start_station").alias("segment_type"), "segment_id", "bucket_start", "trip_count")
    return total.unionByName(per)


@query(
    "a08_segment_target",
    f"WITH {AGG} SELECT bucket_start AS date, CAST(trip_count AS DOUBLE) AS target FROM agg WHERE segment_type = 'system_total' AND segment_id = 'all'",
)
def _(spark, sf):
    return readers.segment_target(stored_aggregate(spark, sf), None)


@query("a08_segment_target_fallback", "SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target FROM events GROUP BY 1")
def _(spark, sf):
    trips_like = table(spark, sf, "events").withColumnRenamed("ts", "start_ts_local")
    return readers.segment_target(stored_aggregate(spark, sf), trips_like, segment_id="absent")


@query("a09_daily_counts", "SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target FROM events GROUP BY 1")
def _(spark, sf):
    return readers.daily_counts(table(spark, sf, "events"), "ts")


PANEL_IN = """pin AS (SELECT 'start_station' AS segment_type, o_custkey AS segment_id, CAST(o_orderdate AS DATE) AS bucket_start,
  CAST(o_totalprice AS VARCHAR) AS trip_count, CASE WHEN o_orderstatus = 'P' THEN 'False' ELSE 'True' END AS is_observed, o_orderkey AS seq FROM orders)"""
PANEL_SQL = f"""{PANEL_IN}, dedup AS (SELECT * FROM pin QUALIFY row_number() OVER (PARTITION BY segment_id, bucket_start ORDER BY seq DESC) = 1),
 b AS (SELECT *, min(CASE WHEN is_observed = 'True' THEN bucket_start END) OVER (PARTITION BY segment_id) AS f,
   max(CASE WHEN is_observed = 'True' THEN bucket_start END) OVER (PARTITION BY segment_id) AS l FROM dedup),
 panel AS (SELECT bucket_start AS date, CAST(segment_id AS VARCHAR) AS station_id, CAST(trip_count AS DOUBLE) AS raw_target, is_observed = 'True' AS in_service,
   CASE WHEN is_observed = 'True' THEN CAST(trip_count AS DOUBLE) END AS target, CASE WHEN is_observed = 'True' THEN 0 ELSE 1 END AS missing_period_flag,
   'station_level' AS series_scope FROM b WHERE bucket_start BETWEEN f AND l)"""


def order_panel(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.lit("start_station").alias("segment_type"),
        F.col("o_custkey").alias("segment_id"),
        F.to_date("o_orderdate").alias("bucket_start"),
        F.col("o_totalprice").cast("string").alias("trip_count"),
        F.when(F.col("o_orderstatus") == "P", "False").otherwise("True").alias("is_observed"),
        F.col("o_orderkey").alias("seq"),
    )
    return readers.station_panel(rows, order_col="seq")


@query("a10_station_panel", f"WITH {PANEL_SQL} SELECT * FROM panel")
def _(spark, sf):
    return order_panel(spark, sf)


@query(
    "a11_external_features",
    """SELECT CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS known_price, max_by(o_custkey, o_orderkey) AS event_customer
    FROM orders GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("known_price"),
        F.col("o_custkey").alias("event_customer"),
        "o_orderkey",
    )
    return readers.external_features(rows, order_col="o_orderkey")


@query(
    "a12_filter_dataset",
    f"WITH {AGG} SELECT segment_type, segment_id, bucket_start, trip_count FROM agg WHERE segment_type = 'start_station' AND bucket_start BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def _(spark, sf):
    return readers.filter_dataset(
        stored_aggregate(spark, sf), "start_station", None, "bucket_start", "1996-01-01", "1999-12-31"
    )


@query("a14_observed_daily", f"WITH {PANEL_SQL} SELECT date, station_id, target FROM panel WHERE in_service AND target IS NOT NULL")
def _(spark, sf):
    return readers.observed_daily(order_panel(spark, sf))


@query(
    "a17_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "c01_drop_zero_coords",
    f"WITH raw AS ({RAW_TRIPS}), t AS (SELECT trip_id, " + ", ".join(f"{LOC.format(c)} AS {c}" for c in op.COORDINATES)
    + " FROM raw) SELECT * FROM t EXCEPT ALL SELECT * FROM t WHERE start_lat = 0 OR start_lon = 0 OR end_lat = 0 OR end_lon = 0",
)
def _(spark, sf):
    typed = raw_trips(spark, sf).select("trip_id", *[fx.check_lat_lon(F.col(c)).alias(c) for c in op.COORDINATES])
    return flat(op.drop_zero_coords(typed))


@query(
    "c02_drop_plan",
    f"WITH raw AS ({RAW_TRIPS}) SELECT trip_id, plan_duration FROM raw EXCEPT ALL SELECT trip_id, plan_duration FROM raw WHERE plan_duration = '999'",
)
def _(spark, sf):
    return op.drop_plan(raw_trips(spark, sf)).select("trip_id", "plan_duration")


@query(
    "c03_drop_testing",
    f"WITH raw AS ({RAW_TRIPS}), t AS (SELECT trip_id, {TEXT.format('passholder_type')} AS passholder_type FROM raw) "
    "SELECT * FROM t EXCEPT ALL SELECT * FROM t WHERE passholder_type = 'Testing'",
)
def _(spark, sf):
    typed = raw_trips(spark, sf).select("trip_id", fx.check_text(F.col("passholder_type")).alias("passholder_type"))
    return op.drop_testing(typed)


@query("c04_clean_trips", f"WITH {CLEAN} SELECT * FROM clean")
def _(spark, sf):
    return flat(trips(spark, sf))


@query("c06_clean_stations", f"WITH {CLEAN_STATIONS} SELECT * FROM stations")
def _(spark, sf):
    return stations(spark, sf)


@query(
    "c08_year_trips",
    f"WITH {CLEAN} SELECT trip_id, start_time, source_quarter FROM clean WHERE year(start_time) = 1997",
)
def _(spark, sf):
    clean = trips(spark, sf)
    quarters = [clean.filter(F.col("source_quarter") == q) for q in (1, 2, 3, 4)]
    return op.year_trips(op.union_years(*quarters), 1997).select("trip_id", "start_time", "source_quarter")


PREVIEW_ORDER = ("trip_id", "start_time", "end_time", "duration_minutes", "start_station", "end_station", "bike_id", "source_file")


@query("c09_preview", f"WITH {CLEAN} SELECT * FROM clean ORDER BY {', '.join(PREVIEW_ORDER)} LIMIT 10")
def _(spark, sf):
    return flat(op.preview(trips(spark, sf), 10, PREVIEW_ORDER))


@query(
    "c10_ingestion_log",
    f"""WITH {CLEAN}, r AS (SELECT source_file, count(*) AS record_count_raw, count(*) - count(DISTINCT trip_id) AS duplicates_removed FROM raw GROUP BY 1),
    c AS (SELECT source_file, count(*) AS n, strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS a, strftime(max(start_time), '%Y-%m-%d %H:%M:%S') AS b FROM clean GROUP BY 1)
    SELECT source_file, record_count_raw, coalesce(n, 0) AS record_count_cleaned, a AS min_event_timestamp, b AS max_event_timestamp,
      duplicates_removed, false AS schema_drift_detected, '["{'","'.join(schemas.TRIPS_RAW.names)}"]' AS schema_columns
    FROM r LEFT JOIN c USING (source_file)""",
)
def _(spark, sf):
    return op.ingestion_log(raw_trips(spark, sf), trips(spark, sf), schemas.TRIPS_RAW.names)


@query(
    "c11_trip_fact",
    f"""WITH {CLEAN} SELECT CAST(trip_id AS VARCHAR) AS trip_id, source_file, CAST(duration_minutes AS DOUBLE) AS duration_minutes,
    start_time + INTERVAL 5 HOUR AS start_ts_utc, end_time AS end_ts_local, CAST(start_time AS DATE) AS event_date_local,
    hour(start_time) AS event_hour_local, start_station, bike_id,
    bike_type AS json_bike_type, trip_id AS json_trip_id FROM clean""",
)
def _(spark, sf):
    fact = op.trip_fact(trips(spark, sf), zone="-05:00")
    return fact.select(
        "trip_id", "source_file", "duration_minutes", "start_ts_utc", "end_ts_local", "event_date_local",
        "event_hour_local", "start_station", "bike_id",
        F.get_json_object("raw_record_json", "$.bike_type").alias("json_bike_type"),
        F.get_json_object("raw_record_json", "$.trip_id").cast("int").alias("json_trip_id"),
    )
