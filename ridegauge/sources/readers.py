"""Readers with explicit schemas; invalid values become null, never a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ridegauge import schemas
from ridegauge.config import KNOWN_FUTURE_PREFIXES
from ridegauge.functions import cleaning as fx
from ridegauge.operators.keyed import last_per_key, require_columns


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """All quarterly extracts in one scan, every column text; file and quarter come from the file name."""
    name = F.col("_metadata.file_name")
    found = lambda i: F.regexp_extract(name, r"(\d{4}).?[qQ](\d)", i)
    return (
        spark.read.schema(schemas.TRIPS_RAW)
        .option("header", True)
        .csv(path)
        .select(
            *schemas.TRIPS_RAW.names,
            name.alias("source_file"),
            found(1).try_cast("int").alias("source_year"),
            found(2).try_cast("int").alias("source_quarter"),
        )
    )


def read_stations(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schemas.STATIONS_RAW).option("header", header).csv(path)


def read_domain(spark: SparkSession, manifest: dict, name: str, root: str = ".", schema=None) -> DataFrame:
    """One raw domain of a manifest: ``{"domains": [{"name", "path", "pattern"}]}``."""
    entry = next((d for d in manifest["domains"] if d["name"] == name), None)
    if entry is None:
        raise ValueError(f"domain {name!r} is not in the manifest")
    folder = f"{root.rstrip('/')}/{entry['path']}"
    reader = spark.read.option("pathGlobFilter", entry["pattern"])
    if entry["pattern"].lower().endswith(".json"):
        return reader.text(folder, wholetext=True).withColumnRenamed("value", "document")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("header", True).csv(folder)


def read_census(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.CENSUS_RAW).option("header", True).option("quote", '"').csv(path)
    return raw.select(
        fx.thousands_to_int(F.col("zip_code")).alias("zip_code"),
        fx.thousands_to_int(F.col("total_population")).alias("total_population"),
        F.col("median_age").try_cast("double").alias("median_age"),
        fx.thousands_to_int(F.col("total_males")).alias("total_males"),
        fx.thousands_to_int(F.col("total_females")).alias("total_females"),
        fx.thousands_to_int(F.col("total_households")).alias("total_households"),
        F.col("average_household_size").try_cast("double").alias("average_household_size"),
    )


def read_zip_location(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.ZIP_LOCATION_RAW).option("header", True).csv(path)
    return raw.select(
        F.col("zip_code").try_cast("int").alias("zip_code"),
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
    )


def read_zip_land(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.ZIP_LAND_RAW).option("header", True).csv(path)
    return raw.select(
        F.col("zip_code").try_cast("int").alias("zip_code"), F.col("land_area").try_cast("double").alias("land_area")
    )


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, the whole document as text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV (plain or gzip) with text columns, or Parquet, by suffix."""
    bare = path.lower().rstrip("/")
    if bare.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def normalise_station_daily(df: DataFrame, date_col: str, station_col: str, target_col: str) -> DataFrame:
    """``date, station_id, target``; rows that fail coercion stay, with nulls, for the validation step."""
    require_columns(df, [date_col, station_col, target_col])
    return df.select(
        fx.to_datetime(F.col(date_col)).cast("date").alias("date"),
        F.trim(F.col(station_col).cast("string")).alias("station_id"),
        fx.to_numeric(F.col(target_col)).alias("target"),
    )


def load_station_daily(
    spark: SparkSession, path: str, date_col: str = "date", station_col: str = "station_id", target_col: str = "target"
) -> DataFrame:
    return normalise_station_daily(read_table(spark, path), date_col, station_col, target_col)


def segment_target(
    aggregate: DataFrame | None,
    trips: DataFrame | None,
    segment_type: str = "system_total",
    segment_id: str = "all",
    date_col: str = "bucket_start",
    target_col: str = "trip_count",
    start_col: str = "start_ts_local",
) -> DataFrame:
    """Use the stored aggregate when it holds the segment, else count the cleaned trips per day."""
    if aggregate is not None and {"segment_type", "segment_id", date_col, target_col} <= set(aggregate.columns):
        rows = aggregate.filter(
            (F.col("segment_type").cast("string") == segment_type) & (F.col("segment_id").cast("string") == segment_id)
        ).select(
            fx.to_datetime(F.col(date_col)).cast("date").alias("date"), fx.to_numeric(F.col(target_col)).alias("target")
        )
        if not rows.isEmpty():
            return rows
    if trips is None:
        raise ValueError("neither the daily aggregate nor the cleaned trips hold this segment")
    return daily_counts(require_columns(trips, [start_col]), start_col)


def daily_counts(trips: DataFrame, start_col: str) -> DataFrame:
    return trips.groupBy(F.to_date(start_col).alias("date")).agg(F.count(F.lit(1)).cast("double").alias("target"))


def station_panel(
    aggregate: DataFrame,
    segment_type: str = "start_station",
    date_col: str = "bucket_start",
    station_col: str = "segment_id",
    target_col: str = "trip_count",
    in_service_col: str = "is_observed",
    order_col: str | None = None,
) -> DataFrame:
    """Service-bounded station panel: last duplicate wins, rows outside first..last in-service date are dropped."""
    require_columns(aggregate, [date_col, station_col, target_col, in_service_col, "segment_type"])
    seq = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = aggregate.filter(F.col("segment_type").cast("string") == segment_type).select(
        fx.to_datetime(F.col(date_col)).cast("date").alias("date"),
        F.col(station_col).cast("string").alias("station_id"),
        fx.to_numeric(F.col(target_col)).alias("raw_target"),
        F.coalesce(F.lower(F.col(in_service_col).cast("string")) == "true", F.lit(False)).alias("in_service"),
        seq.alias("_seq"),
    )
    rows = last_per_key(rows.filter("date IS NOT NULL AND station_id IS NOT NULL"), ["station_id", "date"], ["_seq"])
    w = W.partitionBy("station_id")
    serving = F.when(F.col("in_service"), F.col("date"))
    return (
        rows.withColumn("_first", F.min(serving).over(w))
        .withColumn("_last", F.max(serving).over(w))
        .filter("date BETWEEN _first AND _last")
        .select(
            "date",
            "station_id",
            "raw_target",
            "in_service",
            F.when(F.col("in_service"), F.col("raw_target")).alias("target"),
            (~F.col("in_service")).cast("int").alias("missing_period_flag"),
            F.lit("station_level").alias("series_scope"),
        )
    )


def observed_daily(panel: DataFrame) -> DataFrame:
    return panel.filter("in_service AND target IS NOT NULL").select("date", "station_id", "target")


def check_known_future_names(columns: list[str], date_col: str = "date", prefixes=KNOWN_FUTURE_PREFIXES) -> list[str]:
    features = [c for c in columns if c != date_col]
    bad = sorted(c for c in features if not c.startswith(tuple(prefixes)))
    if bad:
        raise ValueError(f"external features must start with one of {tuple(prefixes)}: {bad}")
    return features


def external_features(
    df: DataFrame, date_col: str = "date", order_col: str | None = None, prefixes=KNOWN_FUTURE_PREFIXES
) -> DataFrame:
    """Known-future features by date; last duplicate wins."""
    require_columns(df, [date_col])
    seq = F.col(order_col) if order_col else F.monotonically_increasing_id()
    features = check_known_future_names([c for c in df.columns if c != order_col], date_col, prefixes)
    rows = df.select(F.to_date(date_col).alias("date"), *features, seq.alias("_seq"))
    return last_per_key(rows, ["date"], ["_seq"]).drop("_seq")


def filter_dataset(
    df: DataFrame,
    segment_type: str | None = None,
    segment_id: str | None = None,
    time_col: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Segment equality and inclusive dates; an empty result is an error."""
    if segment_type is not None:
        df = require_columns(df, ["segment_type"]).filter(F.col("segment_type").cast("string") == segment_type)
    if segment_id is not None:
        df = require_columns(df, ["segment_id"]).filter(F.col("segment_id").cast("string") == segment_id)
    if time_col and start:
        df = df.filter(F.col(time_col) >= F.lit(start).cast("timestamp_ntz"))
    if time_col and end:
        df = df.filter(F.col(time_col) <= F.lit(end).cast("timestamp_ntz"))
    if df.isEmpty():
        raise ValueError("no rows are left after filtering the dataset")
    return df
