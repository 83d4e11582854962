"""Raw text extracts to typed facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.functions import cleaning as fx
from ridegauge.operators.keyed import require_columns
from ridegauge.session import cut_lineage

# Rows that exist only for testing or administration.
TEST_PLAN = "999"
TEST_PASSHOLDER = "Testing"
COORDINATES = ("start_lat", "start_lon", "end_lat", "end_lon")


def drop_zero_coords(df: DataFrame) -> DataFrame:
    zero = F.lit(False)
    for name in COORDINATES:
        zero = zero | (F.col(name) == 0)
    return df.filter(~F.coalesce(zero, F.lit(False)))


def drop_plan(df: DataFrame) -> DataFrame:
    """On raw rows: the plan is still text."""
    return df.filter(F.coalesce(F.col("plan_duration") != TEST_PLAN, F.lit(True)))


def drop_testing(df: DataFrame) -> DataFrame:
    """On rows whose passholder already has canonical case."""
    return df.filter(F.coalesce(F.col("passholder_type") != TEST_PASSHOLDER, F.lit(True)))


def clean_trips(raw: DataFrame, imputed_bike: Column | None = None) -> DataFrame:
    """Every converter in one projection over one scan; the three drops become filters of the same stage."""
    carried = [c for c in raw.columns if c.startswith("source_")]
    typed = drop_plan(raw).select(
        fx.check_id(F.col("trip_id")).alias("trip_id"),
        fx.check_duration_minutes(F.col("duration")).alias("duration_minutes"),
        fx.check_date(F.col("start_time")).alias("start_time"),
        fx.check_date(F.col("end_time")).alias("end_time"),
        fx.check_station(F.col("start_station")).alias("start_station"),
        fx.check_lat_lon(F.col("start_lat")).alias("start_lat"),
        fx.check_lat_lon(F.col("start_lon")).alias("start_lon"),
        fx.check_station(F.col("end_station")).alias("end_station"),
        fx.check_lat_lon(F.col("end_lat")).alias("end_lat"),
        fx.check_lat_lon(F.col("end_lon")).alias("end_lon"),
        fx.check_bike(F.col("bike_id"), imputed_bike).alias("bike_id"),
        fx.check_plan_duration(F.col("plan_duration")).alias("plan_duration"),
        fx.check_text(F.col("trip_route_category")).alias("trip_route_category"),
        fx.check_text(F.col("passholder_type")).alias("passholder_type"),
        fx.check_text(F.col("bike_type")).alias("bike_type"),
        *carried,
    )
    return drop_testing(drop_zero_coords(typed))


def clean_stations(raw: DataFrame, administrative: Sequence[str]) -> DataFrame:
    """Typed stations; names in ``administrative`` are places that exist on paper only and go."""
    named = raw.filter(F.coalesce(~F.col("station_name").isin(*administrative), F.lit(True)))
    return named.select(
        fx.check_station(F.col("station_id")).alias("station_id"),
        "station_name",
        fx.valid_date(F.col("go_live_date")).alias("go_live_date"),
        "region",
        "status",
    )


def union_years(*quarters: DataFrame) -> DataFrame:
    out = quarters[0]
    for q in quarters[1:]:
        out = out.unionByName(q)
    return out


def year_trips(trips: DataFrame, year: int, start_col: str = "start_time") -> DataFrame:
    """One year of the single trip table; on a table partitioned by year this prunes partitions."""
    return trips.filter(F.year(start_col) == year)


def preview(df: DataFrame, n: int = 10, order: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def impute_bikes(trips: DataFrame, partition: tuple[str, ...] = ("quarter",)) -> DataFrame:
    """Replacement bike per faulty trip: ``<partition>, trip_id, imputed_bike``.

    Candidates are good bikes of the same partition, station and bike type, ranked by use per route; the first one
    without a trip overlapping the faulty trip wins. ``trips`` needs ``trip_id, start_station, bike_type,
    trip_route_category, bike_id`` (text) and parsed ``start_time, end_time``.

    Most trips settle on an early rank, so ranks are tried in blocks of doubling width and only unsettled trips go on:
    the full trips x candidates product is never built, and no candidate is left out.
    """
    part = list(partition)
    slot = [*part, "start_station", "bike_type"]
    require_columns(trips, ["trip_id", "trip_route_category", "bike_id", "start_time", "end_time", *slot])
    good = trips.filter(fx.is_integer(F.col("bike_id")))
    faulty = trips.filter(~fx.is_integer(F.col("bike_id"))).select("trip_id", *slot, "start_time", "end_time")

    use = good.groupBy(*slot, "trip_route_category", F.col("bike_id").try_cast("int").alias("bike")).agg(
        F.count(F.lit(1)).alias("uses")
    )
    best_use = use.groupBy(*slot, "bike").agg(F.max("uses").alias("uses"))  # one row per bike seen at a station
    order = W.partitionBy(*slot).orderBy(F.col("uses").desc(), "bike")
    ranked = best_use.withColumn("rank", F.row_number().over(order)).select(*slot, "bike", "rank")
    last_rank = best_use.groupBy(*slot).agg(F.count(F.lit(1)).alias("last_rank"))

    days = F.expr("explode(sequence(to_date(start_time), greatest(to_date(start_time), to_date(end_time))))")
    # For one start only the latest end can matter, so a bike-day holds at most one row per second.
    busy = (
        good.filter("start_time IS NOT NULL AND end_time IS NOT NULL")
        .select(*part, F.col("bike_id").try_cast("int").alias("bike"), "start_time", "end_time", days.alias("day"))
        .groupBy(*part, "bike", "day", "start_time")
        .agg(F.max("end_time").alias("end_time"))
    )
    busy = cut_lineage(busy)
    # Without both times no candidate can be shown to be free, so such a trip gets none.
    timed = faulty.filter("start_time IS NOT NULL AND end_time IS NOT NULL")
    unsettled = cut_lineage(timed.join(last_rank, slot))
    settled: list[DataFrame] = []
    low, width = 1, 1
    while not unsettled.isEmpty():
        high = low + width - 1
        pairs = unsettled.join(ranked.filter(F.col("rank").between(low, high)), slot)
        spread = pairs.withColumn("day", days).alias("f")
        same_day = [F.col(f"f.{c}") == F.col(f"b.{c}") for c in [*part, "bike", "day"]]
        overlap = (F.col("b.start_time") <= F.col("f.end_time")) & (F.col("b.end_time") >= F.col("f.start_time"))
        on = overlap
        for eq in same_day:
            on = eq & on
        clash = spread.join(busy.alias("b"), on, "left_semi").select(*part, "trip_id", "rank").distinct()
        free = pairs.join(clash, [*part, "trip_id", "rank"], "left_anti")
        found = cut_lineage(free.groupBy(*part, "trip_id").agg(F.min_by("bike", "rank").alias("imputed_bike")))
        settled.append(found)
        unsettled = cut_lineage(
            unsettled.filter(F.col("last_rank") > high).join(found, [*part, "trip_id"], "left_anti")
        )
        low, width = high + 1, width * 2
    if not settled:
        return faulty.select(*part, "trip_id", F.lit(None).cast("int").alias("imputed_bike"))
    out = settled[0]
    for block in settled[1:]:
        out = out.unionByName(block)
    return out


def ingestion_log(raw: DataFrame, clean: DataFrame, contract: list[str], start_col: str = "start_time") -> DataFrame:
    """One row per source file; drift compares column sets with the contract."""
    data_columns = [c for c in raw.columns if not c.startswith("source_")]
    drift = set(data_columns) != set(contract)
    raw_side = raw.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("record_count_raw"),
        (F.count(F.lit(1)) - F.count_distinct("trip_id")).alias("duplicates_removed"),
    )
    clean_side = clean.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("record_count_cleaned"),
        F.min(start_col).alias("min_event_timestamp"),
        F.max(start_col).alias("max_event_timestamp"),
    )
    return raw_side.join(clean_side, "source_file", "left").select(
        "source_file",
        "record_count_raw",
        F.coalesce("record_count_cleaned", F.lit(0)).alias("record_count_cleaned"),
        F.date_format("min_event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("min_event_timestamp"),
        F.date_format("max_event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("max_event_timestamp"),
        "duplicates_removed",
        F.lit(drift).alias("schema_drift_detected"),
        F.to_json(F.array(*[F.lit(c) for c in data_columns])).alias("schema_columns"),
    )


def trip_fact(clean: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """Typed fact with local and UTC timestamps, event date and hour, and the record itself as JSON."""
    base = [c for c in clean.columns if not c.startswith("source_")]
    local = lambda c: F.col(c).cast("timestamp")
    return clean.select(
        F.col("trip_id").cast("string").alias("trip_id"),
        *[c for c in clean.columns if c.startswith("source_")],
        F.col("duration_minutes").cast("double").alias("duration_minutes"),
        F.to_utc_timestamp(local("start_time"), zone).cast("timestamp_ntz").alias("start_ts_utc"),
        F.to_utc_timestamp(local("end_time"), zone).cast("timestamp_ntz").alias("end_ts_utc"),
        F.col("start_time").alias("start_ts_local"),
        F.col("end_time").alias("end_ts_local"),
        "start_station",
        "end_station",
        *[F.col(c).cast("double").alias(c) for c in COORDINATES],
        "bike_id",
        "plan_duration",
        "trip_route_category",
        "passholder_type",
        "bike_type",
        F.to_date("start_time").alias("event_date_local"),
        F.hour("start_time").alias("event_hour_local"),
        F.to_json(F.struct(*base)).alias("raw_record_json"),
    )
