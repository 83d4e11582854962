"""Row types of the inputs and the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TRIPS_RAW = _strings(
    "trip_id", "duration", "start_time", "end_time", "start_station", "start_lat", "start_lon",
    "end_station", "end_lat", "end_lon", "bike_id", "plan_duration", "trip_route_category",
    "passholder_type", "bike_type",
)
STATIONS_RAW = _strings("station_id", "station_name", "go_live_date", "region", "status")
CENSUS_RAW = _strings(
    "zip_code", "total_population", "median_age", "total_males", "total_females",
    "total_households", "average_household_size",
)
ZIP_LOCATION_RAW = _strings("zip_code", "latitude", "longitude")
ZIP_LAND_RAW = _strings("zip_code", "land_area")

TRANSIT_ATTRIBUTES = (
    "features array<struct<attributes:struct<Name:string,city:string,state:string,latitude:string,longitude:string>>>"
)
TRANSIT_GEOMETRY = (
    "features array<struct<properties:struct<Name:string,city:string,state:string>,"
    "geometry:struct<coordinates:array<string>>>>"
)

AGGREGATE = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampNTZType()),
        T.StructField("segment_type", T.StringType()),
        T.StructField("segment_id", T.StringType()),
        T.StructField("bucket_end", T.TimestampNTZType()),
        T.StructField("trip_count", T.LongType()),
        T.StructField("distinct_bikes", T.LongType()),
        T.StructField("avg_duration_minutes", T.DoubleType()),
        T.StructField("is_observed", T.BooleanType()),
        T.StructField("missing_period_flag", T.BooleanType()),
    ]
)
