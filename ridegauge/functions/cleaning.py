"""Text-to-typed converters as column expressions (JVM side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sentinels, patterns and formats that cleaned rows must carry.
BAD_ID = 1
BAD_DURATION = 1111111111
BAD_PLAN = 1111
BAD_TEXT = "0"
BAD_TIMESTAMP = "1111-11-11 11:11:11"
BAD_DATE = "1111-11-11"
INTEGER_PATTERN = "^[0-9]+$"
LOCATION_PATTERN = "^[-+]?[0-9]{1,3}[.][0-9]*$"
TEXT_PATTERN = "^[A-Za-z]+([ +-][A-Za-z]+)?([ +][A-Za-z]+)?$"
TIMESTAMP_FORMATS = ("M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd")


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(INTEGER_PATTERN), F.lit(False))


def _integer_or(c: Column, sentinel: int) -> Column:
    # A digit run too long for INT is not a usable number either, hence the coalesce.
    return F.coalesce(F.when(is_integer(c), c.try_cast("int")), F.lit(sentinel))


def check_id(c: Column) -> Column:
    return _integer_or(c, BAD_ID)


check_station = check_id


def check_bike(c: Column, imputed: Column | None = None) -> Column:
    """Bad bikes become the sentinel; pass ``imputed`` to opt in to the imputed bike instead."""
    good = F.when(is_integer(c), c.try_cast("int"))
    return F.coalesce(good, F.lit(BAD_ID)) if imputed is None else F.coalesce(good, imputed, F.lit(BAD_ID))


def check_plan_duration(c: Column) -> Column:
    return _integer_or(c, BAD_PLAN)


def check_duration_minutes(c: Column) -> Column:
    return _integer_or(c, BAD_DURATION)


def check_duration(c: Column) -> Column:
    """Duration as a day-time interval; rows carry the minutes of :func:`check_duration_minutes`."""
    minutes = check_duration_minutes(c)
    days = F.floor(minutes / F.lit(1440)).cast("int")
    return F.make_dt_interval(days, F.lit(0), minutes - days * F.lit(1440), F.lit(0))


def parse_timestamp(c: Column) -> Column:
    """Dispatch on the shape of the text, so a value is parsed once and only bad values pay for a failed parse."""
    slash, plain, minutes, iso = (F.try_to_timestamp(c, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS)
    parsed = F.when(c.contains("/"), slash).when(c.contains("T"), iso).when(F.length(c) <= 16, minutes).otherwise(plain)
    return parsed.cast("timestamp_ntz")


def is_date(c: Column) -> Column:
    return parse_timestamp(c).isNotNull()


def check_date(c: Column) -> Column:
    return F.coalesce(parse_timestamp(c), F.lit(BAD_TIMESTAMP).cast("timestamp_ntz"))


def parse_day(c: Column) -> Column:
    slash, plain = (F.try_to_timestamp(c, F.lit(fmt)).cast("date") for fmt in DATE_FORMATS)
    return F.when(c.contains("/"), slash).otherwise(plain)


def is_day(c: Column) -> Column:
    return parse_day(c).isNotNull()


def valid_date(c: Column) -> Column:
    return F.coalesce(parse_day(c), F.lit(BAD_DATE).cast("date"))


def is_location(c: Column) -> Column:
    return F.coalesce(c.rlike(LOCATION_PATTERN), F.lit(False))


def check_lat_lon(c: Column) -> Column:
    value = F.when(is_location(c), c.try_cast("decimal(12,8)"))
    return F.coalesce(value, F.lit(0).cast("decimal(12,8)"))


def is_text(c: Column) -> Column:
    return F.coalesce(c.rlike(TEXT_PATTERN) & (c != "null"), F.lit(False))


def check_text(c: Column) -> Column:
    part = lambda i: F.split_part(c, F.lit("-"), F.lit(i))
    hyphened = F.concat(F.initcap(part(1)), F.lit("-"), F.lower(part(2)))
    return F.when(~is_text(c), F.lit(BAD_TEXT)).when(c.contains("-"), hyphened).otherwise(F.initcap(c))


def null_to_zero(c: Column) -> Column:
    return F.regexp_replace(c, ":null,", ":0,")


def strip_suffix(c: Column, suffix: str) -> Column:
    """Drop the first occurrence of a literal."""
    at = F.instr(c, suffix)
    return F.when(
        at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(suffix), F.length(c)))
    ).otherwise(c)


def first_part(c: Column, separator: str = ",") -> Column:
    return F.split_part(c, F.lit(separator), F.lit(1))


def to_numeric(c: Column) -> Column:
    """Invalid text and NaN become null."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_datetime(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("timestamp_ntz"), parse_timestamp(c.cast("string")))


def thousands_to_int(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("int")
