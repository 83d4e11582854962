"""Calendar features of a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Season months and codes, Fourier origin.
SEASON_MONTHS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
SEASON_CODE = {"winter": 0, "spring": 1, "summer": 2, "fall": 3}
FOURIER_ORIGIN = "2000-01-01"

# US federal holidays as (month, day) or (month, weekday Monday=0, which); which -1 means last.
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
FLOATING_HOLIDAYS = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))


def season_tag(month: Column) -> Column:
    out = F
    for tag, months in SEASON_MONTHS.items():
        out = out.when(month.isin(*months), F.lit(tag))
    return out.otherwise(F.lit("unknown"))


def season_code(month: Column) -> Column:
    out = F
    for tag, months in SEASON_MONTHS.items():
        out = out.when(month.isin(*months), F.lit(SEASON_CODE[tag]))
    return out.otherwise(F.lit(-1))


def is_us_holiday(date: Column) -> Column:
    """Federal holiday by date rule; a fixed holiday on Saturday or Sunday is also observed on Friday or Monday."""

    def fixed(d: Column) -> Column:
        hit = F.lit(False)
        for month, day in FIXED_HOLIDAYS:
            rule = (F.month(d) == month) & (F.day(d) == day)
            if (month, day) == (6, 19):
                rule = rule & (F.year(d) >= 2021)
            hit = hit | rule
        return hit

    observed = ((F.weekday(date) == 4) & fixed(F.date_add(date, 1))) | (
        (F.weekday(date) == 0) & fixed(F.date_sub(date, 1))
    )
    floating = F.lit(False)
    for month, weekday, which in FLOATING_HOLIDAYS:
        if which > 0:
            nth = F.ceil(F.day(date) / 7) == which
        else:
            nth = F.month(F.date_add(date, 7)) != month
        floating = floating | ((F.month(date) == month) & (F.weekday(date) == weekday) & nth)
    return fixed(date) | observed | floating


def calendar_columns(date: Column) -> dict[str, Column]:
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "week_of_year": F.weekofyear(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "year": F.year(date),
        "day_of_month": F.day(date),
        "day_of_year": F.dayofyear(date),
        "season_tag": season_tag(F.month(date)),
        "season_code": season_code(F.month(date)),
        "is_holiday": is_us_holiday(date).cast("int"),
    }


def fourier_columns(date: Column, period: float, order: int, prefix: str) -> dict[str, Column]:
    day = F.datediff(date, F.lit(FOURIER_ORIGIN).cast("date")).cast("double")
    out: dict[str, Column] = {}
    for k in range(1, order + 1):
        angle = day * F.lit(2 * math.pi * k / period)
        out[f"{prefix}_sin_{k}"] = F.sin(angle)
        out[f"{prefix}_cos_{k}"] = F.cos(angle)
    return out
