"""Forecast target and features, keyed by series; ``keys`` may be empty only for a frame already on daily grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.functions.calendar import calendar_columns, fourier_columns, is_us_holiday
from ridegauge.operators.keyed import global_rank, last_per_key, per_date, require_columns, with_one_row

Keys = Sequence[str]


def fill_dates(df: DataFrame, keys: Keys, values: Sequence[str]) -> DataFrame:
    """Every calendar day between the first and last date of a series; new days carry nulls."""
    nxt = F.lead("date").over(W.partitionBy(*keys).orderBy("date"))
    last = F.coalesce(F.date_sub("_next", 1), F.col("date"))
    grid = df.withColumn("_next", nxt).withColumn("_slot", F.explode(F.sequence(F.col("date"), last)))
    here = F.col("_slot") == F.col("date")
    return grid.select(*keys, F.col("_slot").alias("date"), *[F.when(here, F.col(v)).alias(v) for v in values])


def complete_target(
    df: DataFrame, keys: Keys, strategy: str = "zero_fill_with_flag", order: Sequence[str] = (), scope: str = "system_level"
) -> DataFrame:
    """Full daily target with a missing flag; the last duplicate wins when ``order`` says what last means."""
    if strategy not in ("zero_fill_with_flag", "keep_na_with_flag"):
        raise ValueError(f"unsupported missing target strategy {strategy!r}")
    if order:
        df = last_per_key(df.select(*keys, "date", "target", *order), [*keys, "date"], order)
    full = fill_dates(df.select(*keys, "date", "target"), keys, ["target"])
    full = full.withColumn("missing_period_flag", F.col("target").isNull().cast("int"))
    if strategy == "zero_fill_with_flag":
        full = full.withColumn("target", F.coalesce("target", F.lit(0.0)))
    return full.withColumn("series_scope", F.lit(scope))


def future_dates(df: DataFrame, keys: Keys, horizon: int) -> DataFrame:
    """The ``horizon`` days after the last date of each series."""
    last = df.groupBy(*keys).agg(F.max("date").alias("_last"))
    days = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))
    return last.select(*keys, F.posexplode(days).alias("_p", "date")).select(
        *keys, "date", (F.col("_p") + 1).alias("horizon_step")
    )


def uncovered_dates(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Modelled dates on which a known-future feature is missing."""
    missing = F.lit(False)
    for name in features:
        missing = missing | F.col(name).isNull()
    return frame.filter(missing).select("date").distinct()


def check_known_future(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    bad = [str(r["date"]) for r in uncovered_dates(frame, features).orderBy("date").limit(3).collect()]
    if bad:
        raise ValueError(f"known-future features are missing on dates including {', '.join(bad)}")
    return frame


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns(F.col("date")))


def holiday_flag(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """US federal rules by default, or a given table with a ``date`` column."""
    if holidays is None:
        return df.withColumn("is_holiday", is_us_holiday(F.col("date")).cast("int"))
    marked = per_date(holidays.select("date").distinct().withColumn("_h", F.lit(1)))
    return df.join(marked, "date", "left").withColumn("is_holiday", F.coalesce("_h", F.lit(0))).drop("_h")


def fourier_features(df: DataFrame, weekly_order: int = 3, yearly_order: int = 3) -> DataFrame:
    date = F.col("date")
    return df.withColumns(
        {**fourier_columns(date, 7.0, weekly_order, "weekly"), **fourier_columns(date, 365.25, yearly_order, "yearly")}
    )


def lag_features(df: DataFrame, keys: Keys, lags: Sequence[int]) -> DataFrame:
    ordered = W.partitionBy(*keys).orderBy("date")
    return df.withColumns({f"lag_{n}": F.lag("target", n).over(ordered) for n in lags})


def _past(df_keys: Keys, window: int, least: int, statistic: Column) -> Column:
    frame = W.partitionBy(*df_keys).orderBy("date").rowsBetween(-window, -1)
    return F.when(F.count("target").over(frame) >= least, statistic.over(frame))


def rolling_features(df: DataFrame, keys: Keys, windows: Sequence[int]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the rows before each row."""
    out: dict[str, Column] = {}
    for w in windows:
        least = max(2, min(w, 7))
        out[f"rolling_mean_{w}"] = _past(keys, w, least, F.avg("target"))
        out[f"rolling_std_{w}"] = _past(keys, w, least, F.stddev_samp("target"))
        out[f"rolling_min_{w}"] = _past(keys, w, least, F.min("target"))
        out[f"rolling_max_{w}"] = _past(keys, w, least, F.max("target"))
    return df.withColumns(out)


def known_future_frame(
    dates: DataFrame, weekly_order: int = 3, yearly_order: int = 3, external: DataFrame | None = None
) -> DataFrame:
    """Calendar, holiday, Fourier and external columns of given dates."""
    known = fourier_features(calendar_features(dates), weekly_order, yearly_order)
    if external is None:
        return known
    names = [c for c in external.columns if c != "date"]
    return check_known_future(known.join(per_date(external), "date", "left"), names)


def system_features(
    target: DataFrame, keys: Keys, lags: Sequence[int], windows: Sequence[int], weekly_order: int = 3,
    yearly_order: int = 3, external: DataFrame | None = None,
) -> DataFrame:
    known = known_future_frame(target, weekly_order, yearly_order, external)
    return rolling_features(lag_features(known, keys, lags), keys, windows)


STATION_FEATURES = [
    "station_id", "station_age_days", "day_of_week", "month", "is_weekend", "is_holiday", "lag_1", "lag_7", "lag_14",
    "rolling_mean_7", "rolling_mean_28", "rolling_std_28",
]


def station_age(panel: DataFrame) -> DataFrame:
    start = F.min(F.when(F.col("in_service"), F.col("date"))).over(W.partitionBy("station_id"))
    return panel.withColumn("station_age_days", F.greatest(F.datediff("date", start), F.lit(0)))


def station_features(panel: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    keys = ["station_id"]
    weekday = F.weekday("date")
    rows = station_age(panel).withColumns(
        {
            "day_of_week": weekday,
            "month": F.month("date"),
            "is_weekend": (weekday >= 5).cast("int"),
            "is_holiday": is_us_holiday(F.col("date")).cast("int"),
        }
    )
    rows = lag_features(rows, keys, (1, 7, 14)).withColumns(
        {
            "rolling_mean_7": _past(keys, 7, 3, F.avg("target")),
            "rolling_mean_28": _past(keys, 28, 7, F.avg("target")),
            "rolling_std_28": _past(keys, 28, 7, F.stddev_samp("target")),
        }
    )
    return attach_slices(rows, slices) if slices is not None else rows


def attach_slices(df: DataFrame, slices: DataFrame) -> DataFrame:
    return df.join(slices, "station_id", "left")


def training_rows(features: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    rows = features.filter("in_service AND target IS NOT NULL")
    return rows.na.drop(subset=list(columns)) if columns else rows


def feature_roles(df: DataFrame) -> dict[str, list[str]]:
    """Column names by role, read from the schema."""
    excluded = {"date", "target", "missing_period_flag", "series_scope", "season_tag"}
    names = [c for c in df.columns if c not in excluded]
    lag_like = [c for c in names if c.startswith(("lag_", "rolling_"))]
    numeric = [f.name for f in df.schema.fields if f.name in names and f.dataType.simpleString().split("(")[0] in
               ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal", "boolean")]
    return {"known_future": [c for c in names if c not in lag_like], "lag_like": lag_like, "numeric": numeric}


def future_station_rows(history: DataFrame, horizon: int = 1) -> DataFrame:
    """Feature rows of the first ``horizon`` unseen days: lags by date, rolling over previous calendar days.

    One grouped pass serves all days, since each row of the last 28 days adds to fixed conditional sums.
    """
    ends = history.agg(F.max("date").alias("d")).scalar()
    rows = history.withColumn("_end", ends)
    per = rows.groupBy("station_id", "_end").agg(
        F.min(F.when(F.col("in_service"), F.col("date"))).alias("_start"),
        F.map_from_entries(
            F.collect_list(
                F.when(
                    (F.col("date") > F.date_sub("_end", 28)) & F.col("target").isNotNull(),
                    F.struct("date", "target"),
                )
            )
        ).alias("_recent"),
    )
    day = per.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    day = day.withColumn("date", F.date_add("_end", F.col("horizon_step")))
    back = lambda n: F.try_element_at("_recent", F.date_sub("date", n))
    window = lambda n: F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at("_recent", F.date_sub(F.col("date"), i))),
        lambda v: v.isNotNull(),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def mean(n: int, least: int) -> Column:
        vals = window(n)
        return F.when(F.size(vals) >= least, total(vals) / F.size(vals))

    def std(n: int, least: int) -> Column:
        vals = window(n)
        centre = total(vals) / F.size(vals)
        squares = total(F.transform(vals, lambda v: (v - centre) * (v - centre)))
        return F.when(F.size(vals) >= least, F.sqrt(squares / (F.size(vals) - 1)))

    weekday = F.weekday("date")
    return day.select(
        "station_id",
        "date",
        "horizon_step",
        F.greatest(F.coalesce(F.datediff("date", "_start"), F.lit(0)), F.lit(0)).alias("station_age_days"),
        weekday.alias("day_of_week"),
        F.month("date").alias("month"),
        (weekday >= 5).cast("int").alias("is_weekend"),
        is_us_holiday(F.col("date")).cast("int").alias("is_holiday"),
        back(1).alias("lag_1"),
        back(7).alias("lag_7"),
        back(14).alias("lag_14"),
        mean(7, 3).alias("rolling_mean_7"),
        mean(28, 7).alias("rolling_mean_28"),
        std(28, 7).alias("rolling_std_28"),
    )


def category_map(df: DataFrame, column: str) -> DataFrame:
    """``value, code`` with codes 1..n in sorted order; null counts as ``unknown``."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).distinct()
    return global_rank(values, ["value"], "code")


def encode(df: DataFrame, column: str, mapping: DataFrame, name: str | None = None) -> DataFrame:
    """Codes from a stored map; unseen values become 0."""
    name = name or f"{column}_code"
    side = mapping.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    keyed = df.withColumn("_value", F.coalesce(F.col(column).cast("string"), F.lit("unknown")))
    return keyed.join(side, "_value", "left").withColumn(name, F.coalesce("_code", F.lit(0)).cast("int")).drop("_value", "_code")


def prepare_exog(train: DataFrame, future: DataFrame, columns: Sequence[str], limit: float = 0.98):
    """Drop constant columns, standardise continuous ones by training moments, drop the later of two collinear ones.

    Two aggregates decide: per-column moments, then pairwise correlations. Only p and p x p numbers reach the driver.
    """
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stats = filled.agg(
        *[F.approx_count_distinct(c, 0.01).alias(f"{c}__k") for c in columns],
        *[F.min(c).alias(f"{c}__lo") for c in columns],
        *[F.max(c).alias(f"{c}__hi") for c in columns],
        *[F.avg(c).alias(f"{c}__m") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__s") for c in columns],
    ).collect()[0]
    varying = [c for c in columns if stats[f"{c}__lo"] != stats[f"{c}__hi"]]
    if not varying:
        return train.select(), future.select(), []
    pairs = [(a, b) for i, b in enumerate(varying) for a in varying[:i]]
    dropped: set[str] = set()
    if pairs:
        corr = filled.agg(*[F.abs(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect()[0]
        dropped = {b for i, (_, b) in enumerate(pairs) if (corr[f"c{i}"] or 0.0) > limit}
    used = [c for c in varying if c not in dropped]

    def scaled(df: DataFrame) -> DataFrame:
        present = set(df.columns)
        raw = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0) for c in used}
        return df.withColumns(
            {c: (v - stats[f"{c}__m"]) / stats[f"{c}__s"] if stats[f"{c}__k"] > 2 else v for c, v in raw.items()}
        )

    return scaled(train), scaled(future), used


def cap_history(df: DataFrame, keys: Keys, rows: int = 1095) -> DataFrame:
    latest = W.partitionBy(*keys).orderBy(F.col("date").desc())
    return df.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= rows).drop("_r")


SCALED_COLUMNS = ("target", "lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_mean_28", "rolling_std_28")


def station_scale(train: DataFrame) -> DataFrame:
    return train.filter("target IS NOT NULL").groupBy("station_id").agg(
        F.greatest(F.avg(F.abs("target")), F.lit(1.0)).alias("scale")
    )


def apply_station_scale(df: DataFrame, scales: DataFrame, columns: Sequence[str] = SCALED_COLUMNS) -> DataFrame:
    joined = df.join(scales, "station_id", "left")
    by = F.coalesce("scale", F.lit(1.0))
    return joined.withColumns({c: F.col(c) / by for c in columns if c in df.columns}).drop("scale")


def standardization(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a zero or missing deviation becomes 1."""
    row = df.agg(
        *[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]
    ).collect()[0]
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 1.0) for c in columns}


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    require_columns(df, list(stats))
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in stats.items()})


def time_split(df: DataFrame, horizon: int) -> DataFrame:
    """Adds ``role``: the last ``horizon`` days validate, and everything trains when either side would be empty."""
    cut = F.date_sub(F.col("_b"), horizon)
    tagged = with_one_row(df, df.agg(F.min("date").alias("_a"), F.max("date").alias("_b")))
    role = F.when((F.col("_a") > cut) | (F.col("date") <= cut), "train").otherwise("valid")
    return tagged.withColumn("role", role).drop("_a", "_b")
