"""Reporting queries over stored forecast and diagnosis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BASELINE_PRIORITY = ("seasonal_naive_7", "seasonal_naive", "naive")
DEFAULT_CATEGORIES = ("busy_stable", "mixed_profile", "sparse_intermittent", "short_history")


def _value(forecasts: DataFrame) -> Column:
    return F.col("point_forecast" if "point_forecast" in forecasts.columns else "prediction")


def _chosen(forecasts: DataFrame, model: str, horizon: int) -> DataFrame:
    return forecasts.filter((F.col("model_name") == model) & (F.col("horizon") == horizon))


def station_chart(observed: DataFrame, forecasts: DataFrame, station: str, model: str, horizon: int, history_days: int = 90) -> DataFrame:
    """Latest observed rows of a station full-outer-joined with one forecast."""
    history = (
        observed.filter(F.col("station_id").cast("string") == station).orderBy(F.col("date").desc()).limit(history_days)
    ).select("date", F.col("target").alias("observed"))
    ahead = _chosen(forecasts, model, horizon).filter(F.col("station_id").cast("string") == station)
    ahead = ahead.select("date", _value(forecasts).alias("forecast"), "lower_80", "upper_80")
    return history.join(ahead, "date", "full_outer").orderBy("date")


def system_chart(forecasts: DataFrame, model: str, horizon: int) -> DataFrame:
    return _chosen(forecasts, model, horizon).select("date", _value(forecasts).alias("forecast"), "lower_80", "upper_80").orderBy("date")


def best_model(comparison: DataFrame) -> DataFrame:
    """Leading model per horizon by scaled error."""
    return comparison.groupBy("horizon").agg(F.min_by("model_name", F.struct("mean_mase", "model_name")).alias("leading_model"))


def ranked_models(comparison: DataFrame) -> DataFrame:
    """Models of a horizon in order of scaled error; a horizon holds a handful of models."""
    ordered = F.array_sort(F.collect_list(F.struct("mean_mase", "model_name")))
    return comparison.groupBy("horizon").agg(F.transform(ordered, lambda m: m["model_name"]).alias("models"))


def candidate_baseline(comparison: DataFrame) -> DataFrame:
    """Preferred baseline per horizon, else the runner-up, else the leader."""
    ranked = ranked_models(comparison)
    lowered = F.transform("models", lambda m: F.lower(m))
    options = [F.get("models", (F.array_position(lowered, name) - 1).cast("int")) for name in BASELINE_PRIORITY]
    picks = [F.when(F.array_contains(lowered, name), o) for name, o in zip(BASELINE_PRIORITY, options)]
    return ranked.select(
        "horizon", F.coalesce(*picks, F.get("models", F.lit(1)), F.get("models", F.lit(0)), F.lit("NA")).alias("baseline")
    )


def decision_table(comparison: DataFrame, primary: str, secondary: str, directional: str) -> DataFrame:
    text = F.when(F.col("horizon") == 7, primary).when(F.col("horizon") == 30, secondary).otherwise(directional)
    return best_model(comparison).select("horizon", "leading_model", text.alias("interpretation")).orderBy("horizon")


def forecast_preview(forecasts: DataFrame, model: str, horizon: int, rows: int = 12, order: Sequence[str] = ("date",)) -> DataFrame:
    keep = [c for c in ("date", "model_name", "horizon", "point_forecast", "prediction", "lower_80", "upper_80") if c in forecasts.columns]
    return _chosen(forecasts, model, horizon).orderBy(*order).limit(rows).select(*keep)


def slice_summary(slices: DataFrame, horizon: int) -> DataFrame:
    return slices.filter(F.col("horizon") == horizon).orderBy("slice_type", "mase", "model_name")


def category_members(forecasts: DataFrame, categories: Sequence[str] = DEFAULT_CATEGORIES) -> DataFrame:
    """``label, station_id`` rows of the named categories, or the first four stations when none occurs."""
    station = F.col("station_id").cast("string").alias("station_id")
    named = forecasts.filter(F.col("station_category").isin(*categories)).select(
        F.col("station_category").alias("label"), station
    ).distinct()
    if not named.isEmpty():
        return named.orderBy("label", "station_id")
    return forecasts.select(F.lit("example_1").alias("label"), station).distinct().orderBy("station_id").limit(4)


def top_label(df: DataFrame, label: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    number = F.col(value).cast("string").try_cast("double")
    return df.groupBy(*keys).agg(F.coalesce(F.max_by(label, F.struct(number, label)), F.lit("NA")).alias("top_label"))


def sum_metric(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    number = F.col(column).cast("string").try_cast("double")
    return df.groupBy(*keys).agg(F.sum(F.coalesce(number, F.lit(0.0))).alias("total"))


def summary_lookup(summary: DataFrame, category: str = "all", station: str | None = None) -> DataFrame:
    rows = summary if category == "all" else summary.filter(F.col("station_category") == category)
    return rows if station is None else rows.filter(F.col("station_id").cast("string") == station)
