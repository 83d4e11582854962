"""Residual calibration of forecast intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ridegauge.functions.stats import winkler
from ridegauge.operators.keyed import exact_quantiles

QUANTILES = {"residual_q025": 0.025, "residual_q10": 0.10, "residual_q90": 0.90, "residual_q975": 0.975}


def horizon_step(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number the steps of a forecast by date when they are not numbered yet."""
    if "horizon_step" in forecasts.columns:
        return forecasts
    group = [*keys, "model_name", "horizon", *(["fold_id"] if "fold_id" in forecasts.columns else [])]
    return forecasts.withColumn("horizon_step", F.row_number().over(W.partitionBy(*group).orderBy("date")))


def residuals(backtest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = horizon_step(backtest, keys)
    carried = [c for c in ("fit_success", "fallback_triggered", "fallback_reason", "selected_spec") if c in rows.columns]
    p, a = F.col("prediction").cast("double"), F.col("actual").cast("double")
    return rows.select(
        *keys,
        "model_name",
        "fold_id",
        "horizon",
        "horizon_step",
        F.col("date").alias("target_date"),
        p.alias("point_forecast"),
        a.alias("actual"),
        (a - p).alias("residual"),
        F.abs(a - p).alias("abs_error"),
        *carried,
    )


def _pooling_plan(table: DataFrame, min_samples: int) -> DataFrame:
    """For every (model, horizon, step): the smallest step range around it that holds enough residuals.

    Works on counts per step, at most ``horizon`` entries per row, so the data-dependent radius needs no self-join.
    """
    per_step = table.groupBy("model_name", "horizon", "horizon_step").agg(F.count(F.lit(1)).alias("c"))
    one = per_step.groupBy("model_name", "horizon").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon_step", "c"))).alias("counts"),
        F.min("horizon_step").alias("lowest"),
        F.max("horizon_step").alias("highest"),
        F.sum("c").alias("everything"),
        F.array_sort(F.collect_list("horizon_step")).alias("steps"),
    )
    size = F.greatest(F.col("horizon"), F.col("highest"))
    dense = F.transform(F.sequence(F.lit(1), size), lambda k: F.coalesce(F.try_element_at("counts", k), F.lit(0)))
    running = F.aggregate(
        dense,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c)),
    )
    one = one.withColumn("_cum", running).withColumn("horizon_step", F.explode("steps"))
    low = lambda r: F.greatest(F.lit(1), F.col("horizon_step") - r)
    high = lambda r: F.least(size, F.col("horizon_step") + r)
    inside = lambda r: F.get("_cum", high(r)) - F.get("_cum", low(r) - 1)
    radius = F.get(
        F.filter(F.sequence(F.lit(0), F.greatest(F.col("horizon") - 1, F.lit(0))), lambda r: inside(r) >= min_samples),
        F.lit(0),
    )
    planned = one.withColumn("_r", radius)
    return planned.select(
        "model_name",
        "horizon",
        "horizon_step",
        F.when(F.col("_r") == 0, "step_specific")
        .when(F.col("_r") > 0, "pooled_nearby_steps")
        .otherwise("pooled_full_horizon")
        .alias("calibration_method"),
        F.when(F.col("_r").isNull(), F.col("lowest")).otherwise(low(F.col("_r"))).cast("int").alias("source_step_start"),
        F.when(F.col("_r").isNull(), F.col("highest")).otherwise(high(F.col("_r"))).cast("int").alias("source_step_end"),
        F.when(F.col("_r").isNull(), F.col("everything")).otherwise(inside(F.col("_r"))).alias("n_residuals"),
    )


def calibrate(residual_rows: DataFrame, min_samples: int = 24) -> DataFrame:
    """Residual quantiles per model, horizon and step, pooled outward until enough residuals are in."""
    plan = _pooling_plan(residual_rows, min_samples)
    feeds = (
        plan.select(
            "model_name", "horizon", F.col("horizon_step").alias("target_step"),
            F.explode(F.sequence("source_step_start", "source_step_end")).alias("horizon_step"),
        )
        .groupBy("model_name", "horizon", "horizon_step")
        .agg(F.collect_list("target_step").alias("targets"))
    )
    # Equal residuals collapse before a step feeds its neighbours; models x horizons x steps rows are broadcast.
    counted = residual_rows.groupBy("model_name", "horizon", "horizon_step", "residual").agg(F.count(F.lit(1)).alias("c"))
    spread = counted.join(F.broadcast(feeds), ["model_name", "horizon", "horizon_step"]).select(
        "model_name", "horizon", F.explode("targets").alias("horizon_step"), "residual", "c"
    )
    levels = exact_quantiles(spread, ["model_name", "horizon", "horizon_step"], "residual", QUANTILES, weight="c")
    return plan.join(levels.drop("n"), ["model_name", "horizon", "horizon_step"], "left").withColumn(
        "source_horizon", F.col("horizon")
    )


def resolve_calibration(forecasts: DataFrame, calibration: DataFrame) -> DataFrame:
    """Calibration row of each (model, horizon, step): exact, else the nearest lower horizon with the step clamped.

    Looked up once per distinct (model, horizon, step), then attached; both are bounded by models x horizons x steps.
    """
    wanted = forecasts.select("model_name", "horizon", "horizon_step").distinct()
    fields = [
        "calibration_method", "source_horizon", "source_step_start", "source_step_end", "n_residuals", *QUANTILES,
    ]
    per_model = calibration.groupBy("model_name", "horizon").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon_step", F.struct(*fields).alias("v")))).alias("steps"),
        F.max("horizon_step").alias("last_step"),
    )
    book = per_model.groupBy("model_name").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", F.struct("steps", "last_step").alias("v")))).alias("book")
    )
    rows = wanted.join(F.broadcast(book), "model_name", "left")
    horizons = F.map_keys("book")
    lower = F.array_max(F.filter(horizons, lambda h: h <= F.col("horizon")))
    source = F.coalesce(lower, F.array_max(horizons))
    here = F.try_element_at("book", F.col("_source"))
    exact = F.try_element_at(F.try_element_at("book", F.col("horizon"))["steps"], F.col("horizon_step"))
    clamped = F.try_element_at(here["steps"], F.least(F.col("horizon_step"), F.col("_source")))
    rows = rows.withColumn("_source", source)
    rows = rows.withColumn("_exact", exact).withColumn(
        "_proxy", F.coalesce(clamped, F.try_element_at(here["steps"], here["last_step"]))
    )
    pick = lambda f: F.coalesce(F.col("_exact")[f], F.col("_proxy")[f]).alias(f)
    suffix = F.concat(F.col("_proxy.calibration_method"), F.lit("+proxy_from_h"), F.col("_source").cast("string"))
    method = F.when(F.col("_exact").isNotNull(), F.col("_exact.calibration_method")).otherwise(suffix)
    resolved = rows.select(
        "model_name", "horizon", "horizon_step",
        method.alias("calibration_method"),
        F.when(F.col("_exact").isNotNull(), F.col("_exact.source_horizon"))
        .when(F.col("_proxy").isNotNull(), F.col("_source"))
        .alias("source_horizon"),
        *[pick(f) for f in fields if f not in ("calibration_method", "source_horizon")],
    )
    return forecasts.join(F.broadcast(resolved), ["model_name", "horizon", "horizon_step"], "left")


def apply_intervals(forecasts: DataFrame, calibration: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bounds = point + residual quantile; lower bounds are floored at zero."""
    rows = resolve_calibration(horizon_step(forecasts, keys), calibration)
    p = F.col("prediction").cast("double")
    low = lambda q: F.when((p + F.col(q)).isNotNull(), F.greatest(p + F.col(q), F.lit(0.0)))
    return rows.withColumns(
        {
            "point_forecast": p,
            "lower_80": low("residual_q10"),
            "upper_80": p + F.col("residual_q90"),
            "lower_95": low("residual_q025"),
            "upper_95": p + F.col("residual_q975"),
            "interval_calibration_method": F.col("calibration_method"),
            "interval_source_horizon": F.col("source_horizon"),
            "interval_source_step_start": F.col("source_step_start"),
            "interval_source_step_end": F.col("source_step_end"),
            "interval_n_residuals": F.col("n_residuals"),
        }
    ).drop("calibration_method", "source_horizon", "source_step_start", "source_step_end", "n_residuals", *QUANTILES)


def fill_intervals(forecasts: DataFrame, calibration: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model bounds where present, calibrated ones elsewhere."""
    bounds = [c for c in ("lower_80", "upper_80", "lower_95", "upper_95") if c in forecasts.columns]
    kept = forecasts.withColumnsRenamed({c: f"_direct_{c}" for c in bounds})
    out = apply_intervals(kept, calibration, keys)
    return out.withColumns({c: F.coalesce(f"_direct_{c}", c) for c in bounds}).drop(*[f"_direct_{c}" for c in bounds])


def with_quality(df: DataFrame) -> DataFrame:
    a = F.col("actual")
    hit = lambda n: F.coalesce(
        (a >= F.col(f"lower_{n}")) & (a <= F.col(f"upper_{n}")), F.lit(False)
    ).cast("double")
    return df.withColumns(
        {
            "covered_80": hit(80),
            "covered_95": hit(95),
            "width_80": F.col("upper_80") - F.col("lower_80"),
            "width_95": F.col("upper_95") - F.col("lower_95"),
            "winkler_80": winkler(a, F.col("lower_80"), F.col("upper_80"), 0.20),
            "winkler_95": winkler(a, F.col("lower_95"), F.col("upper_95"), 0.05),
        }
    )


def interval_quality(intervalized: DataFrame, by_step: bool = False) -> DataFrame:
    rows = with_quality(intervalized)
    by = ["model_name", "horizon", *(["horizon_step"] if by_step else [])]
    out = [
        F.count(F.lit(1)).alias("n"),
        F.avg("covered_80").alias("coverage_80"),
        F.avg("covered_95").alias("coverage_95"),
        F.avg("width_80").alias("avg_width_80"),
        F.avg("width_95").alias("avg_width_95"),
    ]
    if not by_step:
        out += [F.avg("winkler_80").alias("mean_winkler_80"), F.avg("winkler_95").alias("mean_winkler_95")]
    return rows.groupBy(*by).agg(*out)


def fit_diagnostics(fitted: DataFrame) -> DataFrame:
    columns = [
        c
        for c in (
            "series_id", "model_name", "fold_id", "horizon", "fit_success", "fallback_triggered", "fallback_reason",
            "selected_spec", "aic", "nobs",
        )
        if c in fitted.columns
    ]
    return fitted.select(*columns).distinct()
