"""Rolling-origin backtests where fold, horizon and model are columns of one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.config import BacktestConfig, StationForecastConfig
from ridegauge.functions.stats import clip0

Keys = Sequence[str]


def _fold_array(horizon: int, config: BacktestConfig) -> Column:
    """Folds of a series with ``_n`` rows: the last ``max_folds`` cut points, renumbered from 1."""
    possible = F.floor((F.col("_n") - horizon - config.initial_train_size) / config.step_size) + 1
    possible = F.when(F.col("_n") >= config.initial_train_size + horizon, possible).otherwise(F.lit(0)).cast("int")
    kept = F.least(possible, F.lit(config.max_folds))
    folds = F.transform(
        F.sequence(F.lit(1), F.greatest(kept, F.lit(1))),
        lambda j: F.struct(
            F.lit(horizon).alias("horizon"),
            j.alias("fold_id"),
            (F.lit(config.initial_train_size) + (possible - kept + j - 1) * config.step_size).alias("cut"),
        ),
    )
    return F.when(kept > 0, folds).otherwise(F.slice(folds, 1, 0))


def _indexed(series: DataFrame, keys: Keys) -> DataFrame:
    part = W.partitionBy(*keys)
    return series.withColumn("_i", F.row_number().over(part.orderBy("date")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(part)
    )


def rolling_windows(series: DataFrame, keys: Keys, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Fold table: ``fold_id, horizon, train_start, train_end, test_start, test_end`` per series."""
    rows = _indexed(series.select(*keys, "date"), keys).withColumn(
        "_start", F.min("date").over(W.partitionBy(*keys))
    )
    folds = F.concat(*[_fold_array(h, config) for h in config.horizons])
    edges = F.filter(
        folds,
        lambda f: (F.col("_i") == f["cut"] - 1) | (F.col("_i") == f["cut"]) | (F.col("_i") == f["cut"] + f["horizon"] - 1),
    )
    hit = rows.withColumn("_f", F.explode(edges))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("date")))
    return hit.groupBy(*keys, F.col("_f.fold_id").alias("fold_id"), F.col("_f.horizon").alias("horizon")).agg(
        F.max("_start").alias("train_start"),
        at(F.col("_f.cut") - 1).alias("train_end"),
        at(F.col("_f.cut")).alias("test_start"),
        at(F.col("_f.cut") + F.col("_f.horizon") - 1).alias("test_end"),
        F.max("_f.cut").alias("train_rows"),
    )


def running_scale(df: DataFrame, keys: Keys, season: int, order: str = "date", value: str = "target") -> DataFrame:
    """Adds ``mase_scale``: the seasonal-naive scale of the history up to and including each row.

    Running sums replace one pass per fold: the scale of any training window is read at its last row.
    """
    known = F.col(value).isNotNull()
    usable = W.partitionBy(*keys, known).orderBy(order)
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_ds", F.when(known, F.abs(F.col(value) - F.lag(value, max(season, 1)).over(usable))))
    rows = rows.withColumn("_d1", F.when(known, F.abs(F.col(value) - F.lag(value, 1).over(usable))))
    n = F.count(value).over(so_far)
    raw = F.when(n > season, F.avg("_ds").over(so_far)).otherwise(F.avg("_d1").over(so_far))
    return rows.withColumn("mase_scale", F.coalesce(F.when(raw > 0, raw), F.lit(1.0))).drop("_ds", "_d1")


def mase_scale(df: DataFrame, keys: Keys, season: int, value: str = "target", order: str = "date") -> DataFrame:
    """Scale over whole series, one row per series."""
    scaled = running_scale(df, keys, season, order, value)
    return scaled.groupBy(*keys).agg(F.max_by("mase_scale", order).alias("mase_scale"))


def seasonal_naive_value(keys: Keys, period: int, max_step: int, config: BacktestConfig | None = None) -> Column:
    """Seasonal naive at a row ``_step`` rows after the cut ``_cut``: the value a whole number of seasons back.

    With less than a season of history the season is the history, which only concerns the first few cut points.
    """
    ordered = W.partitionBy(*keys).orderBy("date")
    back = lambda season: {
        m: F.lag("target", m * season).over(ordered) for m in range(1, -(-max_step // season) + 1)
    }
    entries: list[Column] = []
    seasons = [period]
    if config is not None:
        seasons += [c for c in range(config.initial_train_size, period, config.step_size) if c > 0]
    for season in seasons:
        for m, value in back(season).items():
            entries.append(F.struct(F.lit(season).alias("season"), F.lit(m).alias("m"), value.alias("value")))
    return F.array(*entries)


def _pick(entries: str, period: int) -> Column:
    season = F.least(F.lit(period), F.col("_cut"))
    m = F.ceil(F.col("horizon_step") / season)
    found = F.filter(entries, lambda e: (e["season"] == season) & (e["m"] == m))
    return F.get(found, F.lit(0))["value"]


def baseline_backtest(series: DataFrame, keys: Keys, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Naive and seasonal-naive forecasts with actuals and scale for every fold, horizon and step.

    No training window is copied: lags and running sums are read at the fold's last training row, and each row joins the
    few folds it is tested in by expression. The whole plan shuffles once, by series.
    """
    keys = list(keys)
    longest = max(config.horizons)
    rows = running_scale(_indexed(series, keys), keys, config.season)
    rows = rows.withColumns(
        {f"_s{p}": seasonal_naive_value(keys, p, longest, config) for p in config.seasonal_naive_periods}
    )
    folds = F.concat(*[_fold_array(h, config) for h in config.horizons])
    member = F.filter(folds, lambda f: (F.col("_i") >= f["cut"] - 1) & (F.col("_i") < f["cut"] + f["horizon"]))
    tested = rows.withColumn("_f", F.explode(member)).withColumns(
        {
            "fold_id": F.col("_f.fold_id"),
            "horizon": F.col("_f.horizon"),
            "_cut": F.col("_f.cut"),
            "horizon_step": (F.col("_i") - F.col("_f.cut") + 1).cast("int"),
        }
    )
    fold = W.partitionBy(*keys, "horizon", "fold_id")
    origin = F.max(
        F.when(F.col("horizon_step") == 0, F.struct("date", "target", "mase_scale"))
    ).over(fold)
    tested = tested.withColumn("_o", origin).filter("horizon_step > 0")
    models = [F.struct(F.lit("naive").alias("model_name"), clip0(F.col("_o.target")).alias("prediction"))]
    models += [
        F.struct(F.lit(f"seasonal_naive_{p}").alias("model_name"), clip0(_pick(f"_s{p}", p)).alias("prediction"))
        for p in config.seasonal_naive_periods
    ]
    return tested.select(
        *keys,
        "fold_id",
        "horizon",
        "horizon_step",
        "date",
        F.col("_o.date").alias("train_end"),
        F.col("target").alias("actual"),
        F.col("_o.mase_scale").alias("mase_scale"),
        F.inline(F.array(*models)),
    )


def baseline_forecast(series: DataFrame, keys: Keys, horizon: int, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Naive and seasonal-naive forecasts of the days after each series; a short history is its own season."""
    keys = list(keys)
    latest = W.partitionBy(*keys).orderBy(F.col("date").desc())
    ends = series.select(*keys, "date", "target").withColumn("_r", F.row_number().over(latest))
    tail = ends.filter(F.col("_r") <= max(periods)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("date", "target"))).alias("_t")
    )
    last = F.element_at("_t", -1)
    steps = tail.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    models = [F.struct(F.lit("naive").alias("model_name"), clip0(last["target"]).alias("prediction"))]
    for p in periods:
        season = F.least(F.lit(p), F.size("_t"))
        slot = F.size("_t") - season + F.pmod(F.col("horizon_step") - 1, season)
        models.append(
            F.struct(
                F.lit(f"seasonal_naive_{p}").alias("model_name"), clip0(F.get("_t", slot)["target"]).alias("prediction")
            )
        )
    return steps.select(
        *keys, F.date_add(last["date"], F.col("horizon_step")).alias("date"), "horizon_step", F.inline(F.array(*models))
    )


# ---- station panel ---------------------------------------------------------------------------------------------------


def panel_folds(panel: DataFrame, config: StationForecastConfig = StationForecastConfig()) -> DataFrame:
    """One row: ``folds`` as an array of (fold_id, train_end, test_end), the same for all stations.

    The distinct dates of the panel are at most one per day of history.
    """
    h, first = max(config.horizons), config.initial_train_size
    dates = panel.filter("in_service AND date IS NOT NULL").select("date").distinct()
    listed = dates.agg(F.array_sort(F.collect_list("date")).alias("d")).withColumn("_n", F.size("d"))
    possible = F.when(
        F.col("_n") > first + h, F.floor((F.col("_n") - h - first) / config.step_size) + 1
    ).otherwise(F.lit(0)).cast("int")
    kept = F.least(possible, F.lit(config.max_folds))
    end = lambda j: F.get(F.col("d"), F.lit(first - 1) + (possible - kept + j - 1) * config.step_size)
    folds = F.transform(
        F.sequence(F.lit(1), F.greatest(kept, F.lit(1))),
        lambda j: F.struct(j.alias("fold_id"), end(j).alias("train_end"), F.date_add(end(j), h).alias("test_end")),
    )
    return listed.select(F.when(kept > 0, folds).otherwise(F.slice(folds, 1, 0)).alias("folds"))


def panel_windows(panel: DataFrame, config: StationForecastConfig = StationForecastConfig()) -> DataFrame:
    return panel_folds(panel, config).select(F.inline("folds"))


def production_folds(panel: DataFrame) -> DataFrame:
    """A single pseudo-fold whose history is the whole panel."""
    last = panel.agg(F.max("date").alias("d"))
    fold = F.struct(F.lit(0).alias("fold_id"), F.col("d").alias("train_end"), F.lit(None).cast("date").alias("test_end"))
    return last.select(F.array(fold).alias("folds"))


def station_origins(
    panel: DataFrame, config: StationForecastConfig = StationForecastConfig(), folds: DataFrame | None = None
) -> DataFrame:
    """Per station and fold: last observed value, the seven slots before the cut, scale of the observed history.

    Every row meets at most ``max_folds`` folds through the array, and all of it is one grouped pass per station.
    """
    rows = panel.withColumn("_folds", (panel_folds(panel, config) if folds is None else folds).scalar())
    rows = running_scale(rows.withColumn("_t", F.when(F.col("in_service"), F.col("target"))), ["station_id"], config.season, value="_t")
    rows = rows.withColumn("_f", F.explode(F.filter("_folds", lambda f: F.col("date") <= f["train_end"])))
    end = F.col("_f.train_end")
    slots = [
        F.max(F.when(F.col("date") == F.date_sub(end, 7 - j), F.col("target"))).alias(f"_slot{j}") for j in range(1, 8)
    ]
    return rows.groupBy(
        "station_id", F.col("_f.fold_id").alias("fold_id"), F.col("_f.train_end").alias("train_end")
    ).agg(
        F.max_by("target", F.when(F.col("target").isNotNull(), F.col("date"))).alias("last_value"),
        F.max_by("mase_scale", F.when(F.col("in_service"), F.col("date"))).alias("mase_scale"),
        *slots,
    )


def station_baselines(origins: DataFrame, horizon: int) -> DataFrame:
    """Station naive and seasonal naive 7 from origin rows (``last_value`` and ``_slot1.._slot7``).

    A missing slot takes the step before it, seeded with the last observed value; then the week repeats.
    """
    filled: list[Column] = []
    carry = F.coalesce("last_value", F.lit(0.0))
    for j in range(1, 8):
        carry = F.coalesce(F.col(f"_slot{j}"), carry)
        filled.append(F.greatest(carry, F.lit(0.0)))
    week = origins.withColumn("_week", F.array(*filled)).drop(*[f"_slot{j}" for j in range(1, 8)])
    steps = week.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    naive = F.greatest(F.coalesce("last_value", F.lit(0.0)), F.lit(0.0))
    seasonal = F.get("_week", F.pmod(F.col("horizon_step") - 1, F.lit(7)))
    return steps.withColumn("date", F.date_add("train_end", F.col("horizon_step"))).select(
        *[c for c in origins.columns if not c.startswith("_slot") and c != "last_value"],
        "horizon_step",
        "date",
        F.inline(
            F.array(
                F.struct(
                    F.lit("naive").alias("model_name"), F.lit("baseline_rule").alias("implementation"),
                    naive.alias("prediction"),
                ),
                F.struct(
                    F.lit("seasonal_naive_7").alias("model_name"), F.lit("seasonal_rule").alias("implementation"),
                    seasonal.alias("prediction"),
                ),
            )
        ),
    )


def station_backtest(panel: DataFrame, config: StationForecastConfig = StationForecastConfig()) -> DataFrame:
    """Scored station baselines over all folds; only days with an observed actual count."""
    forecasts = station_baselines(station_origins(panel, config), max(config.horizons))
    actuals = panel.filter("in_service AND target IS NOT NULL").select("station_id", "date", F.col("target").alias("actual"))
    return forecasts.join(actuals, ["station_id", "date"])


# ---- metrics ---------------------------------------------------------------------------------------------------------


def score(forecasts: DataFrame, actuals: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Attach actuals by (series, date)."""
    right = actuals.select(*keys, "date", F.col("target").alias("actual"))
    return forecasts.join(right, [*keys, "date"], how)


def metrics(scored: DataFrame, by: Keys) -> DataFrame:
    """MAE, RMSE, bias and, when a scale is present, MASE."""
    e = F.col("prediction") - F.col("actual")
    out = [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.count("actual").alias("rows"),
    ]
    if "mase_scale" in scored.columns:
        out.append(F.avg(F.abs(e) / F.col("mase_scale")).alias("mase"))
    return scored.groupBy(*by).agg(*out)


def expand_horizons(scored: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """A row counts in every horizon that reaches its step."""
    reached = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("horizon_step"))
    e = F.col("prediction") - F.col("actual")
    scale = F.coalesce(F.when(F.col("mase_scale") != 0, F.col("mase_scale")), F.lit(1.0))
    return scored.withColumn("horizon", F.explode(reached)).withColumns(
        {
            "abs_error": F.abs(e),
            "squared_error": e * e,
            "bias_error": e,
            "scaled_abs_error": F.abs(e) / scale,
        }
    )


def _error_metrics() -> list[Column]:
    return [
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("scaled_abs_error").alias("mase"),
        F.avg("bias_error").alias("bias"),
        F.count(F.lit(1)).alias("rows"),
    ]


def fold_metrics(expanded: DataFrame) -> DataFrame:
    """Per model, implementation, fold and horizon; stations are counted from per-station partial rows."""
    by = ["model_name", "implementation", "fold_id", "horizon"]
    rows = expanded.withColumn("implementation", F.coalesce("implementation", F.lit("unknown")))
    return rows.groupBy(*by).agg(*_error_metrics(), F.count_distinct("station_id").alias("stations"))


def compare_models(folds: DataFrame, by: Keys = ("model_name", "implementation", "horizon")) -> DataFrame:
    by = [c for c in by if c in folds.columns]
    extra = [F.avg(c).alias(f"mean_{c}") for c in ("rows", "stations") if c in folds.columns]
    return (
        folds.groupBy(*by)
        .agg(
            *[F.avg(m).alias(f"mean_{m}") for m in ("mae", "rmse", "mase", "bias")],
            F.count_distinct("fold_id").alias("folds"),
            *extra,
        )
        .orderBy("horizon", "mean_mase", "mean_mae", "model_name")
    )


def recommend(comparison: DataFrame, by: Keys = ("horizon",)) -> DataFrame:
    """Best model per horizon by scaled error, then absolute error; one whole row."""
    rest = [c for c in comparison.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct("mean_mase", "mean_mae", "model_name"))
    return comparison.groupBy(*by).agg(best.alias("_b")).select(
        *by, *[F.col(f"_b.{c}").alias("recommended_model" if c == "model_name" else c) for c in rest]
    )


def slice_metrics(expanded: DataFrame) -> DataFrame:
    """Metrics for all stations and for maturity, sparsity, category and cluster slices: one explode, one shuffle."""
    has = set(expanded.columns)
    piece = lambda kind, value: F.struct(F.lit(kind).alias("slice_type"), value.alias("slice_value"))
    slices = [piece("all", F.lit("all_stations"))]
    if "history_group" in has:
        slices.append(F.when(F.col("history_group") == "mature", piece("history_group", F.lit("mature"))))
        slices.append(
            F.when(F.col("history_group").isin("newborn", "young"), piece("history_group", F.lit("short_history")))
        )
    if "station_category" in has:
        slices.append(
            F.when(
                F.col("station_category") == "sparse_intermittent", piece("station_group", F.lit("sparse_intermittent"))
            )
        )
        slices.append(piece("category", F.coalesce("station_category", F.lit("unknown"))))
    if "cluster_label" in has:
        slices.append(piece("cluster", F.coalesce("cluster_label", F.lit("unknown"))))
    rows = expanded.select("*", F.inline(F.filter(F.array(*slices), lambda s: s.isNotNull())))
    extra = []
    if {"covered_80", "width_80"} <= has:
        extra = [F.avg("covered_80").alias("coverage_80"), F.avg("width_80").alias("avg_width_80")]
    return rows.groupBy("model_name", "horizon", "slice_type", "slice_value").agg(
        *_error_metrics(), F.count_distinct("station_id").alias("stations"), *extra
    )
