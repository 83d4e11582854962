"""Fitted forecasts: guards, dynamic and differenced regression, exponential smoothing, boosted trees, production."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.util import inheritable_thread_target

from ridegauge.config import BacktestConfig
from ridegauge.functions.calendar import is_us_holiday
from ridegauge.functions.stats import clip0
from ridegauge.operators import boosting, features as ft
from ridegauge.operators.backtest import baseline_backtest, baseline_forecast
from ridegauge.operators.intervals import fill_intervals
from ridegauge.operators.keyed import rows_at_most
from ridegauge.operators.linear import fleet_ols
from ridegauge.session import cut_lineage

Keys = Sequence[str]


# ---- guards ----------------------------------------------------------------------------------------------------------


def upper_bounds(train: DataFrame, keys: Keys) -> DataFrame:
    """Plausible maximum of a forecast and the recent level of each series."""
    keys = list(keys)
    latest = W.partitionBy(*keys).orderBy(F.col("date").desc())
    rows = train.filter("target IS NOT NULL").withColumn("_r", F.row_number().over(latest))
    r90 = F.when(F.col("_r") <= 90, F.col("target"))
    r30 = F.when(F.col("_r") <= 30, F.col("target"))
    t = F.col("target")
    spread = F.greatest(F.stddev_pop(r90), F.lit(1.0))
    q = F.when(F.count(t) >= 10, F.percentile(t, F.lit(0.99)) * 4).otherwise(F.max(t) * 3)
    return rows.groupBy(*keys).agg(
        F.greatest(F.max(t) * 3, q, F.avg(r90) + 10 * spread, F.lit(1000.0)).alias("upper_bound"),
        F.avg(r30).alias("recent_mean"),
        F.max(r30).alias("recent_max"),
    )


def _facts(forecast: DataFrame, keys: Keys) -> DataFrame:
    p = F.col("prediction")
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == F.lit(math.inf))
    return forecast.groupBy(*keys).agg(
        F.max(bad).alias("_bad"), F.min(p).alias("_min"), F.max(p).alias("_max"),
        F.max_by(p, "horizon_step").alias("_end"), F.count(F.lit(1)).alias("_steps"),
    )


def implausible(forecast: DataFrame, train: DataFrame, keys: Keys, horizon: int, candidate: Keys = ()) -> DataFrame:
    """``implausible`` and ``reason`` per series (and ``candidate``): non-finite, negative, too high, drifting up or too volatile."""
    keys = list(keys)
    rows = _facts(forecast, [*keys, *candidate]).join(upper_bounds(train, keys), keys, "left")
    limit = F.coalesce("upper_bound", F.lit(1000.0))
    medium = (F.lit(horizon) >= 30) & (F.col("_steps") > 1)
    drifting = medium & (F.col("_end") > F.greatest(F.col("recent_max") * 1.6, F.col("recent_mean") * 1.75))
    volatile = medium & (F.col("_max") - F.col("_min") > F.greatest(F.col("recent_mean"), F.col("recent_max") * 0.75))
    reason = (
        F.when(F.col("_bad"), "non_finite_forecast_values")
        .when(F.col("_min") < 0, "negative_forecast_values")
        .when(F.col("_max") > limit, "forecast_exceeds_plausible_upper_bound")
        .when(drifting, "implausible_upward_drift")
        .when(volatile, "excessive_medium_horizon_volatility")
    )
    return rows.select(*keys, *candidate, reason.isNotNull().alias("implausible"), reason.alias("reason"))


def guard(forecast: DataFrame, train: DataFrame, keys: Keys, horizon: int, name: str, strong: bool = False) -> DataFrame:
    """Replace the whole forecast of a series by seasonal naive 7 when it is not plausible; clip the rest at zero.

    A series without any forecast gets the fallback too; below seven values that is the last value repeated.
    """
    keys = list(keys)
    if strong:
        verdict = implausible(forecast, train, keys, horizon)
    else:
        rows = _facts(forecast, keys).join(upper_bounds(train, keys), keys, "left")
        bad = F.col("_bad") | (F.col("_max") > F.coalesce("upper_bound", F.lit(1000.0)))
        verdict = rows.select(
            *keys, bad.alias("implausible"), F.when(bad, "non_finite_or_above_upper_bound").alias("reason")
        )
    known = train.groupBy(*keys).agg(F.count("target").alias("_known"))
    spare = baseline_forecast(train.filter("target IS NOT NULL"), keys, horizon, (7,)).join(known, keys)
    spare = spare.filter(F.col("model_name") == F.when(F.col("_known") >= 7, "seasonal_naive_7").otherwise("naive"))
    last = train.groupBy(*keys).agg(F.max("date").alias("_last"))
    spare = spare.join(last, keys).select(*keys, F.expr("date_add(_last, horizon_step)").alias("date"), "horizon_step", F.col("prediction").alias("_spare"))
    absent = forecast.select(*keys).distinct()
    alone = spare.join(absent, keys, "left_anti").select(
        *keys, "date", "horizon_step", F.col("_spare").alias("prediction"), F.lit(f"{name}_fallback").alias("model_name"),
        F.lit(True).alias("fallback_triggered"), F.lit("insufficient_history").alias("fallback_reason"),
    )
    joined = forecast.join(verdict, keys, "left").join(spare, [*keys, "date", "horizon_step"], "left")
    failed = F.coalesce("implausible", F.lit(False))
    judged = joined.select(
        *keys,
        "date",
        "horizon_step",
        F.when(failed, F.col("_spare")).otherwise(clip0(F.col("prediction"))).alias("prediction"),
        F.when(failed, f"{name}_fallback").otherwise(name).alias("model_name"),
        failed.alias("fallback_triggered"),
        F.col("reason").alias("fallback_reason"),
    )
    return judged.unionByName(alone)


# ---- regression ------------------------------------------------------------------------------------------------------


def _linear(coefficients: str, names: Sequence[str]) -> Column:
    total = F.get(coefficients, F.lit(0))
    for i, name in enumerate(names, start=1):
        total = total + F.get(coefficients, F.lit(i)) * F.col(name)
    return total


def fourier_regression(
    train: DataFrame, keys: Keys, horizon: int, weekly_order: int = 3, yearly_order: int = 3, external: DataFrame | None = None
) -> DataFrame:
    """Least squares on weekend, holiday, Fourier terms, external columns and a linear trend that runs on."""
    keys = list(keys)
    part = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(part)
    known = ft.known_future_frame(train, weekly_order, yearly_order, external)
    design = known.withColumn(
        "trend_index", F.when(n > 1, (F.row_number().over(part.orderBy("date")) - 1) / (n - 1)).otherwise(F.lit(0.0))
    )
    names = ["is_weekend", "is_holiday"]
    names += [c for c in known.columns if c.startswith(("weekly_", "yearly_"))]
    if external is not None:
        names += [c for c in external.columns if c != "date"]
    names.append("trend_index")
    fit = fleet_ols(design, keys, names, "target", null_regressor=0.0)
    size = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ahead = ft.known_future_frame(ft.future_dates(train, keys, horizon), weekly_order, yearly_order, external)
    span = max(horizon - 1, 1)
    ahead = ahead.join(fit, keys).join(size, keys).withColumn(
        "trend_index", 1 + (F.lit(horizon) / F.col("_n")) * (F.col("horizon_step") - 1) / F.lit(span)
    )
    raw = ahead.select(*keys, "date", "horizon_step", _linear("coefficients", names).alias("prediction"))
    return guard(raw, train, keys, horizon, "fourier_dynamic_regression")


DIFFERENCED_SPECS = ((1, 7), (1, 2, 7), (1, 2, 3, 7, 14))


def differenced_regression(
    train: DataFrame, keys: Keys, horizon: int, season: int = 7, specs: Sequence[Sequence[int]] = DIFFERENCED_SPECS,
    history: int | None = None,
) -> DataFrame:
    """Seasonally differenced autoregression with holidays; of the specifications with a plausible forecast the lowest AIC wins.

    Least squares on seasonal differences, not a likelihood fit. All history counts unless ``history`` caps it. The recursion carries one short array per series (the last values), so a step is a projection and not a join.
    """
    keys = list(keys)
    rows = train.select(*keys, "date", "target")
    rows = ft.cap_history(rows, keys, history) if history else rows
    ordered = W.partitionBy(*keys).orderBy("date")
    rows = rows.withColumn("_d", F.col("target") - F.lag("target", season).over(ordered))
    lags = sorted({k for spec in specs for k in spec})
    rows = rows.withColumns(
        {
            **{f"_d{k}": F.lag("_d", k).over(ordered) for k in lags},
            "_ho": is_us_holiday(F.col("date")).cast("double"),
        }
    )
    rows = rows.withColumn("_dho", F.col("_ho") - F.lag("_ho", season).over(ordered))
    fits = None
    for i, spec in enumerate(specs):
        names = [f"_d{k}" for k in spec] + ["_dho"]
        fit = fleet_ols(rows.na.drop(subset=[f"_d{max(lags)}"]), keys, names, "_d")
        width = len(names) + 1
        aic = F.col("nobs") * F.log(F.greatest(F.col("sse"), F.lit(1e-12)) / F.col("nobs")) + 2 * width
        row = fit.select(*keys, F.lit(i).alias("spec"), aic.alias("aic"), "coefficients", "nobs")
        fits = row if fits is None else fits.unionByName(row)
    need = season + max(lags)
    latest = W.partitionBy(*keys).orderBy(F.col("date").desc())
    tail = (
        rows.withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= need)
        .groupBy(*keys)
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("date", "target"))), lambda p: p["target"]).alias("h"),
            F.max("date").alias("last"),
        )
    )
    start = tail.join(fits.select(*keys, "spec", F.struct("spec", "aic", "coefficients", "nobs").alias("b")), keys)
    y = lambda h, back: F.element_at(h, -back)

    def step(state: Column, s: Column) -> Column:
        h, c = state, F.col("b.coefficients")
        date = F.date_add(F.col("last"), s)
        hol = is_us_holiday(date).cast("double") - is_us_holiday(F.date_sub(date, season)).cast("double")
        options = None
        for i, spec in enumerate(specs):
            d = F.get(c, F.lit(0))
            for j, k in enumerate(spec, start=1):
                d = d + F.get(c, F.lit(j)) * (y(h, k) - y(h, k + season))
            d = d + F.get(c, F.lit(len(spec) + 1)) * hol
            options = F.when(F.col("b.spec") == i, d) if options is None else options.when(F.col("b.spec") == i, d)
        return F.concat(h, F.array(y(h, season) + options))

    grown = start.withColumn("h", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("h"), step))
    each = grown.select(
        *keys, "spec", "last", F.posexplode(F.slice("h", -horizon, horizon)).alias("_p", "prediction")
    ).select(
        *keys, "spec", F.date_add("last", F.col("_p") + 1).alias("date"), (F.col("_p") + 1).alias("horizon_step"), "prediction"
    )
    verdicts = implausible(each, train, keys, horizon, ["spec"])
    order = F.struct("implausible", "aic", "spec")
    best = fits.join(verdicts, [*keys, "spec"]).groupBy(*keys).agg(
        F.min_by(F.struct("spec", "aic", "coefficients", "nobs"), order).alias("b")
    )
    raw = each.join(best.select(*keys, F.col("b.spec").alias("spec")), [*keys, "spec"]).drop("spec")
    chosen = best.select(*keys, F.concat(F.lit("lags="), F.element_at(
        F.array(*[F.lit("|".join(map(str, s))) for s in specs]), F.col("b.spec") + 1)).alias("selected_spec"),
        F.col("b.aic").alias("aic"), F.col("b.nobs").alias("nobs"))
    return guard(raw, train, keys, horizon, "seasonal_difference_regression", strong=True).join(chosen, keys, "left")


# ---- exponential smoothing -------------------------------------------------------------------------------------------

SMOOTHING_GRID = tuple(product((0.1, 0.3, 0.6), (0.01, 0.1), (0.05, 0.2), (0.9, 0.98)))


def ets(train: DataFrame, keys: Keys, horizon: int, season: int = 7, grid: Sequence[tuple] = SMOOTHING_GRID) -> DataFrame:
    """Damped additive trend and season; every parameter set is folded over the history, least squares picks one.

    A series is one array (bounded by its calendar); the fold runs in the JVM. It folds over the calendar: a missing value keeps
    its season slot and leaves the state where the trend carries it. A series below two seasons of values has no season term.
    """
    keys = list(keys)
    arrays = train.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "target"))), lambda p: p["target"]).alias("_all"),
        F.max("date").alias("last"),
    )
    known = lambda a: F.filter(a, lambda v: v.isNotNull())
    begin = F.array_position(F.transform("_all", lambda v: v.isNotNull()), True)
    arrays = arrays.filter(F.size(known("_all")) > 0).withColumn("y", F.slice("_all", begin.cast("int"), F.size("_all"))).drop("_all")
    arrays = arrays.withColumn("_seasonal", F.size(known("y")) >= 2 * season)
    params = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(p).alias("p"))
            for a, b, g, p in grid
        ]
    )
    first = F.slice("y", 1, season)
    mean = F.aggregate(known(first), F.lit(0.0), lambda s, v: s + v) / F.size(known(first))
    rows = arrays.withColumn("_m", F.when(F.col("_seasonal"), mean).otherwise(F.get("y", F.lit(0)))).withColumn("q", F.explode(params))
    # The fold is work, not bytes: deal series and parameter sets over all tasks before it.
    rows = rows.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "q")
    shape = F.when(F.col("_seasonal"), F.transform(first, lambda v: F.coalesce(v - F.col("_m"), F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), season))
    init = F.struct(F.col("_m").alias("l"), F.lit(0.0).alias("t"), shape.alias("s"), F.lit(0.0).alias("sse"))

    def step(st: Column, v: Column) -> Column:
        q = F.col("q")
        damped = st["l"] + q["p"] * st["t"]
        oldest = F.element_at(st["s"], 1)
        level = F.when(v.isNull(), damped).otherwise(q["a"] * (v - oldest) + (1 - q["a"]) * damped)
        slot = F.when(v.isNull() | ~F.col("_seasonal"), oldest).otherwise(q["g"] * (v - damped) + (1 - q["g"]) * oldest)
        miss = F.coalesce(v - damped - oldest, F.lit(0.0))
        return F.struct(
            level.alias("l"),
            F.when(v.isNull(), q["p"] * st["t"]).otherwise(q["b"] * (level - st["l"]) + (1 - q["b"]) * q["p"] * st["t"]).alias("t"),
            F.concat(F.slice(st["s"], 2, season - 1), F.array(slot)).alias("s"),
            (st["sse"] + miss * miss).alias("sse"),
        )

    rest = F.slice(F.col("y"), F.when(F.col("_seasonal"), season + 1).otherwise(2), F.size("y"))
    fitted = rows.withColumn("st", F.aggregate(rest, init, step))
    best = fitted.groupBy(*keys, "last").agg(F.min_by(F.struct("st", "q"), F.struct("st.sse", "q")).alias("f"))
    steps = best.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    phi, st = F.col("f.q.p"), F.col("f.st")
    damp = phi * (1 - F.pow(phi, F.col("horizon_step"))) / (1 - phi)
    slot = F.pmod(F.col("horizon_step") - 1, F.lit(season))
    raw = steps.select(
        *keys, F.date_add("last", F.col("horizon_step")).alias("date"), "horizon_step",
        (st["l"] + damp * st["t"] + F.get(st["s"], slot)).alias("prediction"),
    )
    return guard(raw, train, keys, horizon, "ets")


# ---- trees -----------------------------------------------------------------------------------------------------------

# The two parameter sets of each tree family.
TREE_GRID = {
    "xgboost": ({"learning_rate": 0.05, "max_depth": 4, "n_estimators": 250}, {"learning_rate": 0.03, "max_depth": 6, "n_estimators": 350}),
    "lgbm": ({"learning_rate": 0.05, "max_depth": 6, "n_estimators": 250}, {"learning_rate": 0.03, "max_depth": 8, "n_estimators": 350}),
}
TREE_COLUMNS = ["station_code", *[c for c in ft.STATION_FEATURES if c != "station_id"]]


#: Training rows a task holds; a small panel is few tasks, a large one many.
TREE_ROWS_A_TASK = 50_000


def side_by_side(jobs: Sequence[Callable[[], object]]) -> list:
    """Results of independent fits whose jobs share the executors: a boosted model is a long row of short jobs, which alone leaves them idle."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(job)) for job in jobs]]


def tree_input(rows: DataFrame) -> DataFrame:
    """``rows`` written once, in as many partitions as their number asks for."""
    rows = cut_lineage(rows)
    wanted = max(1, rows.count() // TREE_ROWS_A_TASK)
    return cut_lineage(rows.coalesce(wanted)) if wanted < rows.rdd.getNumPartitions() else rows


#: Rows up to which a model is fitted in one task (some 21 bytes a row on the driver and in the task, and a few columns more there).
TASK_ROWS = 2_000_000


def fit_all(rows: DataFrame, many: Sequence[dict], columns: Sequence[str] = TREE_COLUMNS, seed: int = 42) -> list:
    """A model for each parameter set; all have ``transform``, which adds ``_p``.

    Rows that fit in a task are boosted there, a task for each model, which takes a job in all instead of several for every level of every
    tree. A larger table takes the same steps in Spark's trees, whose levels are jobs over all tasks, the models side by side.
    """
    if rows_at_most(rows, TASK_ROWS):
        return boosting.fit(rows, many, columns)
    return side_by_side([lambda p=p: fit_trees(rows, p, columns, seed) for p in many])


def fit_trees(rows: DataFrame, params: dict, columns: Sequence[str] = TREE_COLUMNS, seed: int = 42) -> PipelineModel:
    """Distributed boosted trees over pooled, encoded training rows."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="error")
    gbt = GBTRegressor(
        featuresCol="_x", labelCol="target", predictionCol="_p", maxIter=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]), stepSize=float(params["learning_rate"]), seed=seed,
        checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, gbt]).fit(rows)


def tune_families(
    rows: DataFrame, grids: dict[str, Sequence[dict]], horizon: int, columns: Sequence[str] = TREE_COLUMNS, seed: int = 42
) -> dict[str, tuple[dict, DataFrame]]:
    """For each family, on one time-ordered split, the parameters with the lowest mean absolute error and the tuning table.

    All candidates of all families are fitted side by side; equal parameters of two families are fitted once.
    """
    spark = rows.sparkSession
    split = cut_lineage(ft.time_split(rows, horizon))
    valid = split.filter("role = 'valid'")
    scores: dict[tuple, float | None] = {}
    distinct = list({_values(p): p for grid in grids.values() for p in grid}.values())
    if not valid.isEmpty():
        train = tree_input(split.filter("role = 'train'"))

        def score(model) -> float:
            return model.transform(valid).agg(F.avg(F.abs(F.col("_p") - F.col("target")))).collect()[0][0]

        found = side_by_side([lambda m=m: score(m) for m in fit_all(train, distinct, columns, seed)])
        scores = {_values(p): s for p, s in zip(distinct, found, strict=True)}
    schema = "candidate_rank int, selected boolean, validation_mae double, learning_rate double, max_depth double, n_estimators double"
    out = {}
    for family, grid in grids.items():
        mine = [scores.get(_values(p)) for p in grid]
        best = min(range(len(grid)), key=lambda i: mine[i]) if scores else 0
        table = [(i + 1, i == best, mine[i], *map(float, _values(p))) for i, p in enumerate(grid)]
        out[family] = grid[best], spark.createDataFrame(table, schema)
    return out


def tune(rows: DataFrame, grid: Sequence[dict], horizon: int, columns: Sequence[str] = TREE_COLUMNS, seed: int = 42):
    """:func:`tune_families` for one grid."""
    return tune_families(rows, {"": grid}, horizon, columns, seed)[""]


def _values(params: dict) -> tuple:
    return params["learning_rate"], params["max_depth"], params["n_estimators"]


Predict = Callable[[DataFrame], DataFrame]


def tree_predictor(model: PipelineModel | boosting.Forest) -> Predict:
    """Adds ``prediction`` to feature rows; null features count as zero, as in encoding."""

    def predict(rows: DataFrame) -> DataFrame:
        filled = rows.na.fill(0.0, subset=[c for c in TREE_COLUMNS if c in rows.columns])
        return model.transform(filled).withColumn("prediction", F.col("_p")).drop("_x", "_p")

    return predict


HISTORY = 28


def predict_recursive(panel: DataFrame, horizon: int, predict: Predict, mapping: DataFrame | None = None) -> DataFrame:
    """Multi-step forecasts that feed each prediction back as history.

    State is one row per station with its last 28 days as an array, so a step needs neither join nor window. Each step is
    checkpointed, which keeps the plan short and survives lost executors.
    """
    end = panel.agg(F.max("date").alias("d")).scalar()
    rows = panel.select("station_id", "date", "target", "in_service").withColumn("_end", end)
    state = rows.groupBy("station_id", "_end").agg(
        F.min(F.when(F.col("in_service"), F.col("date"))).alias("_start"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("date") > F.date_sub("_end", HISTORY), F.struct("date", "target")))
        ).alias("_m"),
    )
    days = F.transform(
        F.sequence(F.lit(HISTORY - 1), F.lit(0), F.lit(-1)),
        lambda i: F.try_element_at("_m", F.date_sub(F.col("_end"), i)),
    )
    state = state.select("station_id", "_end", "_start", days.alias("_h"))
    if mapping is not None:
        state = ft.encode(state, "station_id", mapping, "station_code")
    state = cut_lineage(state)
    known = F.filter("_h", lambda v: v.isNotNull())
    week = F.filter(F.slice("_h", HISTORY - 6, 7), lambda v: v.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = lambda a, least: F.when(F.size(a) >= least, total(a) / F.size(a))
    out: list[DataFrame] = []
    for s in range(1, horizon + 1):
        centre = total(known) / F.size(known)
        squares = total(F.transform(known, lambda v: (v - centre) * (v - centre)))
        date = F.date_add("_end", s)
        weekday = F.weekday(date)
        rows = state.withColumns(
            {
                "date": date,
                "station_age_days": F.greatest(F.coalesce(F.datediff(date, "_start"), F.lit(0)), F.lit(0)),
                "day_of_week": weekday,
                "month": F.month(date),
                "is_weekend": (weekday >= 5).cast("int"),
                "is_holiday": is_us_holiday(date).cast("int"),
                "lag_1": F.element_at("_h", -1),
                "lag_7": F.element_at("_h", -7),
                "lag_14": F.element_at("_h", -14),
                "rolling_mean_7": mean(week, 3),
                "rolling_mean_28": mean(known, 7),
                "rolling_std_28": F.when(F.size(known) >= 7, F.sqrt(squares / (F.size(known) - 1))),
            }
        )
        done = cut_lineage(
            predict(rows).withColumn("prediction", clip0(F.col("prediction").cast("double"))).select(
                *state.columns, "date", "prediction"
            )
        )
        out.append(done.select("station_id", "date", F.lit(s).alias("horizon_step"), "prediction"))
        state = done.withColumn("_h", F.concat(F.slice("_h", 2, HISTORY - 1), F.array("prediction"))).drop("date", "prediction")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def station_tree_families(panel: DataFrame, horizon: int, params: dict[str, dict]) -> DataFrame:
    """For each family, a fit on the whole panel and recursive forecasts of all stations; the fits run side by side."""
    mapping = cut_lineage(ft.category_map(panel, "station_id"))
    frame = ft.encode(ft.station_features(panel), "station_id", mapping, "station_code")
    rows = tree_input(ft.training_rows(frame, [c for c in TREE_COLUMNS if c != "station_code"]))

    models = dict(zip(params, fit_all(rows, list(params.values())), strict=True))

    def forecast(family: str) -> DataFrame:
        return predict_recursive(panel, horizon, tree_predictor(models[family]), mapping).withColumns(
            {"model_name": F.lit(family), "implementation": F.lit("spark_gbt")}
        )

    out = None
    for part in side_by_side([lambda f=f: forecast(f) for f in params]):
        out = part if out is None else out.unionByName(part)
    return out


def station_trees(panel: DataFrame, horizon: int, params: dict, name: str = "gbt") -> DataFrame:
    """Fit on the whole panel and forecast all stations recursively."""
    return station_tree_families(panel, horizon, {name: params})


# ---- runners ---------------------------------------------------------------------------------------------------------


def run_family(train: DataFrame, keys: Keys, horizons: Sequence[int] = (7, 30, 90), season: int = 7) -> DataFrame:
    """Every network model at every horizon.

    Baselines and smoothing do not depend on the horizon and run once at the longest; guarded regressions judge the
    whole horizon and therefore run per horizon.
    """
    keys = list(keys)
    longest = max(horizons)
    reached = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("horizon_step"))
    columns = [*keys, "date", "horizon_step", "prediction", "model_name", "horizon", "model_family"]
    base = baseline_forecast(train, keys, longest).withColumn("horizon", F.explode(reached))
    out = base.withColumn("model_family", F.lit("baseline")).select(*columns)
    smooth = ets(train, keys, longest, season).withColumn("horizon", F.explode(reached))
    out = out.unionByName(smooth.withColumn("model_family", F.lit("classical")).select(*columns))
    for h in horizons:
        for fitted in (fourier_regression(train, keys, h), differenced_regression(train, keys, h, season)):
            rows = fitted.withColumns({"horizon": F.lit(h), "model_family": F.lit("classical")})
            out = out.unionByName(rows.select(*columns))
    return out


FITTED = {"ets": ets, "fourier_dynamic_regression": fourier_regression, "seasonal_difference_regression": differenced_regression}


def fitted_backtest(series: DataFrame, keys: Keys, config: BacktestConfig = BacktestConfig(), models: dict = FITTED) -> DataFrame:
    """Rolling-origin forecasts of fitted models, in the columns of ``baseline_backtest`` and ready to be united with it.

    A fold is part of the series key, so every fold of every series is fitted in the same plan; daily rows are copied once for
    each fold that trains on them (at most ``max_folds`` a horizon).
    """
    keys = list(keys)
    base = baseline_backtest(series, keys, config)
    tests = cut_lineage(
        base.filter("model_name = 'naive'").select(*keys, "fold_id", "horizon", "horizon_step", "date", "train_end", "actual", "mase_scale")
    )
    folds = tests.select(*keys, "fold_id", "horizon", "train_end").distinct()
    train = cut_lineage(series.select(*keys, "date", "target").join(folds, keys).filter("date <= train_end").drop("train_end"))
    fold = [*keys, "fold_id"]
    out = None
    for h in config.horizons:
        part = train.filter(F.col("horizon") == h).drop("horizon")
        for make in models.values():
            rows = make(part, fold, h).select(*fold, F.lit(h).alias("horizon"), "date", "prediction", "model_name")
            out = rows if out is None else out.unionByName(rows)
    return tests.join(out, [*fold, "horizon", "date"]).select(*base.columns)


def active_stations(panel: DataFrame, recent_days: int = 90, min_days: int = 3) -> DataFrame:
    """Stations in service on enough of the latest days."""
    last = panel.agg(F.max("date").alias("d")).scalar()
    recent = panel.withColumn("_last", last).filter(F.col("in_service") & (F.col("date") > F.date_sub("_last", recent_days)))
    per = recent.groupBy("station_id").agg(F.count_distinct("date").alias("recent_service_days"))
    return per.filter(F.col("recent_service_days") >= min_days)


def production(
    panel: DataFrame, raw: DataFrame, calibration: DataFrame, horizons: Sequence[int] = (7, 30), slices: DataFrame | None = None,
    recent_days: int = 90, min_days: int = 3,
) -> DataFrame:
    """Keep active stations, expand to horizons, attach slices and fill missing bounds from calibration."""
    active = active_stations(panel, recent_days, min_days).select("station_id")
    reached = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("horizon_step"))
    rows = raw.join(active, "station_id", "left_semi").withColumn("horizon", F.explode(reached))
    if slices is not None:
        rows = ft.attach_slices(rows, slices)
    return fill_intervals(rows, calibration)
