"""Per-series diagnostics over a prepared series (``timestamp, observed_value, value_filled, imputed_flag``)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ridegauge.functions.stats import unbiased_kurtosis, unbiased_skew
from ridegauge.operators.keyed import exact_quantiles, with_one_row
from ridegauge.operators.linear import fleet_ols

Keys = Sequence[str]


def primary_period(n: Column, candidates: Sequence[int], fallback: int | None = None) -> Column:
    """First candidate of at least 2 that fits twice into the series, else the fallback under the same rule."""
    options = [c for c in (*candidates, fallback) if c and c >= 2]
    return F.coalesce(*[F.when(n >= 2 * c, F.lit(c)) for c in options]) if options else F.lit(None).cast("int")


def with_period(prepared: DataFrame, keys: Keys, candidates: Sequence[int], fallback: int | None = None) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return prepared.withColumn("primary_period", primary_period(n, candidates, fallback))


def _by_period(make, candidates: Sequence[int]) -> Column:
    """Pick the expression that belongs to the row's primary period."""
    out = F
    for c in sorted(set(candidates)):
        out = out.when(F.col("primary_period") == c, make(c))
    return out


def baseline_screen(
    prepared: DataFrame, keys: Keys, candidates: Sequence[int], fallback: int | None = None, value: str = "value_filled"
) -> DataFrame:
    """In-sample naive and seasonal-naive absolute errors; screening only, not forecast validation."""
    ordered = W.partitionBy(*keys).orderBy("timestamp")
    options = [c for c in (*candidates, fallback) if c]
    rows = with_period(prepared.filter(F.col(value).isNotNull()), keys, candidates, fallback)
    v = F.col(value)
    rows = rows.select(
        *keys,
        "primary_period",
        F.abs(v - F.lag(v, 1).over(ordered)).alias("_naive"),
        _by_period(lambda c: F.abs(v - F.lag(v, c).over(ordered)), options).alias("_seasonal"),
    )
    return (
        rows.groupBy(*keys)
        .agg(
            F.max("primary_period").alias("season_length"),
            F.avg("_naive").alias("baseline_screening_naive_mae"),
            F.avg("_seasonal").alias("baseline_screening_seasonal_naive_mae"),
        )
        .withColumn(
            "baseline_screening_seasonal_gain",
            F.when(
                F.col("baseline_screening_naive_mae") > 0,
                (F.col("baseline_screening_naive_mae") - F.col("baseline_screening_seasonal_naive_mae"))
                / F.col("baseline_screening_naive_mae"),
            ),
        )
        .withColumn("baseline_screening_scope", F.lit("in_sample_screening_only"))
    )


def baseline_table(screen: DataFrame, keys: Keys) -> DataFrame:
    """The screen in long form, one row per baseline."""
    long = screen.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.lit("naive").alias("baseline_name"),
                    F.col("baseline_screening_naive_mae").alias("mae"),
                    F.lit(None).cast("int").alias("season_length"),
                ),
                F.struct(
                    F.lit("seasonal_naive").alias("baseline_name"),
                    F.col("baseline_screening_seasonal_naive_mae").alias("mae"),
                    F.col("season_length").alias("season_length"),
                ),
            )
        ),
    )
    return long.filter("mae IS NOT NULL").withColumn("diagnostic_scope", F.lit("screening_only_in_sample"))


def _profile(prepared: DataFrame, by: Sequence[str]) -> DataFrame:
    return prepared.groupBy(*by).agg(
        F.avg("observed_value").alias("average_observed_value"),
        F.avg("value_filled").alias("average_filled_value"),
        F.count("observed_value").alias("observed_points"),
        F.sum("imputed_flag").alias("imputed_points"),
    )


def weekday_profile(prepared: DataFrame, keys: Keys) -> DataFrame:
    rows = prepared.withColumn("weekday", F.date_format("timestamp", "EEEE")).withColumn(
        "weekday_order", F.weekday("timestamp")
    )
    return _profile(rows, [*keys, "weekday", "weekday_order"])


def month_profile(prepared: DataFrame, keys: Keys) -> DataFrame:
    rows = prepared.withColumn("month", F.date_format("timestamp", "MMMM")).withColumn("month_order", F.month("timestamp"))
    return _profile(rows, [*keys, "month", "month_order"])


def intraday_profile(prepared: DataFrame, keys: Keys) -> DataFrame:
    weekend = F.when(F.weekday("timestamp") >= 5, "weekend").otherwise("weekday")
    return _profile(prepared.withColumn("weekend", weekend).withColumn("hour", F.hour("timestamp")), [*keys, "weekend", "hour"])


def acf_summary(
    prepared: DataFrame, keys: Keys, candidates: Sequence[int], fallback: int | None = None, value: str = "value_filled"
) -> DataFrame:
    """Correlation of the series with itself shifted by 1, 2 and the primary period."""
    ordered = W.partitionBy(*keys).orderBy("timestamp")
    options = [c for c in (*candidates, fallback) if c]
    v = F.col(value)
    rows = with_period(prepared.filter(v.isNotNull()), keys, candidates, fallback).select(
        *keys,
        "primary_period",
        v.alias("v"),
        F.lag(v, 1).over(ordered).alias("_l1"),
        F.lag(v, 2).over(ordered).alias("_l2"),
        _by_period(lambda c: F.lag(v, c).over(ordered), options).alias("_ls"),
    )
    both = lambda lag: F.corr("v", lag)
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        F.when(n >= 3, "ok").otherwise("insufficient_history").alias("autocorrelation_status"),
        F.when(n >= 3, both("_l1")).alias("lag1_autocorrelation"),
        F.when(n > 3, both("_l2")).alias("lag2_autocorrelation"),
        F.when(n > F.max("primary_period") + 2, both("_ls")).alias("seasonal_lag_autocorrelation"),
    )


def acf(prepared: DataFrame, keys: Keys, max_lag: int, value: str = "value_filled") -> DataFrame:
    """Autocorrelation 0..max_lag around the series mean, one row per lag.

    All lags are window columns of a single sort; a lag self-join would multiply the series by ``max_lag``.
    """
    series = W.partitionBy(*keys)
    ordered = series.orderBy("timestamp")
    rows = prepared.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(series))
    lagged = rows.select(*keys, "_d", *[F.lag("_d", k).over(ordered).alias(f"_d{k}") for k in range(1, max_lag + 1)])
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(
            F.sum(F.col("_d") * F.col("_d")),
            *[F.coalesce(F.sum(F.col("_d") * F.col(f"_d{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)],
        ).alias("_s"),
    )
    zero = F.get("_s", F.lit(0))
    return (
        sums.select(*keys, "n", F.posexplode(F.transform("_s", lambda s: F.when(zero > 0, s / zero))).alias("lag", "acf"))
        .filter(F.col("lag") < F.col("n"))
        .drop("n")
    )


def pacf(acf_rows: DataFrame, keys: Keys) -> DataFrame:
    """Partial autocorrelation by folding the Durbin-Levinson step over the acf of a series (lags from 0)."""
    per = acf_rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda p: p["acf"]).alias("r")
    )
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), none.alias("out"))

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        head = F.slice(F.col("r"), F.lit(2), k - 1)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        reflect = (F.get(F.col("r"), k) - dot(phi, F.reverse(head))) / (F.lit(1.0) - dot(phi, head))
        fresh = F.zip_with(phi, F.reverse(phi), lambda a, b: a - reflect * b)
        return F.struct(
            F.concat(fresh, F.array(reflect)).alias("phi"), F.concat(state["out"], F.array(reflect)).alias("out")
        )

    folded = per.select(
        *keys, F.aggregate(F.sequence(F.lit(1), F.size("r") - 1), start, step)["out"].alias("out")
    )
    return folded.select(*keys, F.posexplode("out").alias("_p", "pacf")).select(
        *keys, (F.col("_p") + 1).alias("lag"), "pacf"
    )


def periodogram(prepared: DataFrame, keys: Keys, value: str = "value_filled", min_points: int = 16) -> DataFrame:
    """One-sided power spectrum of the linearly detrended series.

    A series is bounded by its calendar, so one FFT per series (n log n) beats a frequency join (n squared).
    """
    key_fields = [prepared.schema[k] for k in keys]
    schema = T.StructType(
        [*key_fields, T.StructField("k", T.IntegerType()), T.StructField("n", T.IntegerType()),
         T.StructField("period", T.DoubleType()), T.StructField("power", T.DoubleType())]
    )

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("timestamp")["v"].to_numpy(dtype=float)
        n = len(y)
        if n < min_points:
            return pd.DataFrame(columns=schema.names)
        t = np.arange(n) - (n - 1) / 2.0
        y = y - y.mean() - t * (t @ (y - y.mean())) / (t @ t)
        power = np.abs(np.fft.rfft(y)) ** 2 / n**2
        upper = len(power) - 1 if n % 2 == 0 else len(power)
        power[1:upper] *= 2.0
        k = np.arange(1, len(power))
        out = pd.DataFrame({"k": k, "n": n, "period": n / k, "power": power[1:]})
        for name in reversed(keys):
            out.insert(0, name, pdf[name].iloc[0])
        return out

    rows = prepared.filter(F.col(value).isNotNull()).select(*keys, "timestamp", F.col(value).alias("v"))
    return rows.groupBy(*keys).applyInPandas(spectrum, schema)


def spectral_peaks(spectrum: DataFrame, keys: Keys, candidates: Sequence[int], top: int = 5) -> DataFrame:
    """Ranked peaks after suppressing neighbours of stronger ones, with candidate match and the strong-peak test."""
    period = F.round("period", 2)
    match = F.coalesce(
        *[F.when(F.abs(F.col("period") - c) <= max(1.0, c * 0.15), F.lit(int(c))) for c in candidates],
        F.lit(None).cast("int"),
    )
    whole = spectrum.groupBy(*keys).agg(
        F.sum("power").alias("total"),
        F.percentile("power", F.lit(0.5)).alias("median"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("period").between(2, F.col("n") / 2),
                    F.struct((-F.col("power")).alias("minus"), F.col("k"), period.alias("period"), match.alias("match")),
                )
            )
        ).alias("ranked"),
    )

    def keep(kept: Column, item: Column) -> Column:
        clash = F.exists(
            kept, lambda s: F.abs(item["period"] - s["period"]) <= F.greatest(F.lit(1.5), s["period"] * 0.08)
        )
        return F.when((F.size(kept) >= top) | clash, kept).otherwise(F.concat(kept, F.array(item)))

    none = F.slice(F.col("ranked"), 1, 0)
    chosen = whole.withColumn("peaks", F.aggregate("ranked", none, keep))
    rows = chosen.select(*keys, "total", "median", F.posexplode("peaks").alias("_i", "p"))
    power = -F.col("p.minus")
    relative = F.when(F.col("total") > 0, power / F.col("total")).otherwise(0.0)
    ratio = F.when(F.col("median") > 0, power / F.col("median"))
    return rows.select(
        *keys,
        (F.col("_i") + 1).alias("peak_rank"),
        F.col("p.period").alias("period"),
        power.alias("power"),
        relative.alias("relative_power"),
        F.col("p.match").alias("matched_candidate_period"),
        ratio.alias("power_ratio"),
        (F.coalesce(ratio >= 5.0, F.lit(False)) & (relative >= 0.10) & (F.col("_i") == 0)).alias("strong_peak"),
    )


def multi_season(peaks: DataFrame, keys: Keys, n_candidates: int) -> DataFrame:
    n, matched = F.count(F.lit(1)), F.count_distinct("matched_candidate_period")
    return peaks.groupBy(*keys).agg(
        n.alias("peaks"),
        matched.alias("matched_periods"),
        F.max("strong_peak").alias("strong_primary"),
        ((n >= 2) & F.max("strong_peak") & ((matched >= 2) | ((n >= 3) & F.lit(n_candidates >= 2)))).alias(
            "multiple_seasonality"
        ),
    )


def _scored(rows: DataFrame, keys: Keys, threshold: float, imputed: str | None) -> DataFrame:
    score = F.lit(0.6745) * F.col("residual") / F.col("_mad")
    raw = F.coalesce(F.abs(score) > threshold, F.lit(False))
    is_imputed = F.coalesce(F.col(imputed).cast("boolean"), F.lit(False)) if imputed else F.lit(False)
    return (
        rows.withColumn("robust_score", F.coalesce(score, F.lit(0.0)))
        .withColumn("raw_outlier_flag", raw)
        .withColumn("suppressed_imputed_anomaly_flag", raw & is_imputed)
        .withColumn("outlier_flag", raw & ~is_imputed)
        .drop("_mad")
    )


def _rolling_median(c: Column, frame, minimum: int) -> Column:
    return F.when(F.count(c).over(frame) >= minimum, F.percentile(c, F.lit(0.5)).over(frame))


def anomaly_centered(
    df: DataFrame, keys: Keys, window: int, threshold: float = 5.0, value: str = "value_filled",
    imputed: str | None = "imputed_flag", ts: str = "timestamp",
) -> DataFrame:
    """Robust score around a centred rolling median (``w/2`` rows before, ``(w-1)/2`` after)."""
    w = max(int(window), 5)
    least = max(3, w // 2)
    ordered = W.partitionBy(*keys).orderBy(ts)
    frame = ordered.rowsBetween(-(w // 2), (w - 1) // 2)
    ahead, back = ordered.rowsBetween(0, W.unboundedFollowing), ordered.rowsBetween(W.unboundedPreceding, 0)

    def fill(name: str, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(name, F.coalesce(name, F.first(name, ignorenulls=True).over(ahead)))
        return rows.withColumn(name, F.coalesce(name, F.last(name, ignorenulls=True).over(back)))

    rows = fill("rolling_median", df.withColumn("rolling_median", _rolling_median(F.col(value), frame, least)))
    rows = rows.withColumn("residual", F.col(value) - F.col("rolling_median"))
    mad = rows.withColumn("_abs", F.abs("residual")).withColumn("_mad", _rolling_median(F.col("_abs"), frame, least))
    mad = fill("_mad", mad.drop("_abs").withColumn("_mad", F.when(F.col("_mad") != 0, F.col("_mad"))))
    return _scored(mad, keys, threshold, imputed)


def anomaly_causal(
    df: DataFrame, keys: Keys, window: int, threshold: float = 5.0, value: str = "value_filled",
    imputed: str | None = "imputed_flag", ts: str = "timestamp",
) -> DataFrame:
    """Robust score against the past only, on a filled series.

    Until the trailing window holds enough rows it spans the whole past anyway, so the expanding fallback is the same
    median with the minimum count dropped.
    """
    w = max(int(window), 5)
    ordered = W.partitionBy(*keys).orderBy(ts)
    past = ordered.rowsBetween(-w, -1)
    rows = df.withColumn("rolling_median", _rolling_median(F.col(value), past, 1))
    rows = rows.withColumn("residual", F.col(value) - F.col("rolling_median")).withColumn("_abs", F.abs("residual"))
    rows = rows.withColumn("_mad", _rolling_median(F.col("_abs"), past, 1)).drop("_abs")
    return _scored(rows.withColumn("_mad", F.when(F.col("_mad") != 0, F.col("_mad"))), keys, threshold, imputed)


def anomaly_summary(detail: DataFrame, keys: Keys) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("int"))
    return detail.groupBy(*keys).agg(
        count("outlier_flag").alias("outlier_count"),
        F.avg(F.col("outlier_flag").cast("int")).alias("outlier_share"),
        count("suppressed_imputed_anomaly_flag").alias("suppressed_imputed_anomaly_count"),
    )


def distribution(df: DataFrame, keys: Keys, value: str = "observed_value") -> DataFrame:
    """Moments and shape per series; skew and kurtosis are sample-size corrected."""
    v = F.col(value)
    n = F.count(v)
    whole = F.abs(v - F.round(v)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.round(v))
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg((v == 0).cast("int")).alias("zero_share"),
        unbiased_skew(F.skewness(v), n).alias("skewness"),
        unbiased_kurtosis(F.kurtosis(v), n).alias("kurtosis"),
        F.min(whole & (v >= 0)).alias("is_count_like"),
        F.min(v >= 0).alias("is_non_negative"),
        (F.avg((v == 0).cast("int")) >= 0.3).alias("is_intermittent_like"),
    )


def histogram(df: DataFrame, keys: Keys, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value of each series."""
    v = F.col(value)
    bounds = df.filter(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    rows = df.filter(v.isNotNull())
    rows = rows.join(bounds, list(keys)) if keys else with_one_row(rows, bounds)
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    return (
        rows.groupBy(*keys, "_lo", "_hi", number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(*keys, "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"), "count")
    )


def box_stats(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Quartiles and extremes; exact, and no task holds a whole group."""
    probs = {"minimum": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "maximum": 1.0}
    return exact_quantiles(df, keys, value, probs)


def rolling_stats(df: DataFrame, keys: Keys, window: int, value: str = "value_filled") -> DataFrame:
    """Trailing mean and sample variance, null until half the window is there."""
    frame = W.partitionBy(*keys).orderBy("timestamp").rowsBetween(-(window - 1), 0)
    enough = F.count(value).over(frame) >= max(2, window // 2)
    return df.withColumn("rolling_mean", F.when(enough, F.avg(value).over(frame))).withColumn(
        "rolling_variance", F.when(enough, F.var_samp(value).over(frame))
    )


def decompose(prepared: DataFrame, keys: Keys, periods: Sequence[int], value: str = "value_filled") -> DataFrame:
    """Classical additive decomposition: centred moving average of the longest period, then phase means per period.

    Adds ``trend``, one ``seasonal_<p>`` per period and ``remainder``; the edges where the average is not full stay null.
    """
    series = W.partitionBy(*keys)
    ordered = series.orderBy("timestamp")
    longest = max(periods)
    half = longest // 2
    rows = prepared.withColumn("_pos", F.row_number().over(ordered))
    full = F.count(value).over(ordered.rowsBetween(-half, half)) == 2 * half + 1
    inner = F.sum(value).over(ordered.rowsBetween(-half, half))
    if longest % 2 == 0:
        ends = F.lag(value, half).over(ordered) + F.lead(value, half).over(ordered)
        average = (inner - 0.5 * ends) / longest
    else:
        average = inner / longest
    rows = rows.withColumn("trend", F.when(full, average))
    rows = rows.withColumn("remainder", F.col(value) - F.col("trend"))
    for p in sorted(periods):
        phase = W.partitionBy(*keys, F.pmod(F.col("_pos"), F.lit(p)))
        rows = rows.withColumn("_phase", F.avg("remainder").over(phase))
        rows = rows.withColumn(f"seasonal_{p}", F.col("_phase") - F.avg(F.when(F.col("remainder").isNotNull(), F.col("_phase"))).over(series))
        rows = rows.withColumn("remainder", F.col("remainder") - F.col(f"seasonal_{p}")).drop("_phase")
    return rows.drop("_pos")


def decomposition_strength(components: DataFrame, keys: Keys, periods: Sequence[int]) -> DataFrame:
    """``max(0, 1 - Var(R) / Var(C + R))`` for the trend, all seasons together and each season."""
    r = F.col("remainder")

    def strength(component: Column) -> Column:
        total = F.var_pop(F.when(r.isNotNull(), component + r))
        return F.when(total > 0, F.greatest(F.lit(0.0), 1 - F.var_pop(r) / total))

    seasons = [F.col(f"seasonal_{p}") for p in sorted(periods)]
    joint = seasons[0]
    for s in seasons[1:]:
        joint = joint + s
    return components.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) < 16, "insufficient_history")
        .when(F.count(F.lit(1)) < 2 * max(periods), "not_run")
        .otherwise("ok")
        .alias("decomposition_status"),
        strength(F.col("trend")).alias("trend_strength"),
        strength(joint).alias("seasonal_strength"),
        *[strength(F.col(f"seasonal_{p}")).alias(f"seasonal_strength_{p}") for p in sorted(periods)],
    )


def fitting_decomposition(prepared: DataFrame, keys: Keys, candidates: Sequence[int], fallback: int | None = None, most: int = 3) -> DataFrame:
    """Strengths per series, decomposed at the first ``most`` candidate periods that fit twice into it, else at the fallback.

    Series are parted by their number of rows, which decides the set of periods; each part is one plan over its own rows.
    ``decomposition_periods_used`` names the set.
    """
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rows = prepared.withColumn("_rows", n)
    edges = sorted({2 * c for c in candidates if c >= 2})
    columns = sorted({*candidates, *([fallback] if fallback else [])})
    out = None
    for low, high in zip([0, *edges], [*edges, None]):
        periods = tuple(c for c in candidates if c >= 2 and 2 * c <= low)[:most] or ((fallback,) if fallback else ())
        if not periods:
            continue
        part = rows.filter(F.col("_rows") >= low)
        part = (part if high is None else part.filter(F.col("_rows") < high)).drop("_rows")
        strengths = decomposition_strength(decompose(part, keys, periods), keys, periods)
        missing = {f"seasonal_strength_{p}": F.lit(None).cast("double") for p in columns if p not in periods}
        strengths = strengths.withColumns({**missing, "decomposition_periods_used": F.lit("|".join(map(str, sorted(periods))))})
        out = strengths if out is None else out.unionByName(strengths)
    if out is None:
        raise ValueError("no period of at least 2 and no fallback")
    return out


def level_shifts(prepared: DataFrame, keys: Keys, window: int = 14, min_points: int = 40, value: str = "value_filled") -> DataFrame:
    """Local maxima of the two-sided mean difference on ``log1p`` above ``max(log(n) * var, 1)``-scaled noise."""
    series = W.partitionBy(*keys)
    ordered = series.orderBy("timestamp")
    signal = F.log1p(F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)))
    rows = prepared.withColumn("_s", signal)
    before, after = ordered.rowsBetween(-window, -1), ordered.rowsBetween(0, window - 1)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(series)).withColumn("_var", F.var_pop("_s").over(series))
    full = (F.count("_s").over(before) == window) & (F.count("_s").over(after) == window)
    rows = rows.withColumn("shift", F.when(full, F.avg("_s").over(after) - F.avg("_s").over(before)))
    rows = rows.withColumn("_gain", F.col("shift") * F.col("shift") * window / 2)
    near = ordered.rowsBetween(-window, window)
    penalty = F.greatest(F.log(F.col("_n")) * F.col("_var"), F.lit(1.0))
    return rows.filter(F.col("_n") >= min_points).withColumn("_top", F.max("_gain").over(near)).filter(
        (F.col("_gain") == F.col("_top")) & (F.col("_gain") > penalty)
    ).select(*keys, "timestamp", "shift", F.lit("detected_level_shift").alias("label"))


# 5% critical values of the unit-root t-ratio with constant and of the level-stationarity statistic.
UNIT_ROOT_5 = -2.86
LEVEL_5 = 0.463


def stationarity(prepared: DataFrame, keys: Keys, lags: int = 4, value: str = "value_filled") -> DataFrame:
    """Dickey-Fuller t-ratio with fixed lags and the KPSS level statistic, combined into one assessment."""
    series = W.partitionBy(*keys)
    ordered = series.orderBy("timestamp")
    rows = prepared.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value))
    design = rows.withColumn("_dy", F.col("_v") - F.lag("_v").over(ordered)).withColumn("_y1", F.lag("_v").over(ordered))
    names = ["_y1"]
    for k in range(1, lags + 1):
        design = design.withColumn(f"_d{k}", F.lag("_dy", k).over(ordered))
        names.append(f"_d{k}")
    fit = fleet_ols(design, list(keys), names, "_dy").select(
        *keys, (F.get("coefficients", F.lit(1)) / F.get("standard_errors", F.lit(1))).alias("adf_statistic")
    )
    centred = rows.withColumn("_e", F.col("_v") - F.avg("_v").over(series)).withColumn(
        "_cum", F.sum("_e").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    )
    bandwidth = lags
    for k in range(1, bandwidth + 1):
        centred = centred.withColumn(f"_e{k}", F.lag("_e", k).over(ordered))
    sums = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.col("_cum") * F.col("_cum")).alias("_s2"),
        F.sum(F.col("_e") * F.col("_e")).alias("_g0"),
        *[F.sum(F.col("_e") * F.col(f"_e{k}")).alias(f"_g{k}") for k in range(1, bandwidth + 1)],
    )
    long_run = F.col("_g0") / F.col("n")
    for k in range(1, bandwidth + 1):
        long_run = long_run + F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) * (2.0 * (1 - k / (bandwidth + 1))) / F.col("n")
    level = sums.select(*keys, "n", F.when(long_run > 0, F.col("_s2") / (F.col("n") * F.col("n")) / long_run).alias("kpss_statistic"))
    both = level.join(fit, list(keys), "left")
    reject_root = F.col("adf_statistic") <= UNIT_ROOT_5
    reject_level = F.col("kpss_statistic") >= LEVEL_5
    ran_root, ran_level = F.col("adf_statistic").isNotNull(), F.col("kpss_statistic").isNotNull()
    assessment = (
        F.when(F.col("n") < 12, "insufficient_history")
        .when(~ran_root, "unknown")
        .when(~ran_level & reject_root, "screening_suggests_stationary")
        .when(~ran_level, "screening_suggests_nonstationary")
        .when(reject_root & ~reject_level, "screening_suggests_stationary")
        .when(~reject_root & reject_level, "screening_suggests_nonstationary")
        .otherwise("mixed_or_uncertain")
    )
    status = (
        F.when(F.col("n") < 12, "insufficient_history")
        .when(ran_root & ran_level, "ok")
        .when(ran_root, "partial")
        .otherwise("unavailable")
    )
    enough = F.col("n") >= 12
    return both.select(
        *keys,
        F.when(enough, F.col("adf_statistic")).alias("adf_statistic"),
        F.when(enough, F.col("kpss_statistic")).alias("kpss_statistic"),
        status.alias("stationarity_test_status"),
        assessment.alias("stationarity_assessment"),
    )
