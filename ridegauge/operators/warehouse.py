"""Segmented aggregates, feature store, registries and monitoring tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.config import FREQUENCY_STEP
from ridegauge.operators.keyed import global_rank, per_date
from ridegauge.session import cut_lineage

GRAIN_UNIT = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter"}
SEGMENT = ["segment_type", "segment_id"]


def _bucket(ts: Column, grain: str) -> Column:
    return F.date_trunc(GRAIN_UNIT[grain], ts).cast("timestamp_ntz")


def aggregate(
    trips: DataFrame, grain: str, start: str = "start_time", station: str = "start_station", bike: str = "bike_id",
    duration: str = "duration_minutes",
) -> DataFrame:
    """Trips, distinct bikes and mean duration per bucket for the network and for each start station.

    The fact is scanned and shuffled once, to (bucket, station, bike); both segment levels come from that table, and
    distinct bikes are counts of its rows.
    """
    fine = trips.groupBy(
        _bucket(F.col(start), grain).alias("bucket_start"), F.col(station).cast("string").alias("_station"),
        F.col(bike).alias("_bike"),
    ).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(duration).alias("_sum"), F.count(duration).alias("_timed")
    )
    levels = F.array(
        F.struct(F.lit("system_total").alias("segment_type"), F.lit("all").alias("segment_id")),
        F.struct(F.lit("start_station").alias("segment_type"), F.col("_station").alias("segment_id")),
    )
    # A bike may visit many stations, so it is counted once per (bucket, segment) before the final roll-up.
    per_bike = fine.select("*", F.inline(levels)).groupBy("bucket_start", *SEGMENT, "_bike").agg(
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.sum("_timed").alias("_timed")
    )
    step = F.expr(FREQUENCY_STEP[grain])
    return per_bike.groupBy("bucket_start", *SEGMENT).agg(
        F.sum("_n").alias("trip_count"),
        F.count("_bike").alias("distinct_bikes"),
        (F.sum("_sum") / F.sum("_timed")).alias("avg_duration_minutes"),
    ).select(
        "bucket_start", *SEGMENT, (F.col("bucket_start") + step).alias("bucket_end"), "trip_count", "distinct_bikes",
        "avg_duration_minutes",
    )


def complete_buckets(agg: DataFrame, grain: str) -> DataFrame:
    """Every bucket between the first and last of a segment; new buckets count zero trips and are flagged."""
    step = F.expr(FREQUENCY_STEP[grain])
    nxt = F.lead("bucket_start").over(W.partitionBy(*SEGMENT).orderBy("bucket_start"))
    rows = agg.withColumn("_next", nxt)
    last = F.coalesce(F.col("_next") - step, F.col("bucket_start"))
    grid = rows.withColumn("_slot", F.explode(F.sequence(F.col("bucket_start"), last, step)))
    here = F.col("_slot") == F.col("bucket_start")
    return grid.select(
        F.col("_slot").alias("bucket_start"),
        *SEGMENT,
        (F.col("_slot") + step).alias("bucket_end"),
        F.when(here, F.col("trip_count")).otherwise(0).alias("trip_count"),
        F.when(here, F.col("distinct_bikes")).otherwise(0).alias("distinct_bikes"),
        F.when(here, F.col("avg_duration_minutes")).alias("avg_duration_minutes"),
        here.alias("is_observed"),
        (~here).alias("missing_period_flag"),
    )


def roll_up(agg: DataFrame, grain: str) -> DataFrame:
    """Coarser grain from a finer one: counts add, durations average by trips; distinct bikes need the fact."""
    step = F.expr(FREQUENCY_STEP[grain])
    weighted = F.when(F.col("avg_duration_minutes").isNotNull(), F.col("trip_count"))
    return (
        agg.groupBy(_bucket(F.col("bucket_start"), grain).alias("bucket_start"), *SEGMENT)
        .agg(
            F.sum("trip_count").alias("trip_count"),
            (F.sum(F.col("avg_duration_minutes") * weighted) / F.sum(weighted)).alias("avg_duration_minutes"),
        )
        .withColumn("bucket_end", F.col("bucket_start") + step)
    )


def feature_store(
    features: DataFrame, phases: Sequence[tuple[str, str | None, str | None]], keys: Sequence[str] = (*SEGMENT, "bucket_start"),
    target: str = "trip_count", complete: Sequence[str] | None = None,
) -> DataFrame:
    """Key, target, phase label by date range, completeness flag and the features as JSON."""
    payload = [c for c in features.columns if c not in (*keys, target)]
    label = F
    for name, start, end in phases:
        inside = F.lit(True)
        if start:
            inside = inside & (F.col("bucket_start") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            inside = inside & (F.col("bucket_start") < F.lit(end).cast("timestamp_ntz"))
        label = label.when(inside, F.lit(name))
    whole = F.lit(True)
    for c in complete if complete is not None else payload:
        whole = whole & F.col(c).isNotNull()
    return features.select(
        *keys,
        F.col(target).cast("double").alias("target_trip_count"),
        label.otherwise(F.lit(None).cast("string")).alias("pandemic_phase"),
        whole.alias("completeness_flag"),
        F.to_json(F.struct(*payload)).alias("feature_payload"),
    )


def modeling_registry(panel: DataFrame, recent_days: int = 90, min_observed: int = 365, max_zero_share: float = 0.8) -> DataFrame:
    """Volume, sparsity and modelling strategy per station.

    Ranks come from the sorted distinct totals, so stations never pass through one window.
    """
    last = panel.agg(F.max("date").alias("d")).scalar()
    rows = panel.withColumn("_last", last)
    t = F.when(F.col("in_service"), F.col("target"))
    recent = F.when(F.col("date") > F.date_sub("_last", recent_days), t)
    facts = rows.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(t).alias("observed_rows"),
        F.coalesce(F.sum(t), F.lit(0.0)).alias("total_trip_count"),
        F.avg(t).alias("average_trip_count"),
        F.avg((t == 0).cast("int")).alias("zero_share"),
        F.coalesce(F.sum(recent), F.lit(0.0)).alias("_recent"),
    )
    facts = cut_lineage(facts)
    sizes = facts.groupBy("total_trip_count").agg(F.count(F.lit(1)).alias("_c"), (-F.col("total_trip_count")).alias("_neg"))
    ordered = global_rank(sizes, ["_neg"], "_pos")
    # Competition rank = 1 + stations with a strictly larger total: a running sum over blocks of the sorted totals.
    block = F.floor((F.col("_pos") - 1) / 4096)
    blocks = ordered.groupBy(block.alias("_blk")).agg(F.sum("_c").alias("_bc"))
    before = blocks.select(
        "_blk", F.coalesce(F.sum("_bc").over(W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off")
    )  # one row per 4096 distinct totals
    in_block = W.partitionBy("_blk").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    ranks = ordered.withColumn("_blk", block).join(F.broadcast(before), "_blk").select(
        "total_trip_count", (F.col("_off") + F.coalesce(F.sum("_c").over(in_block), F.lit(0)) + 1).alias("volume_rank")
    )
    out = facts.join(ranks, "total_trip_count")
    n = facts.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.col("volume_rank") / F.col("_n")
    enough, dense = F.col("observed_rows") >= min_observed, F.coalesce(F.col("zero_share") <= max_zero_share, F.lit(False))
    return out.withColumn("_n", n).select(
        "station_id", "row_count", "observed_rows", "total_trip_count", "average_trip_count", "zero_share", "volume_rank",
        F.when(place <= 0.2, "high").when(place <= 0.6, "medium").otherwise("low").alias("volume_tier"),
        (enough & dense).alias("direct_modeling_eligible"),
        F.when(enough & dense, "direct").otherwise("reconciled_share").alias("modeling_strategy"),
        F.when(~enough, "short_history").when(~dense, "mostly_zero").otherwise("forecastable").alias("forecastability_reason"),
        F.when(F.col("total_trip_count") > 0, F.col("_recent") / F.col("total_trip_count")).alias("recent_share"),
    )


def split_metadata(rows: DataFrame, keys: Sequence[str], role: str = "role") -> DataFrame:
    return rows.groupBy(*keys, F.col(role).alias("window_role")).agg(
        F.min("date").alias("window_start"), F.max("date").alias("window_end"), F.count(F.lit(1)).alias("row_count")
    )


def backtest_results(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Full metric row per group; interval metrics appear for the levels whose bounds are present."""
    a, p = F.col("actual"), F.col("prediction")
    e = F.abs(p - a)
    out = [
        F.avg(e).alias("mae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.avg(F.when(a != 0, e / F.abs(a))).alias("mape"),
        F.avg(F.when(F.abs(a) + F.abs(p) > 0, 2 * e / (F.abs(a) + F.abs(p))).otherwise(F.lit(0.0))).alias("smape"),
        F.avg(e / F.col("mase_scale")).alias("mase"),
        F.avg(p - a).alias("bias"),
        F.count("actual").alias("holdout_rows"),
        F.avg(e / 2).alias("pinball_50"),
    ]
    for level in (80, 95):
        low, high = F.col(f"lower_{level}"), F.col(f"upper_{level}")
        if f"lower_{level}" not in scored.columns:
            continue
        tail = (1 - level / 100) / 2
        loss = lambda q, b: F.greatest(q * (a - b), (q - 1) * (a - b))
        out += [
            F.avg((loss(tail, low) + loss(1 - tail, high)) / 2).alias(f"pinball_{level}"),
            F.avg(((a >= low) & (a <= high)).cast("double")).alias(f"coverage_{level}"),
            F.avg(high - low).alias(f"width_{level}"),
        ]
    return scored.groupBy(*by).agg(*out)


def forecast_intervals(forecasts: DataFrame, key: str = "forecast_id", levels: Sequence[int] = (80, 95)) -> DataFrame:
    """Wide bounds to one row per level."""
    cells = [
        F.struct(
            F.lit(n).alias("interval_level"), F.col(f"lower_{n}").alias("lower_bound"), F.col(f"upper_{n}").alias("upper_bound")
        )
        for n in levels
    ]
    return forecasts.select(key, F.inline(F.array(*cells)))


def champions(metrics: DataFrame, by: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Best model per group by a weighted sum of metrics; ties go to the model name."""
    weights = weights or {"mean_mase": 0.7, "mean_rmse": 0.3}
    score = None
    for name, weight in weights.items():
        term = F.col(name) * weight
        score = term if score is None else score + term
    return (
        metrics.withColumn("composite_score", score)
        .groupBy(*by)
        .agg(F.min_by(F.struct("model_name", "composite_score"), F.struct("composite_score", "model_name")).alias("_b"))
        .select(*by, "_b.model_name", "_b.composite_score")
    )


def reconcile(total: DataFrame, stations: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Scale station forecasts so that each date adds up to the direct total.

    Stations without a forecast (``shares``: ``station_id, share``) receive the remainder by share first. Date totals are
    a grouped sum joined back, so one date with all stations is never a single window group.
    """
    totals = total.select("date", F.col("prediction").alias("_total"))
    rows = stations.select("date", "station_id", "prediction", F.lit(True).alias("modelled"))
    sums = rows.groupBy("date").agg(F.sum("prediction").alias("_sum"))
    if shares is not None:
        left = totals.join(sums, "date", "left").select(
            "date", F.greatest(F.col("_total") - F.coalesce("_sum", F.lit(0.0)), F.lit(0.0)).alias("_rest")
        )
        dates = left.agg(F.collect_list(F.struct("date", "_rest")).alias("d"))  # one entry per forecast day
        spread = shares.withColumn("_d", dates.scalar()).select("station_id", "share", F.inline("_d")).select(
            "date", "station_id", (F.col("_rest") * F.col("share")).alias("prediction"), F.lit(False).alias("modelled")
        )
        rows = rows.unionByName(spread)
        sums = rows.groupBy("date").agg(F.sum("prediction").alias("_sum"))
    ratio = F.when(F.col("_sum") > 0, F.col("_total") / F.col("_sum"))
    factors = totals.join(sums, "date").select("date", ratio.alias("reconciliation_ratio"))
    return rows.join(per_date(factors), "date").withColumn(
        "reconciled", F.col("prediction") * F.coalesce("reconciliation_ratio", F.lit(1.0))
    )


def drift(df: DataFrame, keys: Sequence[str], recent_days: int = 90, bins: int = 10) -> DataFrame:
    """Recent against reference window: means, relative shift and population stability index over fixed bins."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(
        F.max("date").alias("_last"), F.min("target").alias("_lo"), F.max("target").alias("_hi")
    )
    rows = df.join(ends, keys).withColumn("_recent", F.col("date") > F.date_sub("_last", recent_days))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col("target") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = rows.groupBy(*keys, number.cast("int").alias("bin")).agg(
        F.sum(F.col("_recent").cast("long")).alias("r"),
        F.sum((~F.col("_recent")).cast("long")).alias("b"),
        F.sum(F.when(F.col("_recent"), F.col("target"))).alias("rs"),
        F.sum(F.when(~F.col("_recent"), F.col("target"))).alias("bs"),
    )
    part = W.partitionBy(*keys)
    share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(part) + 0.5 * bins)
    scored = binned.withColumn("_p", share("r")).withColumn("_q", share("b"))
    return scored.groupBy(*keys).agg(
        (F.sum("rs") / F.sum("r")).alias("recent_mean"),
        (F.sum("bs") / F.sum("b")).alias("reference_mean"),
        F.sum((F.col("_p") - F.col("_q")) * F.log(F.col("_p") / F.col("_q"))).alias("psi"),
    ).withColumn("mean_shift", F.col("recent_mean") / F.col("reference_mean") - 1)


def quality(agg: DataFrame) -> DataFrame:
    """Named checks over a segmented aggregate: value and status."""
    one = agg.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("missing_period_flag").cast("int")).alias("missing"),
        F.sum((F.col("trip_count") < 0).cast("int")).alias("negative"),
        F.sum((F.col("is_observed") & F.col("avg_duration_minutes").isNull()).cast("int")).alias("untimed"),
    )
    missing_share = F.col("missing") / F.col("rows")
    check = lambda name, value, bad: F.struct(
        F.lit(name).alias("check_name"), value.cast("double").alias("check_value"),
        F.when(bad, "warn").otherwise("pass").alias("status"),
    )
    return one.select(
        F.inline(
            F.array(
                check("row_count", F.col("rows"), F.col("rows") == 0),
                check("missing_period_share", missing_share, missing_share > 0.2),
                check("negative_trip_counts", F.col("negative"), F.col("negative") > 0),
                check("buckets_without_duration", F.col("untimed"), F.col("untimed") > 0),
            )
        )
    )


def with_forecast_id(forecasts: DataFrame, parts: Sequence[str], name: str = "forecast_id") -> DataFrame:
    """Deterministic id from the identifying columns."""
    return forecasts.withColumn(name, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256))


def forecast_outputs(forecasts: DataFrame, windows: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Forecast rows with ids and the bounds of the window they were trained on."""
    bounds = windows.select(*keys, F.col("train_start").alias("training_window_start"), F.col("train_end").alias("training_window_end"))
    return with_forecast_id(forecasts, parts).join(bounds, list(keys), "left")


def run_log(raw: DataFrame, clean: DataFrame, run_id: str, start: str = "start_time") -> DataFrame:
    """One row describing a run."""
    ingested = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return clean.agg(
        F.count(F.lit(1)).alias("records_cleaned"), F.min(start).alias("min_event_timestamp"), F.max(start).alias("max_event_timestamp")
    ).select(
        F.lit(run_id).alias("pipeline_run_id"), ingested.alias("records_ingested"), "records_cleaned", "min_event_timestamp",
        "max_event_timestamp", F.when(F.col("records_cleaned") > 0, "success").otherwise("empty").alias("status"),
    )


# Family and note by model or implementation.
FAMILY = {
    "naive": "baseline", "seasonal_naive_7": "baseline", "seasonal_naive_30": "baseline", "ets": "classical",
    "seasonal_difference_regression": "classical", "fourier_dynamic_regression": "classical", "gbt": "ml",
}
NOTES = {
    "naive": "Repeats the last value.",
    "seasonal_naive_7": "Repeats the last week.",
}


def model_registry(forecasts: DataFrame, tuned: bool = False, scope: str = "station_level") -> DataFrame:
    """One row per (model, implementation) that produced forecasts."""
    pick = lambda table, default: F.coalesce(
        *[F.when(F.col("model_name") == k, F.lit(v)) for k, v in table.items()], F.lit(default)
    )
    rows = forecasts.withColumn("implementation", F.coalesce("implementation", "model_name"))
    return rows.select("model_name", "implementation").distinct().select(
        "model_name", "implementation", F.lit(scope).alias("scope"), pick(FAMILY, "ml").alias("family"),
        F.lit(tuned).alias("tuned"), F.lit(False).alias("experimental"), pick(NOTES, "").alias("note"),
    )
