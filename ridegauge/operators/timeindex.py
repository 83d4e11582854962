"""Cadence bookkeeping per series: collapse, regular grid, flags, interpolation, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.config import FREQUENCY_STEP
from ridegauge.operators.keyed import with_one_row

Keys = Sequence[str]


def _first_anchor(ts: Column, frequency: str) -> Column:
    """First grid point at or after ``ts``; hourly and daily grids start at ``ts`` itself."""
    if frequency == "weekly":
        return ts + F.make_dt_interval(F.pmod(7 - F.weekday(ts), F.lit(7)))
    if frequency in ("monthly", "quarterly"):
        unit = "month" if frequency == "monthly" else "quarter"
        floor = F.date_trunc(unit, ts).cast("timestamp_ntz")
        step = F.expr(FREQUENCY_STEP[frequency])
        return F.when(floor == ts, ts).otherwise(floor + step)
    return ts


def _on_grid(ts: Column, start: Column, frequency: str) -> Column:
    if frequency in ("monthly", "quarterly"):
        return F.date_trunc("month" if frequency == "monthly" else "quarter", ts).cast("timestamp_ntz") == ts
    seconds = {"hourly": 3600, "daily": 86400, "weekly": 7 * 86400}[frequency]
    elapsed = F.timestamp_diff("MICROSECOND", start, ts)
    return (ts >= start) & (elapsed % F.lit(seconds * 1_000_000) == 0)


def collapse(df: DataFrame, keys: Keys, ts: str, value: str) -> DataFrame:
    """One row per timestamp; duplicates add up, all-null stays null."""
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.col(ts).cast("timestamp_ntz").alias("timestamp"))
        .agg(F.sum(F.col(value).cast("double")).alias("observed_value"), F.count(F.lit(1)).alias("source_rows"))
    )


def regularize(collapsed: DataFrame, keys: Keys, frequency: str = "daily") -> DataFrame:
    """Full cadence grid between first and last timestamp.

    Each row also emits the empty periods up to its successor, so the grid needs one window per series and no join.
    """
    series = W.partitionBy(*keys)
    ordered = series.orderBy("timestamp")
    step = F.expr(FREQUENCY_STEP[frequency])
    bounded = collapsed.withColumn("_min", F.min("timestamp").over(series)).withColumn(
        "_max", F.max("timestamp").over(series)
    )
    start = _first_anchor(F.col("_min"), frequency)
    placed = bounded.withColumn("_start", start).withColumn(
        "_on", _on_grid(F.col("timestamp"), F.col("_start"), frequency)
    )
    # A series without any observation on the grid still has one; its first row carries it.
    carrier = ~F.max("_on").over(series) & (F.col("timestamp") == F.col("_min"))
    rows = placed.withColumn("_carrier", carrier).filter("_on OR _carrier")
    rows = rows.withColumn("_prev", F.lag("timestamp").over(ordered)).withColumn(
        "_next", F.lead("timestamp").over(ordered)
    )
    first = F.when(F.col("_prev").isNull(), F.col("_start")).otherwise(F.col("timestamp"))
    last = F.when(F.col("_next").isNull(), F.col("_max")).otherwise(F.col("_next") - step)
    grid = rows.withColumn("_slot", F.explode(F.sequence(first, F.greatest(first, last), step)))
    grid = grid.filter(F.col("_slot") <= F.col("_max"))
    here = F.col("_slot") == F.col("timestamp")
    return grid.select(
        *keys,
        F.col("_slot").alias("timestamp"),
        F.when(here, F.col("observed_value")).alias("observed_value"),
        here.alias("present"),
    )


def flag(grid: DataFrame) -> DataFrame:
    missing_value = F.col("observed_value").isNull()
    return grid.select(
        "*",
        (~F.col("present")).cast("int").alias("missing_period_flag"),
        (F.col("present") & missing_value).cast("int").alias("missing_observation_flag"),
        (~missing_value).cast("int").alias("observed_value_flag"),
        missing_value.cast("int").alias("imputed_flag"),
        F.when(missing_value, "imputed").otherwise("observed").alias("value_source"),
    ).drop("present")


def interpolate(df: DataFrame, keys: Keys, ts: str = "timestamp", value: str = "observed_value") -> DataFrame:
    """Linear by position inside, nearest value at the edges, 0 for an empty series."""
    ordered = W.partitionBy(*keys).orderBy(ts)
    back = ordered.rowsBetween(W.unboundedPreceding, 0)
    ahead = ordered.rowsBetween(0, W.unboundedFollowing)
    pos = df.withColumn("_pos", F.row_number().over(ordered))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(value).alias("v")))
    around = pos.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn(
        "_b", F.first(known, ignorenulls=True).over(ahead)
    )
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("_pos") - a["p"]) / (b["p"] - a["p"])
    filled = F.coalesce(F.col(value), F.when(a.isNotNull() & b.isNotNull(), between), a["v"], b["v"], F.lit(0.0))
    return around.withColumn("value_filled", filled).drop("_pos", "_a", "_b")


def prepare_series(df: DataFrame, keys: Keys, ts: str, value: str, frequency: str = "daily") -> DataFrame:
    """Collapse, regular grid, flags and fill in one chain; a single shuffle by series after the collapse."""
    out = interpolate(flag(regularize(collapse(df, keys, ts, value), keys, frequency)), keys)
    return out.withColumn("imputed_value", F.when(F.col("imputed_flag") == 1, F.col("value_filled")))


def gap_table(prepared: DataFrame, keys: Keys) -> DataFrame:
    ordered = W.partitionBy(*keys).orderBy("timestamp")
    missing = prepared.withColumn("_pos", F.row_number().over(ordered)).filter("missing_period_flag = 1")
    island = missing.withColumn("_gap", F.col("_pos") - F.row_number().over(ordered))
    return (
        island.groupBy(*keys, "_gap")
        .agg(
            F.min("timestamp").alias("gap_start"),
            F.max("timestamp").alias("gap_end"),
            F.count(F.lit(1)).alias("missing_periods"),
        )
        .drop("_gap")
    )


def gap_distribution(gaps: DataFrame, keys: Keys) -> DataFrame:
    return gaps.groupBy(*keys, "missing_periods").agg(F.count(F.lit(1)).alias("gap_count"))


def _spacing(collapsed: DataFrame, keys: Keys) -> DataFrame:
    ordered = W.partitionBy(*keys).orderBy("timestamp")
    return collapsed.withColumn(
        "_step", F.timestamp_diff("SECOND", F.lag("timestamp").over(ordered), F.col("timestamp"))
    )


def index_summary(collapsed: DataFrame, prepared: DataFrame, keys: Keys) -> DataFrame:
    """One row per series: counts, span, imputed share and spacing."""
    source = _spacing(collapsed, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("source_rows").alias("original_row_count"),
        (F.sum("source_rows") - F.count(F.lit(1))).alias("duplicate_timestamps"),
        F.greatest(F.count_distinct("_step") - 1, F.lit(0)).alias("irregular_spacing_count"),
    )
    grid = prepared.groupBy(*keys).agg(
        F.sum("missing_period_flag").alias("missing_periods"),
        F.sum("missing_observation_flag").alias("missing_observations"),
        F.sum("observed_value_flag").alias("observed_points"),
        F.sum("imputed_flag").alias("imputed_points"),
        F.avg("imputed_flag").alias("imputed_share"),
        F.min("timestamp").alias("timestamp_start"),
        F.max("timestamp").alias("timestamp_end"),
    )
    if keys:
        joined = source.join(grid, list(keys))
    else:
        joined = with_one_row(source, grid)
    return joined.withColumn("time_index_reliable", F.col("irregular_spacing_count") == 0)


def infer_frequency(collapsed: DataFrame, keys: Keys) -> DataFrame:
    """Most common spacing, named when it is a known cadence."""
    step = F.mode("_step", deterministic=True)
    day = 86400
    label = (
        F.when(F.col("step_seconds") == 3600, "hourly")
        .when(F.col("step_seconds") == day, "daily")
        .when(F.col("step_seconds") == 7 * day, "weekly")
        .when(F.col("step_seconds").between(28 * day, 31 * day), "monthly")
        .when(F.col("step_seconds").between(90 * day, 92 * day), "quarterly")
    )
    return (
        _spacing(collapsed, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), step.alias("step_seconds"))
        .withColumn("inferred_frequency", F.when(F.col("n") >= 3, label))
        .drop("n")
    )
