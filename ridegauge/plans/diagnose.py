"""One-row diagnosis per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ridegauge.config import SeriesDiagnosisConfig
from ridegauge.operators import diagnosis as dg, timeindex as ti
from ridegauge.session import cut_lineage


def diagnose(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, config: SeriesDiagnosisConfig = SeriesDiagnosisConfig()
) -> DataFrame:
    """All diagnostics of a series joined on its key, plus the warning list."""
    keys = list(keys)
    candidates, fallback = config.candidate_periods, config.fallback_period
    collapsed = ti.collapse(df, keys, ts, value)
    series = cut_lineage(ti.prepare_series(df, keys, ts, value, config.frequency))  # read by every diagnostic
    spectrum = dg.periodogram(series, keys)
    peaks = dg.spectral_peaks(spectrum, keys, candidates)
    anomalies = dg.anomaly_centered(series, keys, config.anomaly_window, config.anomaly_threshold)
    shifts = dg.level_shifts(series, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("level_shift_count"), F.array_sort(F.collect_list("timestamp")).alias("level_shifts")
    )
    parts = [
        dg.baseline_screen(series, keys, candidates, fallback),
        dg.acf_summary(series, keys, candidates, fallback),
        dg.multi_season(peaks, keys, len(candidates)),
        dg.anomaly_summary(anomalies, keys),
        dg.distribution(series, keys),
        dg.fitting_decomposition(series, keys, candidates, fallback),
        dg.stationarity(series, keys),
        shifts,
    ]
    out = ti.index_summary(collapsed, series, keys)
    for part in parts:
        out = out.join(part, keys, "left")
    warnings = F.array(
        F.when(F.col("imputed_points") > 0, "Missing periods were filled before some diagnostics."),
        F.when(F.col("decomposition_status") != "ok", F.concat(F.lit("Decomposition: "), F.col("decomposition_status"))),
        F.when(F.col("stationarity_test_status") != "ok", "The stationarity screen did not run in full."),
    )
    return out.withColumn("level_shift_count", F.coalesce("level_shift_count", F.lit(0))).withColumn(
        "warnings", F.filter(warnings, lambda w: w.isNotNull())
    )
