"""Time index and per-series diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge.catalog.base import NUDGE, query, rounded
from ridegauge.config import SeriesDiagnosisConfig
from ridegauge.operators import changepoints as cp, diagnosis as dg, timeindex as ti
from ridegauge.plans.bindings import bind, table
from ridegauge.plans.diagnose import diagnose

KEYS = ["series_id"]
CANDIDATES = (7, 30, 365)
ORDER_VALUES = """
SELECT o_orderpriority AS series_id, o_orderdate AS timestamp,
       CASE WHEN day(o_orderdate) = 13 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS v
FROM orders
"""
COL = f"src AS ({ORDER_VALUES}), col AS (SELECT series_id, timestamp, sum(v) AS observed_value, count(*) AS source_rows FROM src GROUP BY 1, 2)"
PREP = f"""{COL}, grid AS (SELECT series_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 DAY)) AS timestamp FROM col GROUP BY 1),
 j AS (SELECT g.series_id, g.timestamp, c.observed_value, c.source_rows IS NOT NULL AS present, row_number() OVER (PARTITION BY g.series_id ORDER BY g.timestamp) AS pos
   FROM grid g LEFT JOIN col c ON g.series_id = c.series_id AND g.timestamp = c.timestamp),
 k AS (SELECT *, last_value(CASE WHEN observed_value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS ap, last_value(observed_value IGNORE NULLS) OVER b AS av,
   first_value(CASE WHEN observed_value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS bp, first_value(observed_value IGNORE NULLS) OVER a AS bv FROM j
   WINDOW b AS (PARTITION BY series_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING),
          a AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 prep AS (SELECT series_id, timestamp, observed_value, pos, CASE WHEN present THEN 0 ELSE 1 END AS missing_period_flag,
   CASE WHEN present AND observed_value IS NULL THEN 1 ELSE 0 END AS missing_observation_flag, CASE WHEN observed_value IS NULL THEN 0 ELSE 1 END AS observed_value_flag,
   CASE WHEN observed_value IS NULL THEN 1 ELSE 0 END AS imputed_flag, CASE WHEN observed_value IS NULL THEN 'imputed' ELSE 'observed' END AS value_source,
   coalesce(observed_value, CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN av + (bv - av) * (pos - ap) / (bp - ap) END, av, bv, 0) AS value_filled FROM k)"""
HOUR_COL = "hcol AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp, sum(value) AS observed_value FROM events GROUP BY 1, 2)"


def source(spark, sf):
    return bind(spark, sf, ORDER_VALUES)


def collapsed(spark, sf):
    return ti.collapse(source(spark, sf), KEYS, "timestamp", "v")


def prepared(spark, sf):
    return ti.prepare_series(source(spark, sf), KEYS, "timestamp", "v")


def hourly(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp"), "value"
    )
    return ti.prepare_series(rows, KEYS, "timestamp", "value", "hourly")


@query("h01_collapse", f"WITH {COL} SELECT series_id, timestamp, round(observed_value, 6) AS observed_value, source_rows FROM col")
def _(spark, sf):
    return rounded(collapsed(spark, sf))


@query("h02_regular_grid_daily", f"WITH {PREP} SELECT series_id, timestamp, round(observed_value, 6) AS observed_value, present FROM j")
def _(spark, sf):
    return rounded(ti.regularize(collapsed(spark, sf), KEYS, "daily"))


for _freq, _start, _end, _step in (
    ("weekly", "min(timestamp) + to_days(CAST((8 - isodow(min(timestamp))) % 7 AS INT))", "max(timestamp)", "INTERVAL 7 DAY"),
    ("monthly", "CASE WHEN day(min(timestamp)) = 1 THEN min(timestamp) ELSE date_trunc('month', min(timestamp)) + INTERVAL 1 MONTH END", "max(timestamp)", "INTERVAL 1 MONTH"),
    ("quarterly", "CASE WHEN date_trunc('quarter', min(timestamp)) = min(timestamp) THEN min(timestamp) ELSE date_trunc('quarter', min(timestamp)) + INTERVAL 3 MONTH END", "max(timestamp)", "INTERVAL 3 MONTH"),
):

    def _make(freq):
        return lambda spark, sf: rounded(ti.regularize(collapsed(spark, sf), KEYS, freq))

    query(
        f"h02_regular_grid_{_freq}",
        f"""WITH {COL}, grid AS (SELECT series_id, unnest(generate_series(CAST({_start} AS TIMESTAMP), {_end}, {_step})) AS timestamp FROM col GROUP BY 1)
        SELECT g.series_id, g.timestamp, round(c.observed_value, 6) AS observed_value, c.source_rows IS NOT NULL AS present
        FROM grid g LEFT JOIN col c ON g.series_id = c.series_id AND g.timestamp = c.timestamp""",
    )(_make(_freq))


@query(
    "h03_h04_prepared_series",
    f"""WITH {PREP} SELECT series_id, timestamp, round(observed_value, 6) AS observed_value, missing_period_flag, missing_observation_flag, observed_value_flag, imputed_flag, value_source,
    round(value_filled, 6) AS value_filled, CASE WHEN imputed_flag = 1 THEN round(value_filled, 6) END AS imputed_value FROM prep""",
)
def _(spark, sf):
    return rounded(prepared(spark, sf))


GAPS = """m AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS g FROM prep WHERE missing_period_flag = 1),
 gaps AS (SELECT series_id, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) AS missing_periods FROM m GROUP BY series_id, g)"""


@query("h05_gap_table", f"WITH {PREP}, {GAPS} SELECT * FROM gaps")
def _(spark, sf):
    return ti.gap_table(prepared(spark, sf), KEYS)


@query("h06_gap_distribution", f"WITH {PREP}, {GAPS} SELECT series_id, missing_periods, count(*) AS gap_count FROM gaps GROUP BY 1, 2")
def _(spark, sf):
    return ti.gap_distribution(ti.gap_table(prepared(spark, sf), KEYS), KEYS)


@query(
    "h07_index_summary",
    f"""WITH {PREP}, d AS (SELECT series_id, source_rows, timestamp - lag(timestamp) OVER (PARTITION BY series_id ORDER BY timestamp) AS step FROM col),
    s AS (SELECT series_id, count(*) AS row_count, sum(source_rows) AS original_row_count, sum(source_rows) - count(*) AS duplicate_timestamps,
      greatest(count(DISTINCT step) - 1, 0) AS irregular_spacing_count FROM d GROUP BY 1),
    g AS (SELECT series_id, sum(missing_period_flag) AS missing_periods, sum(missing_observation_flag) AS missing_observations, sum(observed_value_flag) AS observed_points,
      sum(imputed_flag) AS imputed_points, round(avg(imputed_flag), 6) AS imputed_share, min(timestamp) AS timestamp_start, max(timestamp) AS timestamp_end FROM prep GROUP BY 1)
    SELECT *, irregular_spacing_count = 0 AS time_index_reliable FROM s JOIN g USING (series_id)""",
)
def _(spark, sf):
    return rounded(ti.index_summary(collapsed(spark, sf), prepared(spark, sf), KEYS))


@query(
    "h08_infer_frequency",
    f"""WITH {COL}, {HOUR_COL}, a AS (SELECT series_id, timestamp FROM col UNION ALL SELECT series_id, timestamp FROM hcol),
    d AS (SELECT series_id, date_diff('second', lag(timestamp) OVER (PARTITION BY series_id ORDER BY timestamp), timestamp) AS step FROM a),
    f AS (SELECT series_id, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, step) = 1)
    SELECT series_id, step AS step_seconds, CASE step WHEN 3600 THEN 'hourly' WHEN 86400 THEN 'daily' END AS inferred_frequency FROM f""",
)
def _(spark, sf):
    hours = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp"), "value"
    )
    both = collapsed(spark, sf).unionByName(ti.collapse(hours, KEYS, "timestamp", "value"))
    return ti.infer_frequency(both, KEYS)


@query(
    "h09_primary_period",
    f"WITH {PREP} SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 4810 THEN 2405 WHEN count(*) >= 730 THEN 365 WHEN count(*) >= 14 THEN 7 END AS primary_period FROM prep GROUP BY 1",
)
def _(spark, sf):
    per = prepared(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("primary_period", dg.primary_period(F.col("n"), (2405, 365), 7))


SCREEN = """e AS (SELECT series_id, abs(value_filled - lag(value_filled) OVER w) AS a, abs(value_filled - lag(value_filled, 7) OVER w) AS b FROM prep
  WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)), sc AS (SELECT series_id, avg(a) AS a, avg(b) AS b FROM e GROUP BY 1)"""


@query(
    "h10_baseline_screen",
    f"""WITH {PREP}, {SCREEN} SELECT series_id, 7 AS season_length, round(a, 6) AS baseline_screening_naive_mae, round(b, 6) AS baseline_screening_seasonal_naive_mae,
    round((a - b) / a, 6) AS baseline_screening_seasonal_gain, 'in_sample_screening_only' AS baseline_screening_scope FROM sc""",
)
def _(spark, sf):
    return rounded(dg.baseline_screen(prepared(spark, sf), KEYS, CANDIDATES))


@query(
    "h10_baseline_table",
    f"""WITH {PREP}, {SCREEN} SELECT series_id, 'naive' AS baseline_name, round(a, 6) AS mae, CAST(NULL AS INT) AS season_length, 'screening_only_in_sample' AS diagnostic_scope FROM sc
    UNION ALL SELECT series_id, 'seasonal_naive', round(b, 6), 7, 'screening_only_in_sample' FROM sc""",
)
def _(spark, sf):
    return rounded(dg.baseline_table(dg.baseline_screen(prepared(spark, sf), KEYS, CANDIDATES), KEYS))


PROFILE = "round(avg(observed_value), 6) AS average_observed_value, round(avg(value_filled), 6) AS average_filled_value, count(observed_value) AS observed_points, sum(imputed_flag) AS imputed_points"


@query("h11_weekday_profile", f"WITH {PREP} SELECT series_id, dayname(timestamp) AS weekday, isodow(timestamp) - 1 AS weekday_order, {PROFILE} FROM prep GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(dg.weekday_profile(prepared(spark, sf), KEYS))


@query("h12_month_profile", f"WITH {PREP} SELECT series_id, monthname(timestamp) AS month, month(timestamp) AS month_order, {PROFILE} FROM prep GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(dg.month_profile(prepared(spark, sf), KEYS))


HPREP = PREP.replace(COL, HOUR_COL.replace("hcol", "col").replace("AS observed_value", "AS observed_value, count(*) AS source_rows")).replace("INTERVAL 1 DAY", "INTERVAL 1 HOUR")


@query(
    "h13_intraday_profile",
    f"WITH {HPREP} SELECT series_id, CASE WHEN isodow(timestamp) >= 6 THEN 'weekend' ELSE 'weekday' END AS weekend, hour(timestamp) AS hour, {PROFILE} FROM prep GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return rounded(dg.intraday_profile(hourly(spark, sf), KEYS))


@query(
    "h15_acf_summary",
    f"""WITH {PREP}, l AS (SELECT series_id, value_filled AS v, lag(value_filled) OVER w AS a, lag(value_filled, 2) OVER w AS b, lag(value_filled, 7) OVER w AS c FROM prep
      WINDOW w AS (PARTITION BY series_id ORDER BY timestamp))
    SELECT series_id, 'ok' AS autocorrelation_status, round(corr(v, a), 6) AS lag1_autocorrelation, round(corr(v, b), 6) AS lag2_autocorrelation, round(corr(v, c), 6) AS seasonal_lag_autocorrelation
    FROM l GROUP BY 1""",
)
def _(spark, sf):
    return rounded(dg.acf_summary(prepared(spark, sf), KEYS, CANDIDATES))


@query(
    "h16_acf",
    f"""WITH {PREP}, c AS (SELECT series_id, pos, value_filled - avg(value_filled) OVER (PARTITION BY series_id) AS d FROM prep),
    z AS (SELECT series_id, sum(d * d) AS z FROM c GROUP BY 1)
    SELECT a.series_id, a.pos - b.pos AS lag, round(sum(a.d * b.d) / any_value(z), 6) AS acf FROM c a JOIN c b ON a.series_id = b.series_id AND a.pos - b.pos BETWEEN 0 AND {SeriesDiagnosisConfig().max_acf_lag}
    JOIN z ON a.series_id = z.series_id GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(dg.acf(prepared(spark, sf), KEYS, SeriesDiagnosisConfig().max_acf_lag))


@query(
    "h16_acf_all_lags",
    f"""WITH {PREP}, c AS (SELECT series_id, pos, value_filled - avg(value_filled) OVER (PARTITION BY series_id) AS d FROM prep),
    z AS (SELECT series_id, sum(d * d) AS z FROM c GROUP BY 1)
    SELECT a.series_id, a.pos - b.pos AS lag, round(sum(a.d * b.d) / any_value(z), 6) AS acf FROM c a JOIN c b ON a.series_id = b.series_id AND a.pos - b.pos BETWEEN 0 AND {SeriesDiagnosisConfig().max_acf_lag}
    JOIN z ON a.series_id = z.series_id GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(dg.acf(prepared(spark, sf), KEYS, SeriesDiagnosisConfig().max_acf_lag))


@query("h16_pacf")
def _(spark, sf):
    return rounded(dg.pacf(dg.acf(prepared(spark, sf), KEYS, SeriesDiagnosisConfig().max_acf_lag), KEYS))


@query(
    "h17_periodogram",
    f"""WITH {PREP}, r AS (SELECT series_id, regr_slope(value_filled, pos) AS s, regr_intercept(value_filled, pos) AS i, count(*) AS n FROM prep GROUP BY 1),
    y AS (SELECT p.series_id, pos, n, value_filled - i - s * pos AS y FROM prep p JOIN r ON p.series_id = r.series_id),
    f AS (SELECT y.series_id, k, any_value(n) AS n, sum(y * cos(2 * pi() * k * pos / n)) AS a, sum(y * sin(2 * pi() * k * pos / n)) AS b
      FROM y CROSS JOIN (SELECT unnest(range(1, 5000)) AS k) q WHERE 2 * k <= n GROUP BY 1, 2)
    SELECT series_id, k, n, round(n / k, 4) AS period, round((a * a + b * b) / n / n * CASE WHEN 2 * k = n THEN 1 ELSE 2 END, 4) AS power FROM f""",
)
def _(spark, sf):
    return rounded(dg.periodogram(prepared(spark, sf), KEYS), 4)


@query("h17_spectral_peaks")
def _(spark, sf):
    return rounded(dg.spectral_peaks(dg.periodogram(prepared(spark, sf), KEYS), KEYS, CANDIDATES))


@query("h14_multi_season")
def _(spark, sf):
    peaks = dg.spectral_peaks(dg.periodogram(hourly(spark, sf), KEYS), KEYS, (24, 168))
    return dg.multi_season(peaks, KEYS, 2)


def _anomaly_sql(body: str) -> str:
    return f"""WITH {PREP}, {body},
    s AS (SELECT *, 0.6745 * residual / nullif(mad, 0) AS sc FROM r)
    SELECT series_id, timestamp, round(rolling_median, 6) AS rolling_median, round(residual, 6) AS residual, round(coalesce(sc, 0), 6) AS robust_score,
      coalesce(abs(sc) > 3.5, false) AS raw_outlier_flag, coalesce(abs(sc) > 3.5, false) AND imputed_flag = 1 AS suppressed_imputed_anomaly_flag,
      coalesce(abs(sc) > 3.5, false) AND imputed_flag = 0 AS outlier_flag FROM s"""


CENTERED = """a AS (SELECT *, CASE WHEN count(value_filled) OVER f >= 14 THEN quantile_cont(value_filled, 0.5) OVER f END AS m FROM prep
   WINDOW f AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)),
 b AS (SELECT *, coalesce(m, first_value(m IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   last_value(m IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)) AS rolling_median FROM a),
 c AS (SELECT *, value_filled - rolling_median AS residual FROM b),
 d AS (SELECT *, CASE WHEN count(residual) OVER f >= 14 THEN nullif(quantile_cont(abs(residual), 0.5) OVER f, 0) END AS m2 FROM c
   WINDOW f AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)),
 r AS (SELECT *, coalesce(m2, first_value(m2 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   last_value(m2 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)) AS mad FROM d)"""
CAUSAL = """a AS (SELECT *, CASE WHEN count(value_filled) OVER f >= 14 THEN quantile_cont(value_filled, 0.5) OVER f ELSE quantile_cont(value_filled, 0.5) OVER g END AS rolling_median FROM prep
   WINDOW f AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, value_filled - rolling_median AS residual FROM a),
 r AS (SELECT *, nullif(CASE WHEN count(residual) OVER f >= 14 THEN quantile_cont(abs(residual), 0.5) OVER f ELSE quantile_cont(abs(residual), 0.5) OVER g END, 0) AS mad FROM c
   WINDOW f AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ANOMALY_COLUMNS = [
    "series_id", "timestamp", "rolling_median", "residual", "robust_score", "raw_outlier_flag",
    "suppressed_imputed_anomaly_flag", "outlier_flag",
]


@query("h18_anomaly_centered", _anomaly_sql(CENTERED))
def _(spark, sf):
    return rounded(dg.anomaly_centered(prepared(spark, sf), KEYS, 28, 3.5).select(*ANOMALY_COLUMNS))


@query("h19_anomaly_causal", _anomaly_sql(CAUSAL))
def _(spark, sf):
    return rounded(dg.anomaly_causal(prepared(spark, sf), KEYS, 28, 3.5).select(*ANOMALY_COLUMNS))


@query(
    "h20_anomaly_summary",
    f"""WITH t AS ({_anomaly_sql(CENTERED)}) SELECT series_id, sum(CAST(outlier_flag AS INT)) AS outlier_count, round(avg(CAST(outlier_flag AS INT)), 6) AS outlier_share,
    sum(CAST(suppressed_imputed_anomaly_flag AS INT)) AS suppressed_imputed_anomaly_count FROM t GROUP BY 1""",
)
def _(spark, sf):
    return rounded(dg.anomaly_summary(dg.anomaly_centered(prepared(spark, sf), KEYS, 28, 3.5), KEYS))


@query(
    "h21_distribution",
    """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
    round(avg(CASE WHEN value = 0 THEN 1 ELSE 0 END), 6) AS zero_share, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis,
    bool_and(abs(value - round(value)) <= 1e-8 + 1e-5 * abs(round(value)) AND value >= 0) AS is_count_like, bool_and(value >= 0) AS is_non_negative,
    avg(CASE WHEN value = 0 THEN 1 ELSE 0 END) >= 0.3 AS is_intermittent_like FROM events GROUP BY 1""",
)
def _(spark, sf):
    out = rounded(dg.distribution(table(spark, sf, "events"), ["event_type"], "value"))
    return out.withColumn("skewness", F.round("skewness", 4)).withColumn("kurtosis", F.round("kurtosis", 4))


@query(
    "h22_histogram",
    """WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
    t AS (SELECT event_type, lo, (hi - lo) / 30 AS w, CAST(least(floor((value - lo) / ((hi - lo) / 30)) + 1, 30) AS INT) AS bin FROM events JOIN b USING (event_type))
    SELECT event_type, bin, round(any_value(lo) + (bin - 1) * any_value(w), 6) AS bin_start, count(*) AS count FROM t GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(dg.histogram(table(spark, sf, "events"), ["event_type"], "value", 30))


@query(
    "h22_box_stats",
    """SELECT event_type, count(value) AS n, round(min(value), 6) AS minimum, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS maximum FROM events GROUP BY 1""",
)
def _(spark, sf):
    return rounded(dg.box_stats(table(spark, sf, "events"), ["event_type"], "value"))


@query(
    "h23_rolling_stats",
    f"""WITH {PREP} SELECT series_id, timestamp, round(CASE WHEN count(value_filled) OVER w >= 14 THEN avg(value_filled) OVER w END, 5) AS rolling_mean,
    round(CASE WHEN count(value_filled) OVER w >= 14 THEN var_samp(value_filled) OVER w END, 4) AS rolling_variance FROM prep
    WINDOW w AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    rows = dg.rolling_stats(prepared(spark, sf), KEYS, 28)
    return rows.select(
        "series_id", "timestamp", F.round(F.col("rolling_mean") + NUDGE, 5).alias("rolling_mean"),
        F.round(F.col("rolling_variance") + NUDGE, 4).alias("rolling_variance"),
    )


DECOMP = """t AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) = 31 THEN
    (sum(value_filled) OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)
     - 0.5 * (lag(value_filled, 15) OVER (PARTITION BY series_id ORDER BY timestamp) + lead(value_filled, 15) OVER (PARTITION BY series_id ORDER BY timestamp))) / 30 END AS trend FROM prep),
 r0 AS (SELECT *, value_filled - trend AS r FROM t),
 p7 AS (SELECT *, avg(r) OVER (PARTITION BY series_id, pos % 7) AS ph FROM r0),
 s7 AS (SELECT * EXCLUDE ph, ph - avg(CASE WHEN r IS NOT NULL THEN ph END) OVER (PARTITION BY series_id) AS seasonal_7 FROM p7),
 p30 AS (SELECT *, r - seasonal_7 AS r2, avg(r - seasonal_7) OVER (PARTITION BY series_id, pos % 30) AS ph FROM s7),
 s30 AS (SELECT *, ph - avg(CASE WHEN r2 IS NOT NULL THEN ph END) OVER (PARTITION BY series_id) AS seasonal_30 FROM p30),
 dec AS (SELECT series_id, timestamp, trend, seasonal_7, seasonal_30, r2 - seasonal_30 AS remainder FROM s30)"""


@query(
    "h24_decompose",
    f"WITH {PREP}, {DECOMP} SELECT series_id, timestamp, round(trend, 5) AS trend, round(seasonal_7, 5) AS seasonal_7, round(seasonal_30, 5) AS seasonal_30, round(remainder, 5) AS remainder FROM dec",
)
def _(spark, sf):
    return rounded(
        dg.decompose(prepared(spark, sf), KEYS, (7, 30)).select(
            "series_id", "timestamp", "trend", "seasonal_7", "seasonal_30", "remainder"
        ),
        5,
    )


def _strength(c: str) -> str:
    return f"round(greatest(0, 1 - var_pop(remainder) / var_pop(CASE WHEN remainder IS NOT NULL THEN {c} + remainder END)), 5)"


@query(
    "h24_decomposition_strength",
    f"""WITH {PREP}, {DECOMP} SELECT series_id, 'ok' AS decomposition_status, {_strength('trend')} AS trend_strength, {_strength('(seasonal_7 + seasonal_30)')} AS seasonal_strength,
    {_strength('seasonal_7')} AS seasonal_strength_7, {_strength('seasonal_30')} AS seasonal_strength_30 FROM dec GROUP BY 1""",
)
def _(spark, sf):
    return rounded(dg.decomposition_strength(dg.decompose(prepared(spark, sf), KEYS, (7, 30)), KEYS, (7, 30)), 5)


@query(
    "h25_level_shifts",
    f"""WITH {PREP}, s AS (SELECT *, ln(1 + greatest(value_filled, 0)) AS s FROM prep),
    w AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, var_pop(s) OVER (PARTITION BY series_id) AS v,
      CASE WHEN count(*) OVER b = 14 AND count(*) OVER a = 14 THEN avg(s) OVER a - avg(s) OVER b END AS shift FROM s
      WINDOW b AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING)),
    g AS (SELECT *, shift * shift * 7 AS gain, max(shift * shift * 7) OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING) AS top FROM w)
    SELECT series_id, timestamp, round(shift, 6) AS shift, 'detected_level_shift' AS label FROM g WHERE n >= 40 AND gain = top AND gain > greatest(ln(n) * v, 1)""",
)
def _(spark, sf):
    return rounded(dg.level_shifts(prepared(spark, sf), KEYS))


@query("h25_change_points")
def change_points(spark, sf):
    return rounded(cp.change_points(prepared(spark, sf), KEYS))


@query(
    "h25_level_shift_status",
    f"""WITH {PREP} SELECT series_id, CASE WHEN count(*) >= 40 THEN 'ok' ELSE 'insufficient_history' END AS level_shift_detection_status,
    'penalised_partitioning_least_squares' AS level_shift_detection_method, CASE WHEN count(*) >= 40 THEN 'the whole series was searched' ELSE 'fewer than 40 rows' END AS level_shift_detection_reason
    FROM prep GROUP BY 1""",
)
def _(spark, sf):
    return cp.level_shift_status(prepared(spark, sf), KEYS)


@query("h26_stationarity")
def _(spark, sf):
    return rounded(dg.stationarity(prepared(spark, sf), KEYS))


@query("h27_diagnose")
def _(spark, sf):
    return rounded(diagnose(source(spark, sf), KEYS, "timestamp", "v"))
