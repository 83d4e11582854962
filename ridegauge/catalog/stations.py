"""Station panel, inventory, summary and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge.catalog.base import query, rounded
from ridegauge.functions.stats import robust_cv, safe_ratio
from ridegauge.operators import categories as cat, panel as pn
from ridegauge.plans.bindings import DENSE_DAILY, SPARSE_DAILY, bind

PANEL_BODY = """b AS (SELECT min(date) AS a, max(date) AS z FROM daily),
 st AS (SELECT station_id, min(date) AS fo, max(date) AS lo FROM daily GROUP BY 1),
 g AS (SELECT station_id, fo, lo, z, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM st CROSS JOIN b),
 p0 AS (SELECT g.*, d.target, d.target IS NULL AND g.date BETWEEN fo AND lo AS mi FROM g LEFT JOIN daily d ON g.station_id = d.station_id AND g.date = d.date),
 p1 AS (SELECT *, CASE WHEN mi <> coalesce(lag(mi) OVER w, false) THEN 1 ELSE 0 END AS ch FROM p0 WINDOW w AS (PARTITION BY station_id ORDER BY date)),
 p2 AS (SELECT *, sum(ch) OVER (PARTITION BY station_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS isl FROM p1),
 p3 AS (SELECT *, CASE WHEN mi THEN count(*) OVER (PARTITION BY station_id, isl) ELSE 0 END AS missing_run FROM p2),
 panel AS (SELECT station_id, date, target, fo, lo, z, mi, missing_run, target IS NOT NULL AS obs, CASE WHEN target > 0 THEN 'observed_positive' WHEN target = 0 THEN 'observed_zero' WHEN date < fo THEN 'pre_service'
   WHEN date > lo AND date_diff('day', lo, z) >= 30 THEN 'post_service' WHEN mi AND missing_run >= 21 THEN 'out_of_service' WHEN mi THEN 'missing_in_service' ELSE 'unknown_ambiguous' END AS day_state FROM p3)"""
INVENTORY_BODY = """i0 AS (SELECT *, day_state LIKE 'observed%' AS seen, day_state IN ('observed_positive', 'observed_zero', 'missing_in_service') AS serving,
   day_state = 'observed_positive' AS pos, day_state = 'missing_in_service' AS miss, date > z - 90 AS recent FROM panel),
 i1 AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) - row_number() OVER (PARTITION BY station_id, pos ORDER BY date) AS gp,
   row_number() OVER (PARTITION BY station_id ORDER BY date) - row_number() OVER (PARTITION BY station_id, miss ORDER BY date) AS gm,
   CASE WHEN pos THEN date_diff('day', lag(date) OVER (PARTITION BY station_id, pos ORDER BY date), date) END AS arr FROM i0),
 i2 AS (SELECT *, CASE WHEN pos THEN count(*) OVER (PARTITION BY station_id, pos, gp) ELSE 0 END AS rp, CASE WHEN miss THEN count(*) OVER (PARTITION BY station_id, miss, gm) ELSE 0 END AS rm FROM i1),
 i3 AS (SELECT station_id, min(CASE WHEN seen THEN date END) AS first_observed_date, max(CASE WHEN seen THEN date END) AS last_observed_date, max(z) AS z,
   count_if(seen) AS observed_days, count_if(day_state = 'observed_zero') AS observed_zero_days, count_if(pos) AS observed_positive_days, count_if(miss) AS missing_in_service_days,
   count_if(day_state = 'out_of_service') AS out_of_service_days, count_if(day_state = 'pre_service') AS pre_service_days, count_if(day_state = 'post_service') AS post_service_days,
   count_if(day_state = 'unknown_ambiguous') AS unknown_days, count_if(serving) AS in_service_days, count_if(serving AND recent) AS recent_in_service_days,
   count_if(seen AND recent) AS recent_observed_days, count_if(pos AND recent) AS recent_active_days, max(rm) AS longest_missing_streak, max(rp) AS longest_active_streak,
   quantile_cont(arr, 0.5) AS median_inter_arrival_active_days FROM i2 GROUP BY 1),
 i4 AS (SELECT *, date_diff('day', first_observed_date, last_observed_date) + 1 AS history_span_days, observed_days / nullif(in_service_days, 0) AS coverage_ratio,
   recent_observed_days / nullif(recent_in_service_days, 0) AS recent_availability_ratio, missing_in_service_days / nullif(in_service_days, 0) AS intermittent_gap_ratio,
   CASE WHEN in_service_days > 0 THEN greatest(0, 1 - longest_missing_streak / in_service_days) END AS service_continuity_score,
   date_diff('day', first_observed_date, z) AS days_since_first_observation, date_diff('day', last_observed_date, z) AS days_since_last_observation FROM i3),
 i5 AS (SELECT *, CASE WHEN days_since_last_observation > 90 AND recent_observed_days <= 3 THEN 1 WHEN observed_days < 30 OR in_service_days < 30 THEN 2
   WHEN history_span_days >= 365 AND observed_days >= 120 AND coverage_ratio < 0.6 THEN 3
   WHEN observed_days >= 240 AND in_service_days >= 300 AND coverage_ratio >= 0.75 AND recent_availability_ratio >= 0.6 THEN 4
   WHEN recent_active_days = 0 AND days_since_last_observation > 45 THEN 5 ELSE 6 END AS rule FROM i4),
 inv AS (SELECT * EXCLUDE (rule, z), history_span_days AS history_days, observed_days AS n_observed_days, missing_in_service_days AS n_missing_days, observed_days / nullif(history_span_days, 0) AS observed_share,
   ['stale_inactive', 'newborn', 'sparse_mature', 'mature', 'stale_inactive', 'young'][rule] AS history_group,
   ['Nothing observed lately: the recent window holds too few observed days.', 'The station has been seen on too few days to be judged.', 'A long history with many days missing while in service.',
    'Long, well covered history that is still going on.', 'There is a history, but no trips lately and few recent days.',
    'Enough days to work with, not enough to count as mature.'][rule] AS history_group_reason,
   rule IN (2, 6) AS is_short_history, recent_active_days >= 1 AS appears_active_recently, coalesce(observed_zero_days / nullif(observed_days, 0) >= 0.95, false) AS is_zero_almost_always FROM i5)"""
FACTS_BODY = """tot AS (SELECT date, sum(target) AS system_total FROM daily GROUP BY 1),
 f0 AS (SELECT p.*, day_state LIKE 'observed%' AS seen, CASE WHEN day_state LIKE 'observed%' THEN target END AS t, tot.system_total FROM panel p LEFT JOIN tot ON p.date = tot.date),
 f1 AS (SELECT *, lag(t) OVER w AS l1, lag(t, 7) OVER w AS l7, row_number() OVER (PARTITION BY station_id, seen ORDER BY date) AS up, row_number() OVER (PARTITION BY station_id, seen ORDER BY date DESC) AS dn
   FROM f0 WINDOW w AS (PARTITION BY station_id ORDER BY date)),
 pm AS (SELECT station_id, quantile_cont(t, 0.5) AS med, avg(t) AS pmean, stddev_pop(t) AS pstd, count(*) AS np FROM f0 WHERE t > 0 GROUP BY 1),
 pmad AS (SELECT f0.station_id, quantile_cont(abs(t - med), 0.5) AS mad FROM f0 JOIN pm ON f0.station_id = pm.station_id WHERE t > 0 GROUP BY 1),
 outl AS (SELECT f0.station_id, CASE WHEN any_value(np) >= 20 THEN avg(CASE WHEN abs(CASE WHEN mad <> 0 THEN 0.6745 * (t - med) / mad WHEN pstd <> 0 THEN (t - pmean) / pstd ELSE 0 END) > 3.5 THEN 1 ELSE 0 END) END AS outlier_rate
   FROM f0 JOIN pm ON f0.station_id = pm.station_id JOIN pmad ON f0.station_id = pmad.station_id WHERE t > 0 GROUP BY 1),
 wk AS (SELECT station_id, stddev_pop(m) AS s, count(*) AS k FROM (SELECT station_id, isodow(date), avg(t) AS m FROM f0 WHERE seen GROUP BY 1, 2) q GROUP BY 1),
 mo AS (SELECT station_id, stddev_pop(m) AS s, count(*) AS k FROM (SELECT station_id, month(date), avg(t) AS m FROM f0 WHERE seen GROUP BY 1, 2) q GROUP BY 1),
 sh AS (SELECT station_id, CASE WHEN count(*) >= 3 AND count(share) >= 3 AND avg(share) <> 0 THEN stddev_pop(share) / abs(avg(share)) END AS monthly_demand_share_cv FROM
   (SELECT station_id, date_trunc('month', date), sum(t) / nullif(sum(system_total), 0) AS share FROM f0 WHERE seen GROUP BY 1, 2) q GROUP BY 1),
 f2 AS (SELECT station_id, count(t) AS n, coalesce(sum(t), 0) AS total_demand, avg(t) AS avg_demand_observed, quantile_cont(t, 0.5) AS median_demand_observed, stddev_pop(t) AS std_demand_observed,
   avg(CASE WHEN t = 0 THEN 1 WHEN t IS NOT NULL THEN 0 END) AS zero_rate_observed, avg(CASE WHEN t > 0 THEN 1 WHEN t IS NOT NULL THEN 0 END) AS active_day_rate_observed,
   max(t) AS max_value, quantile_cont(t, 0.95) AS p95_value,
   CASE WHEN count(t) >= 30 AND count(CASE WHEN l1 IS NOT NULL THEN t END) >= 20 AND stddev_pop(CASE WHEN l1 IS NOT NULL THEN t END) <> 0 AND stddev_pop(CASE WHEN t IS NOT NULL THEN l1 END) <> 0 THEN corr(t, l1) END AS lag1_autocorr,
   CASE WHEN count(t) >= 30 AND count(CASE WHEN l7 IS NOT NULL THEN t END) >= 20 AND stddev_pop(CASE WHEN l7 IS NOT NULL THEN t END) <> 0 AND stddev_pop(CASE WHEN t IS NOT NULL THEN l7 END) <> 0 THEN corr(t, l7) END AS lag7_autocorr,
   avg(CASE WHEN isodow(date) >= 6 THEN t END) AS we, avg(CASE WHEN isodow(date) < 6 THEN t END) AS wd,
   CASE WHEN count(t) >= 45 AND stddev_pop(t) <> 0 THEN regr_slope(t, date_diff('day', fo, date)) END AS trend_slope,
   CASE WHEN count(t) >= 60 THEN avg(CASE WHEN dn <= 30 THEN t END) - avg(CASE WHEN up <= 30 THEN t END) END AS rolling_mean_shift_30obs,
   CASE WHEN count(t) >= 60 THEN stddev_pop(CASE WHEN dn <= 30 THEN t END) - stddev_pop(CASE WHEN up <= 30 THEN t END) END AS rolling_std_shift_30obs,
   CASE WHEN count(t) >= 30 AND stddev_pop(t) <> 0 AND stddev_pop(CASE WHEN t IS NOT NULL THEN system_total - t END) <> 0 THEN corr(t, system_total - t) END AS correlation_with_system_excl_self,
   CASE WHEN sum(CASE WHEN seen THEN system_total END) > 1 THEN coalesce(sum(t), 0) / sum(CASE WHEN seen THEN system_total END) END AS demand_share_of_system_observed_window,
   CASE WHEN sum(t) > 1 THEN coalesce(sum(CASE WHEN date > z - 90 THEN t END), 0) / sum(t) END AS fraction_of_demand_recent_window
   FROM f1 GROUP BY 1),
 facts AS (SELECT f2.*, CASE WHEN avg_demand_observed >= 1 THEN least(std_demand_observed / avg_demand_observed, 10) END AS coefficient_of_variation, outlier_rate, monthly_demand_share_cv,
   CASE WHEN n >= 21 AND avg_demand_observed >= 1 AND wk.k >= 2 THEN wk.s / abs(avg_demand_observed) END AS weekday_effect_strength,
   CASE WHEN n >= 21 AND avg_demand_observed >= 1 AND mo.k >= 2 THEN mo.s / abs(avg_demand_observed) END AS month_effect_strength,
   CASE WHEN n >= 21 AND avg_demand_observed >= 1 AND we IS NOT NULL AND wd > 0.5 THEN we / wd END AS weekend_ratio
   FROM f2 LEFT JOIN outl ON f2.station_id = outl.station_id LEFT JOIN wk ON f2.station_id = wk.station_id LEFT JOIN mo ON f2.station_id = mo.station_id LEFT JOIN sh ON f2.station_id = sh.station_id),
 summary AS (SELECT facts.* EXCLUDE (lag1_autocorr, lag7_autocorr, weekday_effect_strength, month_effect_strength, weekend_ratio, trend_slope, correlation_with_system_excl_self, n, we, wd),
   inv.* EXCLUDE (station_id), missing_in_service_days / nullif(in_service_days, 0) AS missing_rate_in_service, observed_positive_days / nullif(in_service_days, 0) AS activity_rate_in_service,
   1 / (1 + monthly_demand_share_cv) AS station_contribution_stability,
   CASE WHEN coverage_ratio >= 0.65 THEN lag1_autocorr END AS lag1_autocorr, CASE WHEN coverage_ratio >= 0.65 THEN lag7_autocorr END AS lag7_autocorr,
   CASE WHEN coverage_ratio >= 0.65 THEN weekday_effect_strength END AS weekday_effect_strength, CASE WHEN coverage_ratio >= 0.65 THEN month_effect_strength END AS month_effect_strength,
   CASE WHEN coverage_ratio >= 0.65 THEN weekend_ratio END AS weekend_ratio, CASE WHEN coverage_ratio >= 0.65 THEN trend_slope END AS trend_slope,
   CASE WHEN coverage_ratio >= 0.65 THEN correlation_with_system_excl_self END AS correlation_with_system_excl_self,
   coalesce(coverage_ratio >= 0.65, false) AND lag1_autocorr IS NOT NULL AND lag7_autocorr IS NOT NULL AS metric_reliable_autocorr,
   coalesce(coverage_ratio >= 0.65, false) AND weekday_effect_strength IS NOT NULL AND month_effect_strength IS NOT NULL AND we IS NOT NULL AND wd IS NOT NULL AS metric_reliable_pattern,
   coalesce(coverage_ratio >= 0.65, false) AND trend_slope IS NOT NULL AS metric_reliable_trend, outlier_rate IS NOT NULL AS metric_reliable_outlier,
   coalesce(coverage_ratio >= 0.65, false) AND correlation_with_system_excl_self IS NOT NULL AS metric_reliable_system_correlation, n >= 60 AS metric_reliable_rolling_shift,
   coalesce(coverage_ratio >= 0.55, false) AND observed_days >= 28 AND recent_observed_days >= 10 AS metric_reliable_behavior,
   coalesce(coverage_ratio < 0.55, true) OR coalesce(avg_demand_observed < 1, false) AS metrics_limited_by_sparsity
   FROM facts JOIN inv ON facts.station_id = inv.station_id)"""

# Neighbouring suppliers form one station, so coverage is high; the station number shapes its demand pattern.
LABEL_DAILY = """
SELECT CAST(s AS STRING) AS station_id, d AS date, sum(CASE
         WHEN s % 7 = 0 AND q < 40 THEN 0
         WHEN s % 7 = 1 AND w IN (0, 6) THEN floor(q / 8)
         WHEN s % 7 = 2 AND w IN (0, 6) THEN q * 3
         WHEN s % 7 = 3 AND day(d) IN (3, 13, 23) THEN q * 40
         WHEN s % 7 = 4 THEN q * 10
         ELSE q END) AS target
FROM (SELECT CAST(floor(l_suppkey / 6) AS BIGINT) AS s, CAST(l_shipdate AS DATE) AS d, l_quantity AS q,
             CAST(extract(DAYOFWEEK FROM l_shipdate) AS INT) % 7 AS w FROM lineitem) AS t
WHERE s % 7 <> 5 OR year(d) < 1998 GROUP BY 1, 2
"""
LABEL_DAILY_SPARK = LABEL_DAILY.replace("CAST(extract(DAYOFWEEK FROM l_shipdate) AS INT) % 7", "dayofweek(l_shipdate) - 1")

DENSE = f"daily AS ({DENSE_DAILY}), {PANEL_BODY}"
SPARSE = f"daily AS ({SPARSE_DAILY}), {PANEL_BODY}"


def daily(spark, sf, sql=DENSE_DAILY):
    return bind(spark, sf, sql)


def panel(spark, sf, sql=DENSE_DAILY):
    return pn.analysis_panel(daily(spark, sf, sql))


def summary(spark, sf, sql=DENSE_DAILY):
    return pn.station_summary(daily(spark, sf, sql))


def sql_round(columns: dict[str, str] | list[str], numeric: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in numeric else c for c in columns)


# ---- I ---------------------------------------------------------------------------------------------------------------

DIRTY = f"""(SELECT station_id, date, target FROM ({SPARSE_DAILY}) d
 UNION ALL SELECT CAST(o_custkey AS STRING) AS station_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN -1.0 ELSE NULL END AS target FROM orders WHERE o_orderstatus = 'P'
 UNION ALL SELECT ' ' AS station_id, CASE WHEN c_nationkey = 3 THEN NULL ELSE DATE '1999-01-01' END AS date, c_acctbal AS target FROM customer )"""


@query(
    "i01_validation_checks",
    f"""WITH d AS (SELECT station_id, date, CAST(target AS DOUBLE) AS target FROM {DIRTY} u),
    r AS (SELECT greatest(quantile_cont(target, 0.999), quantile_cont(target, 0.5) * 8) AS ref FROM d WHERE target >= 0),
    s AS (SELECT station_id, count(target) AS usable, max(gap) AS gap FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY station_id ORDER BY date), date) - 1 AS gap FROM d) q GROUP BY 1),
    c AS (SELECT 'invalid_dates' AS "check", 'error' AS severity, count_if(date IS NULL) AS count FROM d
     UNION ALL SELECT 'blank_station_ids', 'error', count_if(trim(station_id) = '') FROM d
     UNION ALL SELECT 'duplicate_station_date_rows', 'error', (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d GROUP BY station_id, date) q)
     UNION ALL SELECT 'invalid_target_rows', 'error', count_if(target IS NULL) FROM d
     UNION ALL SELECT 'negative_demand_values', 'error', count_if(target < 0) FROM d
     UNION ALL SELECT 'all_null_target_stations', 'error', count_if(usable = 0) FROM s
     UNION ALL SELECT 'suspicious_target_spikes', 'warning', (SELECT count_if(target > (SELECT ref FROM r)) FROM d)
     UNION ALL SELECT 'stations_with_too_little_usable_data', 'warning', count_if(usable < 14) FROM s
     UNION ALL SELECT 'stations_with_long_missing_spans', 'warning', count_if(gap >= 14) FROM s)
    SELECT "check", severity, CASE WHEN count = 0 THEN 'pass' WHEN severity = 'error' THEN 'fail' ELSE 'warn' END AS status, CAST(count AS BIGINT) AS count FROM c""",
)
def _(spark, sf):
    rows = bind(spark, sf, f"SELECT station_id, date, CAST(target AS DOUBLE) AS target FROM {DIRTY} AS u")
    return pn.validation_checks(rows).drop("message")


@query(
    "i02_station_warnings",
    f"""WITH d AS ({SPARSE_DAILY}), t AS (SELECT date_diff('day', min(date), max(date)) + 1 AS days FROM d),
    s AS (SELECT station_id, count(target) AS observed_days, date_diff('day', min(date), max(date)) + 1 AS history_span_days, greatest(coalesce(max(gap), 0), 0) AS longest_missing_gap_days
      FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY station_id ORDER BY date), date) - 1 AS gap FROM d) q GROUP BY 1)
    SELECT station_id, observed_days, history_span_days, round(observed_days / history_span_days, 6) AS calendar_coverage_ratio, round(observed_days / days, 6) AS global_presence_ratio,
     longest_missing_gap_days, observed_days < 14 AS warning_too_few_usable_days, longest_missing_gap_days >= 14 AS warning_long_missing_gap FROM s CROSS JOIN t""",
)
def _(spark, sf):
    return rounded(pn.station_warnings(daily(spark, sf, SPARSE_DAILY)))


@query("i03_panel_grid", f"WITH {DENSE} SELECT station_id, date, target, fo AS first_observed_date, lo AS last_observed_date, z AS global_end FROM p0")
def _(spark, sf):
    return pn.panel_grid(daily(spark, sf))


@query(
    "i04_day_state",
    f"WITH {SPARSE} SELECT station_id, day_state, count(*) AS days, min(date) AS first_day, max(date) AS last_day, sum(date_diff('day', DATE '1990-01-01', date)) AS day_sum FROM panel GROUP BY 1, 2",
)
def _(spark, sf):
    return pn.day_state_totals(daily(spark, sf, SPARSE_DAILY))


@query("i05_run_length", f"WITH {DENSE} SELECT station_id, date, missing_run FROM panel")
def _(spark, sf):
    return pn.day_state(pn.panel_grid(daily(spark, sf))).select("station_id", "date", "missing_run")


@query(
    "i06_analysis_panel",
    f"""WITH {DENSE} SELECT station_id, date, day_state, obs AS is_observed, target AS observed_target, day_state = 'observed_positive' AS is_observed_positive, day_state = 'observed_zero' AS is_observed_zero,
    day_state LIKE 'observed%' AS is_observed_in_service, day_state = 'missing_in_service' AS is_missing_in_service, day_state = 'out_of_service' AS is_out_of_service, day_state = 'pre_service' AS is_pre_service,
    day_state = 'post_service' AS is_post_service, day_state = 'unknown_ambiguous' AS is_unknown_ambiguous, day_state IN ('observed_positive', 'observed_zero', 'missing_in_service') AS is_in_service,
    CASE WHEN day_state LIKE 'observed%' THEN target END AS analysis_target, CASE WHEN date BETWEEN fo AND lo THEN target END AS service_window_target, fo AS first_observed_date, lo AS last_observed_date FROM panel""",
)
def _(spark, sf):
    return panel(spark, sf).drop("target", "global_end", "missing_run", "within_service_window")


_INV_ROUND = {
    "coverage_ratio", "recent_availability_ratio", "intermittent_gap_ratio", "service_continuity_score", "observed_share",
    "median_inter_arrival_active_days",
}
_INV_COLUMNS = [
    "station_id", "first_observed_date", "last_observed_date", "history_span_days", "history_days", "observed_days", "n_observed_days",
    "observed_zero_days", "observed_positive_days", "missing_in_service_days", "n_missing_days", "out_of_service_days", "pre_service_days",
    "post_service_days", "unknown_days", "in_service_days", "coverage_ratio", "observed_share", "recent_in_service_days", "recent_observed_days",
    "recent_active_days", "recent_availability_ratio", "longest_missing_streak", "longest_active_streak", "days_since_first_observation",
    "days_since_last_observation", "intermittent_gap_ratio", "service_continuity_score", "median_inter_arrival_active_days", "history_group",
    "history_group_reason", "is_short_history", "appears_active_recently", "is_zero_almost_always",
]
for _name, _body, _sql in (("i07_inventory", DENSE, DENSE_DAILY), ("i10_inventory_sparse", SPARSE, SPARSE_DAILY)):

    def _make(binding):
        return lambda spark, sf: rounded(pn.station_inventory(daily(spark, sf, binding)).select(*_INV_COLUMNS))

    query(_name, f"WITH {_body}, {INVENTORY_BODY} SELECT {sql_round(_INV_COLUMNS, _INV_ROUND)} FROM inv")(_make(_sql))


@query(
    "i08_longest_run",
    f"""WITH {DENSE}, m AS (SELECT station_id, target IS NOT NULL AS m, row_number() OVER (PARTITION BY station_id ORDER BY date) - row_number() OVER (PARTITION BY station_id, target IS NOT NULL ORDER BY date) AS g FROM panel),
    r AS (SELECT station_id, g, count(*) AS n FROM m WHERE m GROUP BY 1, 2) SELECT station_id, CAST(max(n) AS INT) AS longest_run FROM r GROUP BY 1""",
)
def _(spark, sf):
    grid = pn.panel_grid(daily(spark, sf))
    return pn.longest_run(grid, F.col("target").isNotNull())


@query("i09_median_gap", f"WITH {DENSE}, {INVENTORY_BODY} SELECT station_id, round(median_inter_arrival_active_days, 6) AS median_gap FROM inv")
def _(spark, sf):
    return rounded(pn.station_inventory(daily(spark, sf)).select("station_id", F.col("median_inter_arrival_active_days").alias("median_gap")))


@query(
    "i11_i13_guarded_ratios",
    "SELECT c_custkey, round(CASE WHEN abs(c_nationkey) > 2 THEN c_acctbal / c_nationkey END, 6) AS ratio, round(CASE WHEN c_acctbal >= 1 THEN least(c_nationkey / c_acctbal, 10) END, 6) AS cv FROM customer",
)
def _(spark, sf):
    from ridegauge.plans.bindings import table

    return rounded(
        table(spark, sf, "customer").select(
            "c_custkey",
            safe_ratio(F.col("c_acctbal"), F.col("c_nationkey"), 2).alias("ratio"),
            robust_cv(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("cv"),
        )
    )


_FACT_COLUMNS = {
    "i12_level_stats": ["total_demand", "avg_demand_observed", "median_demand_observed", "std_demand_observed", "zero_rate_observed", "active_day_rate_observed", "max_value", "p95_value", "coefficient_of_variation"],
    "i14_calendar_acf": ["lag1_autocorr", "lag7_autocorr"],
    "i15_effect_strength": ["weekday_effect_strength", "month_effect_strength"],
    "i16_weekend_ratio": ["weekend_ratio"],
    "i17_trend_slope": ["trend_slope"],
    "i18_rolling_shift": ["rolling_mean_shift_30obs", "rolling_std_shift_30obs"],
    "i19_outlier_rate": ["outlier_rate"],
    "i20_corr_ex_self": ["correlation_with_system_excl_self"],
    "i21_monthly_share_cv": ["monthly_demand_share_cv"],
    "i22_demand_share": ["demand_share_of_system_observed_window", "fraction_of_demand_recent_window"],
}
for _name, _columns in _FACT_COLUMNS.items():

    def _make(columns):
        return lambda spark, sf: rounded(pn.station_facts(panel(spark, sf), daily(spark, sf)).select("station_id", *columns))

    query(
        _name,
        f"WITH {DENSE}, {FACTS_BODY.split(' summary AS')[0].rstrip().rstrip(',')} SELECT station_id, {sql_round(_columns, set(_columns))} FROM facts",
    )(_make(_columns))

_SUMMARY_GROUPS = {
    "i23_service_rates": ["missing_rate_in_service", "activity_rate_in_service"],
    "i24_gated_metrics": [
        "lag1_autocorr", "lag7_autocorr", "weekday_effect_strength", "month_effect_strength", "weekend_ratio", "trend_slope",
        "correlation_with_system_excl_self", "metric_reliable_autocorr", "metric_reliable_pattern", "metric_reliable_trend", "metric_reliable_outlier",
        "metric_reliable_system_correlation", "metric_reliable_rolling_shift", "metric_reliable_behavior", "metrics_limited_by_sparsity",
    ],
}
_BOOL = {c for c in _SUMMARY_GROUPS["i24_gated_metrics"] if c.startswith("metric")}
SUMMARY = f"daily AS ({LABEL_DAILY}), {PANEL_BODY}, {INVENTORY_BODY}, {FACTS_BODY}"
SPARSE_SUMMARY = f"{SPARSE}, {INVENTORY_BODY}, {FACTS_BODY}"
for _name, _columns in _SUMMARY_GROUPS.items():
    _binding, _body = (SPARSE_DAILY, SPARSE_SUMMARY) if _name.startswith("i23") else (LABEL_DAILY_SPARK, SUMMARY)

    def _make(columns, binding):
        return lambda spark, sf: rounded(summary(spark, sf, binding).select("station_id", *columns))

    query(_name, f"WITH {_body} SELECT station_id, {sql_round(_columns, set(_columns) - _BOOL)} FROM summary")(_make(_columns, _binding))

_SUMMARY_COLUMNS = [
    "station_id", "history_span_days", "history_days", "observed_days", "in_service_days", "coverage_ratio", "recent_observed_days", "recent_active_days",
    "recent_availability_ratio", "missing_rate_in_service", "activity_rate_in_service", "history_group", "history_group_reason", "total_demand",
    "avg_demand_observed", "median_demand_observed", "std_demand_observed", "coefficient_of_variation", "zero_rate_observed", "active_day_rate_observed",
    "lag1_autocorr", "lag7_autocorr", "weekday_effect_strength", "month_effect_strength", "weekend_ratio", "trend_slope", "rolling_mean_shift_30obs",
    "rolling_std_shift_30obs", "outlier_rate", "max_value", "p95_value", "correlation_with_system_excl_self", "demand_share_of_system_observed_window",
    "fraction_of_demand_recent_window", "monthly_demand_share_cv", "station_contribution_stability", "longest_missing_streak", "longest_active_streak",
    "intermittent_gap_ratio", "median_inter_arrival_active_days", "service_continuity_score", "days_since_first_observation", "days_since_last_observation",
    "is_short_history", "is_zero_almost_always", "appears_active_recently", "metric_reliable_behavior", "metrics_limited_by_sparsity",
]
_EXACT = {
    "station_id", "history_span_days", "history_days", "observed_days", "in_service_days", "recent_observed_days", "recent_active_days", "history_group",
    "history_group_reason", "longest_missing_streak", "longest_active_streak", "days_since_first_observation", "days_since_last_observation",
    "is_short_history", "is_zero_almost_always", "appears_active_recently", "metric_reliable_behavior", "metrics_limited_by_sparsity",
}
_ALIAS_SQL = ", ".join(
    f"{n} AS {a}" if n in _EXACT | {"first_observed_date", "last_observed_date"} else f"round({n}, 6) AS {a}" for a, n in pn.ALIASES.items()
)


@query(
    "i25_station_summary",
    f"WITH {SUMMARY} SELECT {sql_round(_SUMMARY_COLUMNS, set(_SUMMARY_COLUMNS) - _EXACT)}, {_ALIAS_SQL} FROM summary",
)
def _(spark, sf):
    return rounded(summary(spark, sf, LABEL_DAILY_SPARK).select(*_SUMMARY_COLUMNS, *pn.ALIASES))


@query("i26_system_total", f"WITH {DENSE} SELECT date, sum(target) AS system_total FROM daily GROUP BY 1")
def _(spark, sf):
    return pn.system_total(daily(spark, sf))


@query(
    "i27_top_by",
    f"WITH {SUMMARY} SELECT station_id, round(lag1_autocorr, 6) AS lag1_autocorr FROM summary ORDER BY summary.lag1_autocorr DESC NULLS LAST, station_id LIMIT 5",
)
def _(spark, sf):
    return rounded(pn.top_by(summary(spark, sf, LABEL_DAILY_SPARK), "lag1_autocorr", 5).select("station_id", "lag1_autocorr"))


# ---- J: labels -------------------------------------------------------------------------------------------------------

CATEGORY_BODY = """thr AS (SELECT coalesce((SELECT quantile_cont(avg_demand_observed, 0.75) FROM summary WHERE metric_reliable_behavior AND history_group = 'mature'),
   (SELECT quantile_cont(avg_demand_observed, 0.75) FROM summary WHERE metric_reliable_behavior), 1.0) AS busy_threshold),
 catg AS (SELECT *, CASE WHEN NOT metric_reliable_behavior THEN 'unclassified_due_to_low_coverage' WHEN zero_rate_observed >= 0.6 OR active_day_rate_observed <= 0.4 THEN 'sparse_intermittent'
   WHEN outlier_rate >= 0.08 THEN 'anomaly_prone' WHEN avg_demand_observed >= busy_threshold AND coefficient_of_variation <= 0.85 THEN 'busy_stable'
   WHEN avg_demand_observed >= busy_threshold AND coefficient_of_variation >= 1.35 THEN 'busy_volatile' WHEN weekday_effect_strength >= 0.18 AND weekend_ratio <= 0.85 THEN 'commuter_pattern'
   WHEN weekday_effect_strength IS NOT NULL AND weekend_ratio >= 1.2 THEN 'weekend_leisure' WHEN coverage_ratio < 0.55 THEN 'unclassified_due_to_low_coverage' ELSE 'mixed_profile' END AS behavior_label,
   coalesce(metric_reliable_behavior AND history_group = 'mature' AND coverage_ratio >= 0.8 AND observed_days >= 180, false) AS high,
   concat_ws('; ', CASE WHEN NOT metric_reliable_behavior THEN 'too little coverage for behaviour metrics' END, CASE WHEN history_group IN ('newborn', 'young') THEN 'the station is not mature' END,
     CASE WHEN coverage_ratio < 0.7 THEN 'coverage is under 70 percent' END, CASE WHEN observed_days < 120 THEN 'fewer than 120 observed days' END) AS rs FROM summary CROSS JOIN thr),
 lab AS (SELECT *, CASE WHEN high THEN 'high' WHEN metric_reliable_behavior THEN 'medium' ELSE 'low' END AS behavior_label_confidence,
   CASE WHEN high THEN 'Mature, well covered history: the label can be trusted.' WHEN rs <> '' THEN rs WHEN metric_reliable_behavior THEN 'The label can be used with some care.'
     ELSE 'Too little data to trust the label.' END AS behavior_label_reliability_reason FROM catg)"""
LABELS = f"daily AS ({LABEL_DAILY}), {PANEL_BODY}, {INVENTORY_BODY}, {FACTS_BODY}, {CATEGORY_BODY}"


def categorized(spark, sf):
    return cat.categorize(summary(spark, sf, LABEL_DAILY_SPARK))


@query("j01_busy_threshold", f"WITH {LABELS} SELECT round(busy_threshold, 6) AS busy_threshold FROM thr")
def _(spark, sf):
    return rounded(cat.busy_threshold(summary(spark, sf, LABEL_DAILY_SPARK)))


@query("j02_behavior_label", f"WITH {LABELS} SELECT station_id, history_group, behavior_label, behavior_label AS station_category FROM lab")
def _(spark, sf):
    return categorized(spark, sf).select("station_id", "history_group", "behavior_label", "station_category")


@query("j03_confidence", f"WITH {LABELS} SELECT station_id, behavior_label_confidence, behavior_label_reliability_reason FROM lab")
def _(spark, sf):
    return categorized(spark, sf).select("station_id", "behavior_label_confidence", "behavior_label_reliability_reason")


@query(
    "j04_category_summary",
    f"""WITH {LABELS} SELECT behavior_label, count(DISTINCT station_id) AS station_count, round(avg(avg_demand_observed), 6) AS avg_demand_mean, round(avg(zero_rate_observed), 6) AS zero_rate_mean,
    round(avg(outlier_rate), 6) AS outlier_rate_mean, round(avg(CASE WHEN history_group = 'mature' THEN 1 ELSE 0 END), 6) AS mature_share,
    round(avg(CASE WHEN behavior_label_confidence = 'high' THEN 1 ELSE 0 END), 6) AS high_confidence_share, round(avg(CASE WHEN behavior_label_confidence = 'low' THEN 1 ELSE 0 END), 6) AS low_confidence_share
    FROM lab GROUP BY 1""",
)
def _(spark, sf):
    return rounded(cat.category_summary(categorized(spark, sf)))


@query(
    "j15_representatives",
    f"""WITH {LABELS}, m AS (SELECT behavior_label, quantile_cont(avg_demand_observed, 0.5) AS a, quantile_cont(coverage_ratio, 0.5) AS c FROM lab GROUP BY 1 HAVING count(*) >= 3)
    SELECT lab.behavior_label, station_id, round(avg_demand_observed, 6) AS avg_demand_observed FROM lab JOIN m ON lab.behavior_label = m.behavior_label
    QUALIFY row_number() OVER (PARTITION BY lab.behavior_label ORDER BY abs(lab.avg_demand_observed - a) + abs(coverage_ratio - c), station_id) <= 3""",
)
def _(spark, sf):
    return rounded(cat.representatives(categorized(spark, sf)).select("behavior_label", "station_id", "avg_demand_observed"))


@query("j16_crosstab", f"WITH {LABELS} SELECT history_group, behavior_label, count(*) AS stations FROM lab GROUP BY 1, 2")
def _(spark, sf):
    return cat.crosstab(categorized(spark, sf))


@query("j16_label_counts", f"WITH {LABELS} SELECT behavior_label, count(*) AS stations FROM lab GROUP BY 1")
def _(spark, sf):
    return cat.label_counts(categorized(spark, sf), "behavior_label")


for _by, _slot, _range in (("weekday", "isodow(date) - 1", "range(0, 7)"), ("month", "month(date)", "range(1, 13)")):

    def _make(by):
        return lambda spark, sf: rounded(cat.station_profiles(pn.observed_days(daily(spark, sf, SPARSE_DAILY)), by))

    query(
        f"j17_station_profiles_{_by}",
        f"""WITH {SPARSE}, s AS (SELECT DISTINCT station_id FROM panel WHERE day_state LIKE 'observed%'), x AS (SELECT station_id, unnest({_range}) AS {_by} FROM s),
        v AS (SELECT station_id, {_slot} AS {_by}, avg(target) AS m FROM panel WHERE day_state LIKE 'observed%' GROUP BY 1, 2)
        SELECT x.station_id, x.{_by}, round(v.m, 6) AS mean_demand FROM x LEFT JOIN v ON x.station_id = v.station_id AND x.{_by} = v.{_by}""",
    )(_make(_by))


@query(
    "j18_profile_zscores",
    f"""WITH {LABELS}, p AS (SELECT behavior_label, avg(avg_demand_observed) AS demand_mean, avg(coverage_ratio) AS coverage_mean FROM lab GROUP BY 1)
    SELECT behavior_label, round(coalesce((demand_mean - avg(demand_mean) OVER ()) / CASE WHEN stddev_pop(demand_mean) OVER () > 0 THEN stddev_pop(demand_mean) OVER () ELSE 1 END, 0), 5) AS demand_mean,
    round(coalesce((coverage_mean - avg(coverage_mean) OVER ()) / CASE WHEN stddev_pop(coverage_mean) OVER () > 0 THEN stddev_pop(coverage_mean) OVER () ELSE 1 END, 0), 5) AS coverage_mean FROM p""",
)
def _(spark, sf):
    profile = categorized(spark, sf).groupBy("behavior_label").agg(
        F.avg("avg_demand_observed").alias("demand_mean"), F.avg("coverage_ratio").alias("coverage_mean")
    )
    return rounded(cat.profile_zscores(profile, "behavior_label"), 5)
