"""Warehouse tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge.catalog import forecasting as fc
from ridegauge.catalog.base import query, rounded
from ridegauge.catalog.cleaning import CLEAN, raw_trips, trips
from ridegauge.operators import backtest as bt, features as ft, reports as rp, warehouse as wh
from ridegauge.plans.bindings import EVENT_TRIPS, bind, table

ET = f"et AS ({EVENT_TRIPS})"
LV = f"{ET}, lv AS (SELECT *, 'system_total' AS segment_type, 'all' AS segment_id FROM et UNION ALL SELECT *, 'start_station', CAST(start_station AS VARCHAR) FROM et)"
STEP = {"hourly": "1 HOUR", "daily": "1 DAY", "weekly": "7 DAY", "monthly": "1 MONTH", "quarterly": "3 MONTH"}


def agg_sql(grain: str) -> str:
    return f"""ag AS (SELECT date_trunc('{wh.GRAIN_UNIT[grain]}', start_time)::TIMESTAMP AS bucket_start, segment_type, segment_id, count(*) AS trip_count, count(DISTINCT bike_id) AS distinct_bikes,
      avg(duration_minutes) AS avg_duration_minutes FROM lv GROUP BY 1, 2, 3)"""


def event_agg(spark, sf, grain):
    return wh.aggregate(bind(spark, sf, EVENT_TRIPS), grain)


for _g in STEP:

    def _make(grain):
        return lambda spark, sf: rounded(event_agg(spark, sf, grain))

    query(
        f"g01_aggregate_{_g}",
        f"WITH {LV}, {agg_sql(_g)} SELECT bucket_start, segment_type, segment_id, bucket_start + INTERVAL {STEP[_g]} AS bucket_end, trip_count, distinct_bikes, round(avg_duration_minutes, 6) AS avg_duration_minutes FROM ag",
    )(_make(_g))

COMPLETE = f"""{LV}, {agg_sql('hourly')}, gr AS (SELECT segment_type, segment_id, unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 1 HOUR)) AS bucket_start FROM ag GROUP BY 1, 2),
 cb AS (SELECT gr.bucket_start, gr.segment_type, gr.segment_id, gr.bucket_start + INTERVAL 1 HOUR AS bucket_end, coalesce(trip_count, 0) AS trip_count, coalesce(distinct_bikes, 0) AS distinct_bikes, avg_duration_minutes,
   trip_count IS NOT NULL AS is_observed, trip_count IS NULL AS missing_period_flag FROM gr LEFT JOIN ag ON gr.segment_type = ag.segment_type AND gr.segment_id = ag.segment_id AND gr.bucket_start = ag.bucket_start)"""


def completed(spark, sf):
    return wh.complete_buckets(event_agg(spark, sf, "hourly"), "hourly")


@query("g02_complete_buckets", f"WITH {COMPLETE} SELECT * EXCLUDE avg_duration_minutes, round(avg_duration_minutes, 6) AS avg_duration_minutes FROM cb")
def _(spark, sf):
    return rounded(completed(spark, sf))


for _g in ("weekly", "monthly", "quarterly"):

    def _make(grain):
        return lambda spark, sf: rounded(wh.roll_up(event_agg(spark, sf, "daily"), grain))

    query(
        f"g03_roll_up_{_g}",
        f"WITH {LV}, {agg_sql(_g)} SELECT bucket_start, segment_type, segment_id, bucket_start + INTERVAL {STEP[_g]} AS bucket_end, trip_count, round(avg_duration_minutes, 6) AS avg_duration_minutes FROM ag",
    )(_make(_g))


@query(
    "g04_feature_store",
    f"""WITH {COMPLETE} SELECT segment_type, segment_id, bucket_start, CAST(trip_count AS DOUBLE) AS target_trip_count, CASE WHEN bucket_start < TIMESTAMP '2024-01-10' THEN 'pre' WHEN bucket_start < TIMESTAMP '2024-01-20' THEN 'during' ELSE 'post' END AS pandemic_phase,
    lag(trip_count) OVER w IS NOT NULL AS completeness_flag, lag(trip_count) OVER w AS payload_lag_1, distinct_bikes AS payload_bikes FROM cb WINDOW w AS (PARTITION BY segment_type, segment_id ORDER BY bucket_start)""",
)
def _(spark, sf):
    from pyspark.sql import Window as W

    rows = completed(spark, sf).withColumn(
        "lag_1", F.lag("trip_count").over(W.partitionBy("segment_type", "segment_id").orderBy("bucket_start"))
    )
    phases = [("pre", None, "2024-01-10"), ("during", "2024-01-10", "2024-01-20"), ("post", "2024-01-20", None)]
    store = wh.feature_store(rows.select("segment_type", "segment_id", "bucket_start", "trip_count", "distinct_bikes", "lag_1"), phases)
    return store.select(
        "segment_type", "segment_id", "bucket_start", "target_trip_count", "pandemic_phase", "completeness_flag",
        F.get_json_object("feature_payload", "$.lag_1").cast("long").alias("payload_lag_1"),
        F.get_json_object("feature_payload", "$.distinct_bikes").cast("long").alias("payload_bikes"),
    )


@query(
    "g05_modeling_registry",
    f"""WITH {fc.SP}, e AS (SELECT max(date) AS z FROM sp), f AS (SELECT station_id, count(*) AS row_count, count(target) AS observed_rows, coalesce(sum(target), 0) AS total_trip_count, avg(target) AS average_trip_count,
      avg(CASE WHEN target = 0 THEN 1 WHEN target IS NOT NULL THEN 0 END) AS zero_share, coalesce(sum(CASE WHEN date > z - 90 THEN target END), 0) AS rec FROM sp CROSS JOIN e GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY total_trip_count DESC) AS volume_rank, count(*) OVER () AS n FROM f)
    SELECT station_id, row_count, observed_rows, total_trip_count, round(average_trip_count, 6) AS average_trip_count, round(zero_share, 6) AS zero_share, volume_rank,
     CASE WHEN volume_rank / n <= 0.2 THEN 'high' WHEN volume_rank / n <= 0.6 THEN 'medium' ELSE 'low' END AS volume_tier, observed_rows >= 365 AND zero_share <= 0.8 AS direct_modeling_eligible,
     CASE WHEN observed_rows >= 365 AND zero_share <= 0.8 THEN 'direct' ELSE 'reconciled_share' END AS modeling_strategy,
     CASE WHEN observed_rows < 365 THEN 'short_history' WHEN zero_share > 0.8 THEN 'mostly_zero' ELSE 'forecastable' END AS forecastability_reason, round(rec / total_trip_count, 6) AS recent_share FROM r""",
)
def _(spark, sf):
    return rounded(wh.modeling_registry(fc.station_panel(spark, sf)))


@query(
    "g06_split_metadata",
    f"WITH {fc.COMP}, t AS (SELECT *, CASE WHEN date <= (SELECT max(date) FROM comp) - 30 THEN 'train' ELSE 'valid' END AS role FROM comp) SELECT series_id, role AS window_role, min(date) AS window_start, max(date) AS window_end, count(*) AS row_count FROM t GROUP BY 1, 2",
)
def _(spark, sf):
    return wh.split_metadata(ft.time_split(fc.target(spark, sf), 30), ["series_id"])


@query(
    "g07_backtest_results",
    f"""WITH {fc.QUAL.replace("RS", "RS")}, b AS (SELECT ap.*, bk.mase_scale FROM ap JOIN bk ON bk.model_name = ap.model_name AND bk.horizon = ap.horizon AND bk.horizon_step = ap.horizon_step AND bk.fold_id = ap.fold_id)
    SELECT model_name, horizon, round(avg(abs(prediction - actual)), 3) AS mae, round(sqrt(avg((prediction - actual) ** 2)), 3) AS rmse, round(avg(CASE WHEN actual <> 0 THEN abs(prediction - actual) / actual END), 3) AS mape,
     round(avg(CASE WHEN actual + prediction > 0 THEN 2 * abs(prediction - actual) / (actual + prediction) ELSE 0 END), 3) AS smape, round(avg(abs(prediction - actual) / mase_scale), 3) AS mase, round(avg(prediction - actual), 3) AS bias,
     count(actual) AS holdout_rows, round(avg(abs(prediction - actual) / 2), 3) AS pinball_50,
     round(avg((greatest(0.1 * (actual - l8), -0.9 * (actual - l8)) + greatest(0.9 * (actual - u8), -0.1 * (actual - u8))) / 2), 3) AS pinball_80, round(avg(CASE WHEN actual BETWEEN l8 AND u8 THEN 1 ELSE 0 END), 3) AS coverage_80, round(avg(u8 - l8), 3) AS width_80,
     round(avg((greatest(0.025 * (actual - l9), -0.975 * (actual - l9)) + greatest(0.975 * (actual - u9), -0.025 * (actual - u9))) / 2), 3) AS pinball_95, round(avg(CASE WHEN actual BETWEEN l9 AND u9 THEN 1 ELSE 0 END), 3) AS coverage_95, round(avg(u9 - l9), 3) AS width_95
    FROM b GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(wh.backtest_results(fc.intervalized(spark, sf), ["model_name", "horizon"]), 3)


IDS = "sha256(concat_ws('|', model_name, CAST(horizon AS VARCHAR), CAST(date AS VARCHAR))) AS forecast_id"


def outputs(spark, sf):
    rows = fc.iv.apply_intervals(fc.future(spark, sf), fc.calibration(spark, sf))
    return wh.with_forecast_id(rows, ["model_name", "horizon", "date"])


@query(
    "g08_forecast_intervals",
    f"""WITH {fc.FUT}, o AS (SELECT *, {IDS} FROM app) SELECT forecast_id, 80 AS interval_level, round(lower_80, 6) AS lower_bound, round(upper_80, 6) AS upper_bound FROM o
    UNION ALL SELECT forecast_id, 95, round(lower_95, 6), round(upper_95, 6) FROM o""",
)
def _(spark, sf):
    return rounded(wh.forecast_intervals(outputs(spark, sf)))


@query(
    "g09_champions",
    f"""WITH {fc.BACK}, {fc.FOLD}, {fc.COMPARE} SELECT series_id, horizon, model_name, round(mean_mase * 0.7 + mean_rmse * 0.3, 6) AS composite_score FROM cmp
    QUALIFY row_number() OVER (PARTITION BY series_id, horizon ORDER BY mean_mase * 0.7 + mean_rmse * 0.3, model_name) = 1""",
)
def _(spark, sf):
    return rounded(wh.champions(fc.comparison(spark, sf), ["series_id", "horizon"]))


RECON = f"""{fc.COMP}, z AS (SELECT max(date) AS z FROM comp), tl AS (SELECT series_id, max_by(target, date) AS l FROM comp WHERE date > (SELECT z FROM z) - 7 GROUP BY 1),
 tt AS (SELECT date, sum(target) * 1.1 AS total FROM comp WHERE date > (SELECT z FROM z) - 7 GROUP BY 1)"""


@query(
    "g10_reconcile",
    f"""WITH {fc.COMP}, s AS (SELECT date, series_id AS station_id, target AS prediction, true AS modelled FROM comp WHERE series_id <> '5-LOW'), t AS (SELECT date, sum(target) AS total FROM comp GROUP BY 1),
    ss AS (SELECT date, sum(prediction) AS su FROM s GROUP BY 1), x AS (SELECT date, q.k AS station_id, greatest(total - coalesce(su, 0), 0) * 0.5 AS prediction, false AS modelled FROM t LEFT JOIN ss USING (date) CROSS JOIN (VALUES ('u1'), ('u2')) q(k)),
    u AS (SELECT * FROM s UNION ALL SELECT * FROM x), v AS (SELECT date, sum(prediction) AS su FROM u GROUP BY 1), r AS (SELECT date, CASE WHEN su > 0 THEN total / su END AS reconciliation_ratio FROM t JOIN v USING (date))
    SELECT u.date, station_id, round(prediction, 6) AS prediction, modelled, round(reconciliation_ratio, 6) AS reconciliation_ratio, round(prediction * coalesce(reconciliation_ratio, 1), 6) AS reconciled FROM u JOIN r ON u.date = r.date""",
)
def _(spark, sf):
    comp = fc.target(spark, sf)
    total = comp.groupBy("date").agg(F.sum("target").alias("prediction"))
    stations = comp.filter("series_id <> '5-LOW'").select("date", F.col("series_id").alias("station_id"), F.col("target").alias("prediction"))
    shares = comp.groupBy(F.lit(1).alias("one")).agg(F.count(F.lit(1))).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("station_id"), F.lit(0.5).alias("share")) for k in ("u1", "u2")]))
    )
    return rounded(wh.reconcile(total, stations, shares))


@query(
    "g11_drift",
    f"""WITH {fc.COMP}, e AS (SELECT series_id, max(date) AS z, min(target) AS lo, max(target) AS hi FROM comp GROUP BY 1),
    r AS (SELECT comp.series_id, target, date > z - 90 AS rec, CAST(least(floor((target - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin FROM comp JOIN e ON comp.series_id = e.series_id),
    b AS (SELECT series_id, bin, count_if(rec) AS r, count_if(NOT rec) AS b, sum(CASE WHEN rec THEN target END) AS rs, sum(CASE WHEN NOT rec THEN target END) AS bs FROM r GROUP BY 1, 2),
    p AS (SELECT *, (r + 0.5) / (sum(r) OVER w + 5) AS p, (b + 0.5) / (sum(b) OVER w + 5) AS q FROM b WINDOW w AS (PARTITION BY series_id))
    SELECT series_id, round(sum(rs) / sum(r), 6) AS recent_mean, round(sum(bs) / sum(b), 6) AS reference_mean, round(sum((p - q) * ln(p / q)), 6) AS psi, round(sum(rs) / sum(r) / (sum(bs) / sum(b)) - 1, 6) AS mean_shift FROM p GROUP BY 1""",
)
def _(spark, sf):
    return rounded(wh.drift(fc.target(spark, sf), ["series_id"]))


@query(
    "g12_quality",
    f"""WITH {COMPLETE}, o AS (SELECT count(*) AS n, count_if(missing_period_flag) AS m, count_if(trip_count < 0) AS g, count_if(is_observed AND avg_duration_minutes IS NULL) AS u FROM cb)
    SELECT 'row_count' AS check_name, CAST(n AS DOUBLE) AS check_value, 'pass' AS status FROM o UNION ALL SELECT 'missing_period_share', round(m / n, 6), CASE WHEN m / n > 0.2 THEN 'warn' ELSE 'pass' END FROM o
    UNION ALL SELECT 'negative_trip_counts', g, CASE WHEN g > 0 THEN 'warn' ELSE 'pass' END FROM o UNION ALL SELECT 'buckets_without_duration', u, CASE WHEN u > 0 THEN 'warn' ELSE 'pass' END FROM o""",
)
def _(spark, sf):
    return rounded(wh.quality(completed(spark, sf)))


@query(
    "g13_forecast_outputs",
    f"""WITH {fc.BACK}, st AS (SELECT series_id, min(date) AS s FROM comp GROUP BY 1) SELECT bk.series_id, fold_id, horizon, horizon_step, bk.date, model_name, prediction,
    sha256(concat_ws('|', bk.series_id, model_name, CAST(horizon AS VARCHAR), CAST(fold_id AS VARCHAR), CAST(bk.date AS VARCHAR))) AS forecast_id, s AS training_window_start, train_end AS training_window_end FROM bk JOIN st ON bk.series_id = st.series_id""",
)
def _(spark, sf):
    rows = fc.backtest(spark, sf).select("series_id", "fold_id", "horizon", "horizon_step", "date", "model_name", "prediction")
    windows = bt.rolling_windows(fc.target(spark, sf), ["series_id"], fc.CONFIG)
    return wh.forecast_outputs(
        rows, windows, ["series_id", "fold_id", "horizon"], ["series_id", "model_name", "horizon", "fold_id", "date"]
    )


@query(
    "g14_run_log",
    f"WITH {CLEAN} SELECT 'run-1' AS pipeline_run_id, (SELECT count(*) FROM raw) AS records_ingested, count(*) AS records_cleaned, min(start_time) AS min_event_timestamp, max(start_time) AS max_event_timestamp, 'success' AS status FROM clean",
)
def _(spark, sf):
    return wh.run_log(raw_trips(spark, sf), trips(spark, sf), "run-1")


@query(
    "g15_model_registry",
    f"""WITH {fc.SB} SELECT DISTINCT model_name, implementation, 'station_level' AS scope, 'baseline' AS family, false AS tuned, false AS experimental,
    CASE model_name WHEN 'naive' THEN 'Repeats the last value.' ELSE 'Repeats the last week.' END AS note FROM sbk""",
)
def _(spark, sf):
    return wh.model_registry(fc.station_scored(spark, sf))


# ---- reports ---------------------------------------------------------------------------------------------------------


def future_rows(spark, sf):
    return fc.iv.apply_intervals(fc.future(spark, sf), fc.calibration(spark, sf))


@query(
    "n01_station_chart",
    f"""WITH {fc.FUT}, h AS (SELECT date, target AS observed FROM comp ORDER BY date DESC LIMIT 90), f AS (SELECT date, point_forecast AS forecast, round(lower_80, 6) AS lower_80, round(upper_80, 6) AS upper_80 FROM app WHERE model_name = 'naive' AND horizon = 30)
    SELECT coalesce(h.date, f.date) AS date, observed, forecast, lower_80, upper_80 FROM h FULL JOIN f ON h.date = f.date""",
)
def _(spark, sf):
    total = bind(spark, sf, fc.SEGMENT_DAILY.replace("o_orderpriority", "'all'").replace("GROUP BY 1, 2", "GROUP BY 2"))
    observed = ft.complete_target(total, ["series_id"]).withColumnRenamed("series_id", "station_id")
    ahead = future_rows(spark, sf).withColumn("station_id", F.lit("all"))
    return rounded(rp.station_chart(observed, ahead, "all", "naive", 30))


@query("n02_system_chart", f"WITH {fc.FUT} SELECT date, point_forecast AS forecast, round(lower_80, 6) AS lower_80, round(upper_80, 6) AS upper_80 FROM app WHERE model_name = 'seasonal_naive_7' AND horizon = 90")
def _(spark, sf):
    return rounded(rp.system_chart(future_rows(spark, sf), "seasonal_naive_7", 90))


ONE = f"{fc.TOTAL}, {fc.FOLD}, {fc.COMPARE}"


def total_comparison(spark, sf):
    folds = bt.metrics(fc.total_backtest(spark, sf), ["model_name", "fold_id", "horizon"])
    return bt.compare_models(folds, ("model_name", "horizon"))


@query("n03_best_model", f"WITH {ONE} SELECT horizon, min_by(model_name, mean_mase) AS leading_model FROM cmp GROUP BY 1")
def _(spark, sf):
    return rp.best_model(total_comparison(spark, sf))


@query("n03_ranked_models", f"WITH {ONE} SELECT horizon, string_agg(model_name, ',' ORDER BY mean_mase, model_name) AS models FROM cmp GROUP BY 1")
def _(spark, sf):
    return rp.ranked_models(total_comparison(spark, sf)).withColumn("models", F.array_join("models", ","))


@query("n03_candidate_baseline", f"WITH {ONE} SELECT DISTINCT horizon, 'seasonal_naive_7' AS baseline FROM cmp")
def _(spark, sf):
    return rp.candidate_baseline(total_comparison(spark, sf))


@query("n04_decision_table", f"WITH {ONE} SELECT horizon, min_by(model_name, mean_mase) AS leading_model, CASE horizon WHEN 7 THEN 'primary' WHEN 30 THEN 'secondary' ELSE 'directional' END AS interpretation FROM cmp GROUP BY 1")
def _(spark, sf):
    return rp.decision_table(total_comparison(spark, sf), "primary", "secondary", "directional")


@query("n05_forecast_preview", f"WITH {fc.FUT} SELECT date, model_name, horizon, point_forecast, prediction, round(lower_80, 6) AS lower_80, round(upper_80, 6) AS upper_80 FROM app WHERE model_name = 'naive' AND horizon = 30 ORDER BY date LIMIT 12")
def _(spark, sf):
    return rounded(rp.forecast_preview(future_rows(spark, sf), "naive", 30))


@query("n06_slice_summary", f"WITH {fc.SB}, {fc.SLICES} SELECT model_name, horizon, slice_type, slice_value, {fc.EM} FROM sl8 WHERE horizon = 30 GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    rows = bt.slice_metrics(ft.attach_slices(fc.station_expanded(spark, sf), fc.slices(spark, sf)))
    return rounded(rp.slice_summary(rows, 30))


@query(
    "n07_category_members",
    "SELECT station_category AS label, station_id FROM (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, CASE s_nationkey % 3 WHEN 0 THEN 'sparse_intermittent' WHEN 1 THEN 'busy_stable' END AS station_category FROM supplier) t WHERE station_category IS NOT NULL",
)
def _(spark, sf):
    return rp.category_members(fc.slices(spark, sf))


@query("n08_top_label", "SELECT event_type, dayname(max_by(ts, value)) AS top_label FROM (SELECT event_type, max(ts) AS ts, value FROM events GROUP BY event_type, value) t GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type", "value").agg(F.max("ts").alias("ts"))
    return rp.top_label(rows.withColumn("day", F.date_format("ts", "EEEE")), "day", "value", ["event_type"])


@query("n08_sum_metric", f"WITH raw AS ({{RAW}}) SELECT bike_type, sum(coalesce(try_cast(nullif(duration, '') AS DOUBLE), 0)) AS total FROM raw GROUP BY 1".replace("{RAW}", __import__("ridegauge.plans.bindings", fromlist=["RAW_TRIPS"]).RAW_TRIPS))
def _(spark, sf):
    return rp.sum_metric(raw_trips(spark, sf), "duration", ["bike_type"])


@query("n09_summary_lookup", "SELECT CAST(s_suppkey AS VARCHAR) AS station_id, 'busy_stable' AS station_category FROM supplier WHERE s_nationkey % 3 = 1")
def _(spark, sf):
    return rp.summary_lookup(fc.slices(spark, sf), "busy_stable").select("station_id", "station_category")
