"""Fitted forecasts and station clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge.catalog import forecasting as fc, stations as st
from ridegauge.catalog.base import query, rounded
from ridegauge.config import StationConfig
from ridegauge.operators import backtest as bt, categories as cat, clustering as cl, features as ft, intervals as iv, models as md
from ridegauge.plans.bindings import table
from ridegauge.plans.station import slice_lookup

KEYS = ["series_id"]


# ---- clusters --------------------------------------------------------------------------------------------------------


@query(
    "j05_cluster_eligibility",
    f"""WITH {st.LABELS} SELECT station_id, cluster_ineligible_reason, cluster_ineligible_reason = 'eligible' AS cluster_eligible FROM (SELECT station_id,
    CASE WHEN history_group <> 'mature' THEN 'history_group_not_cluster_eligible' WHEN NOT coalesce(coverage_ratio >= 0.7, false) THEN 'coverage_too_low_for_clustering'
    WHEN observed_days < 120 THEN 'insufficient_observed_days_for_clustering' WHEN NOT metric_reliable_behavior THEN 'insufficient_behavior_reliability' ELSE 'eligible' END AS cluster_ineligible_reason FROM lab) q""",
)
def _(spark, sf):
    rows = cl.cluster_eligibility(st.summary(spark, sf, st.LABEL_DAILY_SPARK))
    return rows.select("station_id", "cluster_ineligible_reason", "cluster_eligible")


@query("j06_cluster_matrix")
def _(spark, sf):
    rows = cl.cluster_eligibility(st.summary(spark, sf, st.LABEL_DAILY_SPARK)).filter("observed_days >= 120")
    return rounded(cl.cluster_matrix(rows)[0])


@query(
    "j08_ari",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS bth FROM c),
    x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a) q), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b) q)
    SELECT round((bth - x.v * y.v / (s.n * (s.n - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (s.n * (s.n - 1) / 2)), 9) AS ari FROM s, x, y""",
)
def _(spark, sf):
    return rounded(cl.ari(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), 9)


CAND = """SELECT s_nationkey + 2 AS candidate_k, avg(s_acctbal) AS silhouette_score, CAST(count(*) % 2 AS DOUBLE) AS seed_stability_ari, CAST(count(*) % 3 AS DOUBLE) AS bootstrap_stability_ari,
  s_nationkey % 2 = 0 AS all_clusters_valid FROM supplier GROUP BY s_nationkey"""


@query(
    "j10_select_k",
    f"""WITH c AS ({CAND}), r AS (SELECT *, row_number() OVER (ORDER BY all_clusters_valid DESC, bootstrap_stability_ari DESC, seed_stability_ari DESC, silhouette_score DESC, abs(candidate_k - 6), candidate_k) = 1 AS selected FROM c)
    SELECT candidate_k, selected, CASE WHEN NOT selected THEN '' WHEN all_clusters_valid THEN 'best_balance_of_valid_cluster_sizes_stability_and_silhouette' ELSE 'selected_despite_size_issues_due_to_limited_valid_candidates' END AS selection_reason FROM r""",
)
def _(spark, sf):
    candidates = spark.sql(CAND.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf, "supplier"))
    return cl.select_k(candidates, 6).select("candidate_k", "selected", "selection_reason")


CENTERS = [(-0.1, -0.1), (0.1, 0.0), (0.0, 0.2)]


@query(
    "j11_assignment_margin",
    """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS station_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    d AS (SELECT station_id, c, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM e CROSS JOIN (VALUES (0, -0.1, -0.1), (1, 0.1, 0.0), (2, 0.0, 0.2)) k(c, cx, cy)),
    r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, c) AS r FROM d), p AS (SELECT station_id, max(CASE WHEN r = 1 THEN c END) AS raw_cluster, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM r GROUP BY 1)
    SELECT station_id, raw_cluster, round((d2 - d1) / greatest(d2, 1e-9), 6) AS distance_margin, CASE WHEN (d2 - d1) / d2 >= 0.35 THEN 'high' WHEN (d2 - d1) / d2 >= 0.15 THEN 'medium' ELSE 'low' END AS cluster_assignment_confidence FROM p""",
)
def _(spark, sf):
    e = F.col("embedding")
    matrix = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("station_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y")
    )
    return rounded(cl.assignment_margin(matrix, CENTERS, 0.9))


CLUSTERED = """cu AS (SELECT CAST(c_custkey AS VARCHAR) AS station_id, c_nationkey % 5 AS raw_cluster, c_acctbal AS avg_demand_observed, c_acctbal / 10000 AS zero_rate_observed, c_mktsegment AS behavior_label FROM customer),
 pr AS (SELECT raw_cluster, 'cluster_' || CAST(row_number() OVER (ORDER BY avg(avg_demand_observed) DESC, avg(zero_rate_observed), raw_cluster) AS VARCHAR) AS cluster_label FROM cu GROUP BY 1),
 rl AS (SELECT cu.*, cluster_label FROM cu JOIN pr ON cu.raw_cluster = pr.raw_cluster)"""


def clustered(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("station_id"), (F.col("c_nationkey") % 5).alias("raw_cluster"),
        F.col("c_acctbal").alias("avg_demand_observed"), (F.col("c_acctbal") / 10000).alias("zero_rate_observed"), F.col("c_mktsegment").alias("behavior_label"),
    )
    return cl.relabel(rows)


@query("j12_relabel", f"WITH {CLUSTERED} SELECT station_id, raw_cluster, cluster_label FROM rl")
def _(spark, sf):
    return clustered(spark, sf).select("station_id", "raw_cluster", "cluster_label")


@query(
    "j13_cluster_profile",
    f"""WITH {CLUSTERED}, m AS (SELECT cluster_label, behavior_label FROM rl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, behavior_label) = 1)
    SELECT rl.cluster_label, count(DISTINCT station_id) AS station_count, round(avg(avg_demand_observed), 6) AS avg_demand_mean, round(avg(zero_rate_observed), 6) AS zero_rate_mean, any_value(m.behavior_label) AS behavior_mode, 'low' AS cluster_assignment_confidence_mode
    FROM rl JOIN m ON rl.cluster_label = m.cluster_label GROUP BY 1""",
)
def _(spark, sf):
    extra = {c: F.col("zero_rate_observed") for c in cl.PROFILE_MEANS.values() if c not in ("avg_demand_observed", "zero_rate_observed")}
    rows = clustered(spark, sf).withColumns(extra).withColumn("cluster_assignment_confidence", F.lit("low"))
    return rounded(cl.cluster_profile(rows).select("cluster_label", "station_count", "avg_demand_mean", "zero_rate_mean", "behavior_mode", "cluster_assignment_confidence_mode"))


@query("j07_j09_cluster_selection")
def _(spark, sf):
    return rounded(cl.cluster_stations(st.categorized(spark, sf), StationConfig())[2])


@query("j14_cluster_stations")
def _(spark, sf):
    out = cl.cluster_stations(st.categorized(spark, sf), StationConfig())[0]
    return out.select("station_id", "cluster_eligible", "cluster_ineligible_reason", "cluster_label", "cluster_assignment_confidence")


@query("a13_slice_lookup")
def _(spark, sf):
    return slice_lookup(st.daily(spark, sf, st.LABEL_DAILY_SPARK), None, StationConfig())


# ---- guards and production -------------------------------------------------------------------------------------------

SHAPE = "CASE comp.series_id WHEN '1-URGENT' THEN -1 WHEN '2-HIGH' THEN 1000000 WHEN '3-MEDIUM' THEN s WHEN '5-LOW' THEN 3 + 2 * (s % 2) ELSE 1 END"
GUARD = f"""{fc.COMP}, z AS (SELECT series_id, max(date) AS z FROM comp GROUP BY 1), f0 AS (SELECT comp.series_id, s, CAST(z + CAST(s AS INT) AS DATE) AS date, CAST({SHAPE} AS DOUBLE) AS prediction FROM comp JOIN z ON comp.series_id = z.series_id AND comp.date = z.z CROSS JOIN (SELECT unnest(range(1, 31)) AS s) k),
 rr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM comp),
 ub AS (SELECT series_id, greatest(max(target) * 3, quantile_cont(target, 0.99) * 4, avg(CASE WHEN r <= 90 THEN target END) + 10 * greatest(stddev_pop(CASE WHEN r <= 90 THEN target END), 1), 1000) AS ub,
   avg(CASE WHEN r <= 30 THEN target END) AS rm, max(CASE WHEN r <= 30 THEN target END) AS rx FROM rr GROUP BY 1),
 fx AS (SELECT series_id, min(prediction) AS mn, max(prediction) AS mx, max_by(prediction, s) AS e FROM f0 GROUP BY 1),
 vd AS (SELECT fx.series_id, CASE WHEN mn < 0 THEN 'negative_forecast_values' WHEN mx > ub THEN 'forecast_exceeds_plausible_upper_bound' WHEN e > greatest(rx * 1.6, rm * 1.75) THEN 'implausible_upward_drift'
   WHEN mx - mn > greatest(rm, rx * 0.75) THEN 'excessive_medium_horizon_volatility' END AS reason, mx > ub AS weak FROM fx JOIN ub ON fx.series_id = ub.series_id)"""


def shaped(spark, sf):
    ahead = ft.future_dates(fc.target(spark, sf), KEYS, 30)
    s, k = F.col("horizon_step"), F.col("series_id")
    p = F.when(k == "1-URGENT", -1).when(k == "2-HIGH", 1000000).when(k == "3-MEDIUM", s).when(k == "5-LOW", 3 + 2 * (s % 2)).otherwise(1)
    return ahead.withColumn("prediction", p.cast("double"))


@query("l04_implausible", f"WITH {GUARD} SELECT series_id, reason IS NOT NULL AS implausible, reason FROM vd")
def _(spark, sf):
    return md.implausible(shaped(spark, sf), fc.target(spark, sf), KEYS, 30)


for _name, _strong, _bad in (("l03_guard", False, "weak"), ("l04_strong_guard", True, "reason IS NOT NULL")):

    def _make(strong):
        return lambda spark, sf: rounded(md.guard(shaped(spark, sf), fc.target(spark, sf), KEYS, 30, "m", strong).drop("fallback_reason"))

    query(
        _name,
        f"""WITH {GUARD} SELECT f0.series_id, f0.date, s AS horizon_step, CASE WHEN {_bad} THEN greatest(rr.target, 0) ELSE greatest(prediction, 0) END AS prediction, CASE WHEN {_bad} THEN 'm_fallback' ELSE 'm' END AS model_name, {_bad} AS fallback_triggered
        FROM f0 JOIN vd ON f0.series_id = vd.series_id JOIN rr ON rr.series_id = f0.series_id AND rr.r = 7 - (s - 1) % 7""",
    )(_make(_strong))


@query(
    "l10_recursive_stub",
    f"WITH {fc.SP}, e AS (SELECT max(date) AS z FROM sp), l AS (SELECT DISTINCT station_id FROM sp) SELECT l.station_id, CAST(z + CAST(s AS INT) AS DATE) AS date, s AS horizon_step, sp.target + s AS prediction FROM l CROSS JOIN e CROSS JOIN (SELECT unnest(range(1, 31)) AS s) k LEFT JOIN sp ON sp.station_id = l.station_id AND sp.date = z",
)
def _(spark, sf):
    stub = lambda rows: rows.withColumn("prediction", F.col("lag_1") + 1)
    return md.predict_recursive(fc.station_panel(spark, sf), 30, stub)


ACTIVE = f"{fc.SP}, act AS (SELECT station_id, count(DISTINCT date) AS recent_service_days FROM sp WHERE in_service AND date > (SELECT max(date) FROM sp) - 90 GROUP BY 1 HAVING count(DISTINCT date) >= 10)"


@query("l16_active_stations", f"WITH {ACTIVE} SELECT * FROM act")
def _(spark, sf):
    return md.active_stations(fc.station_panel(spark, sf), 90, 10)


def station_future(spark, sf):
    panel = fc.station_panel(spark, sf)
    origins = bt.station_origins(panel, fc.STATION, bt.production_folds(panel))
    raw = bt.station_baselines(origins, 30).select("station_id", "date", "horizon_step", "model_name", "implementation", "prediction")
    calibration = iv.calibrate(iv.residuals(fc.station_expanded(spark, sf)), 24)
    return md.production(panel, raw, calibration, (7, 30), fc.slices(spark, sf), 90, 10)


@query(
    "l15_production",
    f"""WITH {ACTIVE}, z AS (SELECT max(date) AS z FROM sp), o1 AS (SELECT station_id, max_by(target, date) AS lastv FROM sp WHERE target IS NOT NULL GROUP BY 1),
    sl AS (SELECT o1.station_id, lastv, j, sp.target AS v FROM o1 CROSS JOIN z CROSS JOIN (SELECT unnest(range(1, 8)) AS j) q LEFT JOIN sp ON sp.station_id = o1.station_id AND sp.date = z - 7 + CAST(j AS INT)),
    sv AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY j ROWS UNBOUNDED PRECEDING), lastv) AS f FROM sl),
    r AS (SELECT station_id, s, 'naive' AS model_name, lastv AS prediction FROM o1 CROSS JOIN (SELECT unnest(range(1, 31)) AS s) q UNION ALL SELECT station_id, s, 'seasonal_naive_7', f FROM sv JOIN (SELECT unnest(range(1, 31)) AS s) q ON (s - 1) % 7 + 1 = j)
    SELECT r.station_id, CAST(z + CAST(s AS INT) AS DATE) AS date, s AS horizon_step, h.horizon, model_name, prediction FROM r JOIN act ON act.station_id = r.station_id CROSS JOIN z JOIN (VALUES (7), (30)) h(horizon) ON s <= h.horizon""",
)
def _(spark, sf):
    return station_future(spark, sf).select("station_id", "date", "horizon_step", "horizon", "model_name", "prediction")


@query("l15_production_intervals")
def _(spark, sf):
    return rounded(station_future(spark, sf))


# ---- fitted models ---------------------------------------------------------------------------------------------------


@query("l05_fourier_regression")
def _(spark, sf):
    return rounded(md.fourier_regression(fc.target(spark, sf), KEYS, 30))


@query("l06_ets")
def _(spark, sf):
    return rounded(md.ets(fc.target(spark, sf), KEYS, 30))


@query("l07_differenced_regression")
def _(spark, sf):
    return rounded(md.differenced_regression(fc.target(spark, sf), KEYS, 30))


@query("m20_fit_diagnostics")
def _(spark, sf):
    return rounded(iv.fit_diagnostics(md.differenced_regression(fc.target(spark, sf), KEYS, 30)))


# The test windows of all folds and horizons, without forecasts.
WINDOWS = f"""{fc.BACK.split(", pr AS MATERIALIZED")[0].rsplit(",\n pr AS", 1)[0]},
 one AS MATERIALIZED (SELECT t.series_id, t.fold_id, t.horizon, t.step AS horizon_step, t.date, o.date AS train_end, t.actual FROM tst t JOIN ix o ON o.series_id = t.series_id AND o.i = t.cut - 1)"""


@query(
    "m03_fitted_backtest",
    f"""WITH {WINDOWS} SELECT series_id, fold_id, horizon, horizon_step, date, train_end, round(actual, 6) AS actual, m.model, true AS non_negative
    FROM one CROSS JOIN (VALUES ('ets'), ('fourier_dynamic_regression'), ('seasonal_difference_regression')) m(model)""",
)
def _(spark, sf):
    rows = md.fitted_backtest(fc.target(spark, sf), KEYS, fc.CONFIG)
    model = F.regexp_replace("model_name", "_fallback$", "").alias("model")
    return rounded(rows.select("series_id", "fold_id", "horizon", "horizon_step", "date", "train_end", "actual", model, (F.col("prediction") >= 0).alias("non_negative")))


@query(
    "m10_compare_all_models",
    f"""WITH {WINDOWS}, f AS (SELECT series_id, m.model AS model_name, horizon, fold_id, count(actual) AS n FROM one
      CROSS JOIN (VALUES ('naive'), ('seasonal_naive_7'), ('seasonal_naive_30'), ('ets'), ('fourier_dynamic_regression'), ('seasonal_difference_regression')) m(model) GROUP BY 1, 2, 3, 4)
    SELECT series_id, model_name, horizon, count(DISTINCT fold_id) AS folds, round(avg(n), 6) AS mean_rows FROM f GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    fitted = md.fitted_backtest(fc.target(spark, sf), KEYS, fc.CONFIG).withColumn("model_name", F.regexp_replace("model_name", "_fallback$", ""))
    every = bt.baseline_backtest(fc.target(spark, sf), KEYS, fc.CONFIG).unionByName(fitted)
    folds = bt.metrics(every, ["series_id", "model_name", "fold_id", "horizon"])
    return rounded(bt.compare_models(folds, ("series_id", "model_name", "horizon")).select("series_id", "model_name", "horizon", "folds", "mean_rows"))


# SQL cannot fit these models; forecasts, errors and ranks are tested against fits of cut series.


@query("m03_fitted_forecasts")
def _(spark, sf):
    rows = md.fitted_backtest(fc.target(spark, sf), KEYS, fc.CONFIG)
    return rounded(rows.select("series_id", "fold_id", "horizon", "horizon_step", "date", "train_end", "actual", "model_name", "prediction"))


@query("m10_rank_all_models")
def _(spark, sf):
    every = bt.baseline_backtest(fc.target(spark, sf), KEYS, fc.CONFIG).unionByName(md.fitted_backtest(fc.target(spark, sf), KEYS, fc.CONFIG))
    folds = bt.metrics(every, ["series_id", "model_name", "fold_id", "horizon"])
    return rounded(bt.compare_models(folds, ("series_id", "model_name", "horizon")))


def tree_rows(panel):
    mapping = ft.category_map(panel, "station_id")
    frame = ft.encode(ft.station_features(panel), "station_id", mapping, "station_code")
    return ft.training_rows(frame, [c for c in md.TREE_COLUMNS if c != "station_code"])


@query("l08_l10_station_trees")
def _(spark, sf):
    panel = fc.station_panel(spark, sf)
    chosen = {family: params for family, (params, _) in md.tune_families(tree_rows(panel), md.TREE_GRID, 30).items()}
    return rounded(md.station_tree_families(panel, 30, chosen))


@query("l09_tune")
def _(spark, sf):
    out = None
    for family, (_, table_) in md.tune_families(tree_rows(fc.station_panel(spark, sf)), md.TREE_GRID, 30).items():
        tuned = table_.withColumn("family", F.lit(family))
        out = tuned if out is None else out.unionByName(tuned)
    return rounded(out)


@query("l14_run_family")
def _(spark, sf):
    return rounded(md.run_family(fc.target(spark, sf), KEYS))
