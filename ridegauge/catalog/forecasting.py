"""Targets, features, backtests, metrics and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge.catalog.base import query, rounded
from ridegauge.config import BacktestConfig, StationForecastConfig, season_length
from ridegauge.functions.stats import gaussian_bounds, order_bounds, winkler
from ridegauge.operators import backtest as bt, features as ft, intervals as iv
from ridegauge.operators.keyed import spread_days
from ridegauge.plans.bindings import DENSE_DAILY, SEGMENT_DAILY, bind, table

KEYS = ["series_id"]
CONFIG = BacktestConfig()
STATION = StationForecastConfig()

COMP = f"""sd AS ({SEGMENT_DAILY}), cg AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM sd GROUP BY 1),
 comp AS (SELECT cg.series_id, cg.date, coalesce(sd.target, 0) AS target, CASE WHEN sd.target IS NULL THEN 1 ELSE 0 END AS missing_period_flag, 'system_level' AS series_scope
   FROM cg LEFT JOIN sd ON cg.series_id = sd.series_id AND cg.date = sd.date)"""
WIN = f"""{COMP}, ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM comp),
 cuts AS (SELECT series_id, horizon, unnest(range(730, n - horizon + 1, 7)) AS cut FROM (SELECT DISTINCT series_id, n FROM ix) q CROSS JOIN (VALUES (7), (30)) h(horizon)),
 kept AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY series_id, horizon ORDER BY cut DESC) <= 8),
 win AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY cut) AS fold_id FROM kept)"""
BACK = f"""{WIN}, d7 AS (SELECT series_id, i, target - lag(target, 7) OVER (PARTITION BY series_id ORDER BY date) AS d FROM ix),
 sc AS MATERIALIZED (SELECT w.series_id, w.horizon, w.fold_id, avg(abs(d)) AS s FROM win w JOIN d7 ON w.series_id = d7.series_id AND d7.i < w.cut GROUP BY 1, 2, 3),
 tst AS MATERIALIZED (SELECT w.*, x.date, x.target AS actual, x.i - w.cut + 1 AS step FROM win w JOIN ix x ON w.series_id = x.series_id AND x.i >= w.cut AND x.i < w.cut + w.horizon),
 pr AS MATERIALIZED (SELECT t.*, o.date AS train_end, m.model_name, coalesce(v.target, 0) AS prediction, CASE WHEN sc.s > 0 THEN sc.s ELSE 1 END AS mase_scale
   FROM tst t CROSS JOIN (VALUES ('naive', 1), ('seasonal_naive_7', 7), ('seasonal_naive_30', 30)) m(model_name, p)
   JOIN ix o ON o.series_id = t.series_id AND o.i = t.cut - 1
   JOIN ix v ON v.series_id = t.series_id AND v.i = t.cut - m.p + (t.step - 1) % m.p
   JOIN sc ON sc.series_id = t.series_id AND sc.horizon = t.horizon AND sc.fold_id = t.fold_id),
 bk AS (SELECT series_id, fold_id, horizon, step AS horizon_step, date, train_end, actual, mase_scale, model_name, prediction FROM pr WHERE mase_scale > 0)"""
FOLD = """fm AS (SELECT series_id, model_name, fold_id, horizon, avg(abs(prediction - actual)) AS mae, sqrt(avg((prediction - actual) ** 2)) AS rmse, avg(prediction - actual) AS bias,
  count(actual) AS rows, avg(abs(prediction - actual) / mase_scale) AS mase FROM bk GROUP BY 1, 2, 3, 4)"""
COMPARE = """cmp AS (SELECT series_id, model_name, horizon, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(mase) AS mean_mase, avg(bias) AS mean_bias, count(DISTINCT fold_id) AS folds, avg(rows) AS mean_rows FROM fm GROUP BY 1, 2, 3)"""
MEANS = "round(mean_mae, 6) AS mean_mae, round(mean_rmse, 6) AS mean_rmse, round(mean_mase, 6) AS mean_mase, round(mean_bias, 6) AS mean_bias, folds, round(mean_rows, 6) AS mean_rows"
RES = """rs AS (SELECT model_name, horizon, horizon_step, date AS target_date, prediction AS point_forecast, actual, actual - prediction AS residual FROM bk WHERE series_id = series_id)"""


def target(spark, sf):
    return ft.complete_target(bind(spark, sf, SEGMENT_DAILY), KEYS)


def backtest(spark, sf):
    return bt.baseline_backtest(target(spark, sf), KEYS, CONFIG)


def fold_metrics(spark, sf):
    return bt.metrics(backtest(spark, sf), ["series_id", "model_name", "fold_id", "horizon"])


def comparison(spark, sf):
    return bt.compare_models(fold_metrics(spark, sf), ("series_id", "model_name", "horizon"))


# ---- K ---------------------------------------------------------------------------------------------------------------


@query("k01_complete_target", f"WITH {COMP} SELECT * FROM comp")
def _(spark, sf):
    return target(spark, sf)


@query(
    "k01_complete_target_keep_na",
    f"""WITH d AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS target FROM orders GROUP BY 1, 2),
    g AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY 1)
    SELECT g.series_id, g.date, d.target, CASE WHEN d.target IS NULL THEN 1 ELSE 0 END AS missing_period_flag, 'system_level' AS series_scope FROM g LEFT JOIN d ON g.series_id = d.series_id AND g.date = d.date""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("target"), "o_orderkey"
    )
    return ft.complete_target(rows, KEYS, "keep_na_with_flag", order=["o_orderkey"])


@query("k02_future_dates", f"WITH {COMP} SELECT series_id, CAST(z + CAST(s AS INT) AS DATE) AS date, s AS horizon_step FROM (SELECT series_id, max(date) AS z FROM comp GROUP BY 1) q CROSS JOIN (SELECT unnest(range(1, 31)) AS s) k")
def _(spark, sf):
    return ft.future_dates(target(spark, sf), KEYS, 30)


@query(
    "k03_uncovered_dates",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'P'",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("known_price")
    )
    return ft.uncovered_dates(rows, ["known_price"])


CAL = """isodow(date) - 1 AS day_of_week, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, week(date) AS week_of_year, month(date) AS month, quarter(date) AS quarter, year(date) AS year,
 day(date) AS day_of_month, dayofyear(date) AS day_of_year, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' WHEN month(date) <= 8 THEN 'summer' ELSE 'fall' END AS season_tag,
 CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1 WHEN month(date) <= 8 THEN 2 ELSE 3 END AS season_code"""
FIXED = "(month({0}) = 1 AND day({0}) = 1 OR month({0}) = 6 AND day({0}) = 19 AND year({0}) >= 2021 OR month({0}) = 7 AND day({0}) = 4 OR month({0}) = 11 AND day({0}) = 11 OR month({0}) = 12 AND day({0}) = 25)"
HOLIDAY = f"""CASE WHEN {FIXED.format('date')} OR isodow(date) = 5 AND {FIXED.format('(date + 1)')} OR isodow(date) = 1 AND {FIXED.format('(date - 1)')}
 OR isodow(date) = 1 AND (month(date) IN (1, 2) AND day(date) BETWEEN 15 AND 21 OR month(date) = 5 AND day(date) >= 25 OR month(date) = 9 AND day(date) <= 7 OR month(date) = 10 AND day(date) BETWEEN 8 AND 14)
 OR isodow(date) = 4 AND month(date) = 11 AND day(date) BETWEEN 22 AND 28 THEN 1 ELSE 0 END AS is_holiday"""


@query("k04_calendar_features", f"WITH {COMP} SELECT series_id, date, {CAL}, {HOLIDAY} FROM comp")
def _(spark, sf):
    return ft.calendar_features(target(spark, sf).select("series_id", "date"))


@query("k05_holiday_flag", f"WITH {COMP} SELECT series_id, date, {HOLIDAY} FROM comp")
def _(spark, sf):
    return ft.holiday_flag(target(spark, sf).select("series_id", "date"))


@query("k05_holiday_table", f"WITH {COMP}, h AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_quantity = 50) SELECT series_id, comp.date, CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_holiday FROM comp LEFT JOIN h ON comp.date = h.date")
def _(spark, sf):
    days = table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.to_date("l_shipdate").alias("date"))
    return ft.holiday_flag(target(spark, sf).select("series_id", "date"), days)


_FOURIER = ", ".join(
    f"round({fn}(2 * pi() * {k} * date_diff('day', DATE '2000-01-01', date) / {period}), 6) AS {name}_{fn}_{k}"
    for name, period in (("weekly", "7.0::DOUBLE"), ("yearly", "365.25::DOUBLE"))
    for k in (1, 2, 3)
    for fn in ("sin", "cos")
)


@query("k06_fourier", f"WITH {COMP} SELECT series_id, date, {_FOURIER.replace('round(', 'round(0.0 + ')} FROM comp")
def _(spark, sf):
    return rounded(ft.fourier_features(target(spark, sf).select("series_id", "date")))


_LAGS = ", ".join(f"lag(target, {n}) OVER w AS lag_{n}" for n in CONFIG.lags)


@query("k07_lags", f"WITH {COMP} SELECT series_id, date, {_LAGS} FROM comp WINDOW w AS (PARTITION BY series_id ORDER BY date)")
def _(spark, sf):
    return ft.lag_features(target(spark, sf), KEYS, CONFIG.lags).select("series_id", "date", *[f"lag_{n}" for n in CONFIG.lags])


_ROLL, _ROLLW = [], []
for _w in CONFIG.rolling_windows:
    _least = max(2, min(_w, 7))
    for _n, _f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
        _ROLL.append(f"round(CASE WHEN count(target) OVER w{_w} >= {_least} THEN {_f}(target) OVER w{_w} END, 6) AS rolling_{_n}_{_w}")
    _ROLLW.append(f"w{_w} AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {_w} PRECEDING AND 1 PRECEDING)")


@query("k08_rolling", f"WITH {COMP} SELECT series_id, date, {', '.join(_ROLL)} FROM comp WINDOW {', '.join(_ROLLW)}")
def _(spark, sf):
    return rounded(ft.rolling_features(target(spark, sf), KEYS, CONFIG.rolling_windows).drop("target", "missing_period_flag", "series_scope"))


@query(
    "k10_system_features",
    f"WITH {COMP} SELECT series_id, date, target, missing_period_flag, series_scope, {CAL}, {HOLIDAY}, {_FOURIER.replace('round(', 'round(0.0 + ')}, {_LAGS}, {', '.join(_ROLL)} FROM comp WINDOW w AS (PARTITION BY series_id ORDER BY date), {', '.join(_ROLLW)}",
)
def _(spark, sf):
    return rounded(ft.system_features(target(spark, sf), KEYS, CONFIG.lags, CONFIG.rolling_windows))


# Station panel: the dense panel completed inside each station's own range.
SP = f"""dd AS ({DENSE_DAILY}), sg AS (SELECT station_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM dd GROUP BY 1),
 sp AS (SELECT sg.station_id, sg.date, dd.target, dd.target IS NOT NULL AS in_service FROM sg LEFT JOIN dd ON sg.station_id = dd.station_id AND sg.date = dd.date)"""


def station_panel(spark, sf):
    full = ft.fill_dates(spread_days(bind(spark, sf, DENSE_DAILY), "station_id"), ["station_id"], ["target"])
    return full.withColumn("in_service", F.col("target").isNotNull())


SFEAT = f"""{SP}, sf AS (SELECT station_id, date, target, in_service, greatest(date_diff('day', min(CASE WHEN in_service THEN date END) OVER (PARTITION BY station_id), date), 0) AS station_age_days,
  isodow(date) - 1 AS day_of_week, month(date) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, {HOLIDAY}, lag(target) OVER w AS lag_1, lag(target, 7) OVER w AS lag_7, lag(target, 14) OVER w AS lag_14,
  CASE WHEN count(target) OVER a >= 3 THEN avg(target) OVER a END AS rolling_mean_7, CASE WHEN count(target) OVER b >= 7 THEN avg(target) OVER b END AS rolling_mean_28,
  CASE WHEN count(target) OVER b >= 7 THEN stddev_samp(target) OVER b END AS rolling_std_28 FROM sp
  WINDOW w AS (PARTITION BY station_id ORDER BY date), a AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))"""
_SF_SQL = "station_id, date, station_age_days, day_of_week, month, is_weekend, is_holiday, lag_1, lag_7, lag_14, round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_mean_28, 6) AS rolling_mean_28, round(rolling_std_28, 6) AS rolling_std_28"


@query("k09_station_age", f"WITH {SFEAT} SELECT station_id, date, station_age_days FROM sf")
def _(spark, sf):
    return ft.station_age(station_panel(spark, sf)).select("station_id", "date", "station_age_days")


@query("k10_station_features", f"WITH {SFEAT}, l AS (SELECT s_suppkey, 'n' || CAST(s_nationkey AS VARCHAR) AS station_category FROM supplier) SELECT {_SF_SQL}, station_category FROM sf LEFT JOIN l ON station_id = CAST(s_suppkey AS VARCHAR)")
def _(spark, sf):
    labels = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("station_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("station_category")
    )
    return rounded(ft.station_features(station_panel(spark, sf), labels).drop("target", "in_service"))


@query("k11_training_rows", f"WITH {SFEAT} SELECT {_SF_SQL} FROM sf WHERE in_service AND target IS NOT NULL AND rolling_mean_7 IS NOT NULL AND rolling_mean_28 IS NOT NULL")
def _(spark, sf):
    rows = ft.training_rows(ft.station_features(station_panel(spark, sf)), ["rolling_mean_7", "rolling_mean_28"])
    return rounded(rows.drop("target", "in_service"))


@query("k12_feature_roles")
def _(spark, sf):
    frame = ft.system_features(target(spark, sf), KEYS, CONFIG.lags, CONFIG.rolling_windows)
    roles = ft.feature_roles(frame)
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("column")) for r, cs in roles.items() for c in cs])
    return frame.groupBy(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(pairs))


_FUT = """e AS (SELECT max(date) AS z FROM sp), f AS (SELECT station_id, z + CAST(s AS INT) AS date, CAST(s AS INT) AS horizon_step, fst FROM (SELECT station_id, min(CASE WHEN in_service THEN date END) AS fst FROM sp GROUP BY 1) q CROSS JOIN e CROSS JOIN (SELECT unnest(range(1, 4)) AS s) k),
 h AS (SELECT f.station_id, f.date, f.horizon_step, f.fst, sp.date AS hd, sp.target AS t FROM f LEFT JOIN sp ON f.station_id = sp.station_id AND sp.date >= f.date - 28 AND sp.date < f.date AND sp.date > (SELECT z - 28 FROM e))"""


@query(
    "k13_future_rows",
    f"""WITH {SP}, {_FUT}, g AS (SELECT station_id, date, horizon_step, greatest(date_diff('day', any_value(fst), date), 0) AS station_age_days, max(CASE WHEN hd = date - 1 THEN t END) AS lag_1, max(CASE WHEN hd = date - 7 THEN t END) AS lag_7, max(CASE WHEN hd = date - 14 THEN t END) AS lag_14,
    round(CASE WHEN count(CASE WHEN hd >= date - 7 THEN t END) >= 3 THEN avg(CASE WHEN hd >= date - 7 THEN t END) END, 6) AS rolling_mean_7, round(CASE WHEN count(t) >= 7 THEN avg(t) END, 6) AS rolling_mean_28,
    round(CASE WHEN count(t) >= 7 THEN stddev_samp(t) END, 6) AS rolling_std_28 FROM h GROUP BY 1, 2, 3)
    SELECT *, isodow(date) - 1 AS day_of_week, month(date) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, {HOLIDAY} FROM g""",
)
def _(spark, sf):
    return rounded(ft.future_station_rows(station_panel(spark, sf), 3))


@query(
    "k14_encode",
    "WITH m AS (SELECT p_brand AS v, dense_rank() OVER (ORDER BY p_brand) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 40) q) SELECT p_partkey, coalesce(code, 0) AS brand_code FROM part LEFT JOIN m ON p_brand = v",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    mapping = ft.category_map(part.filter("p_size < 40"), "p_brand")
    return ft.encode(part, "p_brand", mapping, "brand_code").select("p_partkey", "brand_code")


@query("k15_prepare_exog")
def _(spark, sf):
    frame = ft.known_future_frame(target(spark, sf)).withColumn("constant", F.lit(1.0)).withColumn("double_weekend", F.col("is_weekend") * 2)
    future = ft.known_future_frame(ft.future_dates(target(spark, sf), KEYS, 30))
    names = ["is_weekend", "double_weekend", "is_holiday", "constant", "yearly_sin_1", "yearly_cos_1", "day_of_year"]
    train, ahead, used = ft.prepare_exog(frame, future, names)
    return rounded(train.select("series_id", "date", *used).unionByName(ahead.select("series_id", "date", *used)))


@query("k16_cap_history", f"WITH {COMP} SELECT series_id, date, target FROM comp QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 1095")
def _(spark, sf):
    return ft.cap_history(target(spark, sf), KEYS, 1095).select("series_id", "date", "target")


@query(
    "k17_station_scale",
    f"WITH {SFEAT}, s AS (SELECT station_id, greatest(avg(abs(target)), 1) AS scale FROM sp WHERE target IS NOT NULL GROUP BY 1) SELECT sf.station_id, date, round(target / scale, 6) AS target, round(lag_1 / scale, 6) AS lag_1, round(rolling_mean_28 / scale, 6) AS rolling_mean_28 FROM sf JOIN s ON sf.station_id = s.station_id",
)
def _(spark, sf):
    frame = ft.station_features(station_panel(spark, sf))
    scaled = ft.apply_station_scale(frame, ft.station_scale(station_panel(spark, sf)))
    return rounded(scaled.select("station_id", "date", "target", "lag_1", "rolling_mean_28"))


@query(
    "k18_standardize",
    "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS d2 FROM customer) SELECT c_custkey, round((c_acctbal - m) / d, 6) AS c_acctbal, round((c_nationkey - m2) / d2, 6) AS c_nationkey FROM customer CROSS JOIN s",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return rounded(ft.standardize(rows, ft.standardization(rows, ["c_acctbal", "c_nationkey"])))


@query("k19_time_split", f"WITH {COMP} SELECT series_id, date, CASE WHEN date <= (SELECT max(date) FROM comp) - 30 THEN 'train' ELSE 'valid' END AS role FROM comp")
def _(spark, sf):
    return ft.time_split(target(spark, sf), 30).select("series_id", "date", "role")


# ---- L: baselines ----------------------------------------------------------------------------------------------------


@query(
    "l01_l02_baseline_forecast",
    f"""WITH {COMP}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM comp), z AS (SELECT series_id, max(date) AS z FROM comp GROUP BY 1),
    s AS (SELECT series_id, z, unnest(range(1, 91)) AS step FROM z)
    SELECT s.series_id, CAST(z + CAST(step AS INT) AS DATE) AS date, step AS horizon_step, model_name, target AS prediction FROM s CROSS JOIN (VALUES ('naive', 1), ('seasonal_naive_7', 7), ('seasonal_naive_30', 30)) m(model_name, p)
    JOIN r ON r.series_id = s.series_id AND r.r = p - (step - 1) % p""",
)
def _(spark, sf):
    return bt.baseline_forecast(target(spark, sf), KEYS, 90)


@query("l11_l13_bounds", """SELECT c_custkey, greatest(c_acctbal, 0) AS clipped, greatest(c_acctbal - 500, 0) AS lower, greatest(c_acctbal, c_acctbal * 0.9, greatest(c_acctbal - 500, 0)) AS upper,
  round(greatest(c_acctbal - c_nationkey * 1.2815515655446004, 0), 6) AS lower_80, round(c_acctbal + c_nationkey * 1.2815515655446004, 6) AS upper_80 FROM customer""")
def _(spark, sf):
    from ridegauge.functions.stats import clip0

    c = F.col("c_acctbal")
    low, high = order_bounds(c - 500, c, c * 0.9)
    glow, ghigh = gaussian_bounds(c, F.col("c_nationkey").cast("double"))
    return rounded(
        table(spark, sf, "customer").select(
            "c_custkey", clip0(c).alias("clipped"), low.alias("lower"), high.alias("upper"), glow.alias("lower_80"), ghigh.alias("upper_80")
        )
    )


# ---- M ---------------------------------------------------------------------------------------------------------------


@query(
    "m01_rolling_windows",
    f"""WITH {WIN} SELECT w.series_id, fold_id, w.horizon, min(x.date) AS train_start, max(CASE WHEN x.i = cut - 1 THEN x.date END) AS train_end, max(CASE WHEN x.i = cut THEN x.date END) AS test_start,
    max(CASE WHEN x.i = cut + w.horizon - 1 THEN x.date END) AS test_end, cut AS train_rows FROM win w JOIN ix x ON w.series_id = x.series_id GROUP BY 1, 2, 3, cut""",
)
def _(spark, sf):
    return bt.rolling_windows(target(spark, sf), KEYS, CONFIG)


@query("m03_m04_baseline_backtest", f"WITH {BACK} SELECT series_id, fold_id, horizon, horizon_step, date, train_end, actual, round(mase_scale, 6) AS mase_scale, model_name, prediction FROM bk")
def _(spark, sf):
    return rounded(backtest(spark, sf))


@query("m04_score", f"""WITH {BACK} SELECT series_id, fold_id, horizon, horizon_step, date, model_name, prediction, actual FROM bk""")
def _(spark, sf):
    forecasts = backtest(spark, sf).select("series_id", "fold_id", "horizon", "horizon_step", "date", "model_name", "prediction")
    return bt.score(forecasts, target(spark, sf), KEYS)


@query("m05_metrics", f"WITH {BACK}, {FOLD} SELECT series_id, model_name, fold_id, horizon, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, rows, round(mase, 6) AS mase FROM fm")
def _(spark, sf):
    return rounded(fold_metrics(spark, sf))


@query("m06_mase_scale", f"WITH {COMP} SELECT series_id, round(avg(abs(d)), 6) AS mase_scale FROM (SELECT series_id, target - lag(target, 7) OVER (PARTITION BY series_id ORDER BY date) AS d FROM comp) q GROUP BY 1")
def _(spark, sf):
    return rounded(bt.mase_scale(target(spark, sf), KEYS, 7))


@query(
    "m07_season_length",
    "SELECT event_type, count(*) AS events, 24 AS hourly, 7 AS daily, 52 AS weekly, 12 AS monthly, 1 AS unknown FROM events GROUP BY 1",
)
def _(spark, sf):
    names = {"hourly": "hourly", "daily": "D", "weekly": "Week", "monthly": " m ", "unknown": "fortnightly"}
    per = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    return per.select("*", *[F.lit(season_length(v)).alias(k) for k, v in names.items()])


@query("m10_compare_models", f"WITH {BACK}, {FOLD}, {COMPARE} SELECT series_id, model_name, horizon, {MEANS} FROM cmp")
def _(spark, sf):
    return rounded(comparison(spark, sf))


@query("m11_recommend", f"WITH {BACK}, {FOLD}, {COMPARE} SELECT series_id, horizon, model_name AS recommended_model, {MEANS} FROM cmp QUALIFY row_number() OVER (PARTITION BY series_id, horizon ORDER BY cmp.mean_mase, cmp.mean_mae, model_name) = 1")
def _(spark, sf):
    return rounded(bt.recommend(comparison(spark, sf), ("series_id", "horizon")))


@query("flagship_backtest", f"WITH {BACK}, {FOLD}, {COMPARE} SELECT series_id, model_name, horizon, {MEANS} FROM cmp")
def _(spark, sf):
    return rounded(comparison(spark, sf))


PF = f"""{SP}, od AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM sp WHERE in_service) q),
 pc AS (SELECT i, date FROM od WHERE i >= 364 AND (i - 364) % 30 = 0 AND i + 30 < n AND n > 395),
 pw AS (SELECT row_number() OVER (ORDER BY i) AS fold_id, date AS train_end, CAST(date + 30 AS DATE) AS test_end FROM (SELECT * FROM pc QUALIFY row_number() OVER (ORDER BY i DESC) <= 4) q)"""


@query("m02_panel_windows", f"WITH {PF} SELECT * FROM pw")
def _(spark, sf):
    return bt.panel_windows(station_panel(spark, sf), STATION)


SB = f"""{PF}, ob AS (SELECT station_id, date, target FROM sp WHERE in_service AND target IS NOT NULL),
 o1 AS (SELECT ob.station_id, fold_id, train_end, max_by(target, date) AS lastv FROM ob JOIN pw ON ob.date <= train_end GROUP BY 1, 2, 3),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS k FROM ob),
 o3 AS (SELECT a.station_id, a.date, abs(a.target - b.target) AS d7, abs(a.target - c.target) AS d1 FROM o2 a LEFT JOIN o2 b ON a.station_id = b.station_id AND b.k = a.k - 7 LEFT JOIN o2 c ON a.station_id = c.station_id AND c.k = a.k - 1),
 o4 AS (SELECT o3.station_id, fold_id, CASE WHEN count(*) > 7 THEN avg(d7) ELSE avg(d1) END AS s FROM o3 JOIN pw ON o3.date <= train_end GROUP BY 1, 2),
 sl AS (SELECT o1.station_id, o1.fold_id, o1.train_end, lastv, j, sp.target AS v FROM o1 CROSS JOIN (SELECT unnest(range(1, 8)) AS j) q LEFT JOIN sp ON sp.station_id = o1.station_id AND sp.date = o1.train_end - 7 + CAST(j AS INT)),
 sv AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY station_id, fold_id ORDER BY j ROWS UNBOUNDED PRECEDING), lastv) AS f FROM sl),
 sfc AS (SELECT station_id, fold_id, train_end, CAST(train_end + CAST(s AS INT) AS DATE) AS date, s AS horizon_step, 'naive' AS model_name, 'baseline_rule' AS implementation, lastv AS prediction FROM o1 CROSS JOIN (SELECT unnest(range(1, 31)) AS s) q
   UNION ALL SELECT station_id, fold_id, train_end, CAST(train_end + CAST(s AS INT) AS DATE), s, 'seasonal_naive_7', 'seasonal_rule', f FROM sv JOIN (SELECT unnest(range(1, 31)) AS s) q ON (s - 1) % 7 + 1 = j),
 sbk AS (SELECT sfc.*, ob.target AS actual, CASE WHEN o4.s > 0 THEN o4.s ELSE 1 END AS mase_scale FROM sfc JOIN ob ON ob.station_id = sfc.station_id AND ob.date = sfc.date JOIN o4 ON o4.station_id = sfc.station_id AND o4.fold_id = sfc.fold_id),
 sx AS (SELECT sbk.*, h.horizon, abs(prediction - actual) AS abs_error, (prediction - actual) ** 2 AS squared_error, prediction - actual AS bias_error, abs(prediction - actual) / mase_scale AS scaled_abs_error
   FROM sbk JOIN (VALUES (7), (30)) h(horizon) ON horizon_step <= h.horizon)"""
EM = "round(avg(abs_error), 6) AS mae, round(sqrt(avg(squared_error)), 6) AS rmse, round(avg(scaled_abs_error), 6) AS mase, round(avg(bias_error), 6) AS bias, count(*) AS rows, count(DISTINCT station_id) AS stations"


def station_scored(spark, sf):
    return bt.station_backtest(station_panel(spark, sf), STATION)


def station_expanded(spark, sf):
    return bt.expand_horizons(station_scored(spark, sf), STATION.horizons)


@query("l01_l02_station_backtest", f"WITH {SB} SELECT station_id, fold_id, train_end, date, horizon_step, model_name, implementation, prediction, actual, round(mase_scale, 6) AS mase_scale FROM sbk")
def _(spark, sf):
    return rounded(station_scored(spark, sf))


@query("m08_expand_horizons", f"WITH {SB} SELECT station_id, fold_id, date, horizon, horizon_step, model_name, abs_error, squared_error, bias_error, round(scaled_abs_error, 6) AS scaled_abs_error FROM sx")
def _(spark, sf):
    return rounded(
        station_expanded(spark, sf).select(
            "station_id", "fold_id", "date", "horizon", "horizon_step", "model_name", "abs_error", "squared_error", "bias_error", "scaled_abs_error"
        )
    )


@query("m09_fold_metrics", f"WITH {SB} SELECT model_name, implementation, fold_id, horizon, {EM} FROM sx GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return rounded(bt.fold_metrics(station_expanded(spark, sf)))


SLICES = """lk AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, CASE s_nationkey % 4 WHEN 0 THEN 'mature' WHEN 1 THEN 'young' WHEN 2 THEN 'newborn' END AS history_group,
   CASE s_nationkey % 3 WHEN 0 THEN 'sparse_intermittent' WHEN 1 THEN 'busy_stable' END AS station_category, 'cluster_' || CAST(s_nationkey % 5 AS VARCHAR) AS cluster_label FROM supplier),
 sj AS (SELECT sx.*, history_group, station_category, cluster_label FROM sx LEFT JOIN lk ON sx.station_id = lk.station_id),
 sl8 AS (SELECT *, 'all' AS slice_type, 'all_stations' AS slice_value FROM sj UNION ALL SELECT *, 'history_group', 'mature' FROM sj WHERE history_group = 'mature'
   UNION ALL SELECT *, 'history_group', 'short_history' FROM sj WHERE history_group IN ('newborn', 'young') UNION ALL SELECT *, 'station_group', 'sparse_intermittent' FROM sj WHERE station_category = 'sparse_intermittent'
   UNION ALL SELECT *, 'category', coalesce(station_category, 'unknown') FROM sj UNION ALL SELECT *, 'cluster', coalesce(cluster_label, 'unknown') FROM sj)"""


def slices(spark, sf):
    n = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("station_id"),
        F.when(n % 4 == 0, "mature").when(n % 4 == 1, "young").when(n % 4 == 2, "newborn").alias("history_group"),
        F.when(n % 3 == 0, "sparse_intermittent").when(n % 3 == 1, "busy_stable").alias("station_category"),
        F.concat(F.lit("cluster_"), (n % 5).cast("string")).alias("cluster_label"),
    )


@query("m12_slice_metrics", f"WITH {SB}, {SLICES} SELECT model_name, horizon, slice_type, slice_value, {EM} FROM sl8 GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return rounded(bt.slice_metrics(ft.attach_slices(station_expanded(spark, sf), slices(spark, sf))))


@query("m13_horizon_step", f"WITH {BACK} SELECT series_id, fold_id, horizon, model_name, date, horizon_step FROM bk")
def _(spark, sf):
    bare = backtest(spark, sf).drop("horizon_step")
    return iv.horizon_step(bare, KEYS).select("series_id", "fold_id", "horizon", "model_name", "date", "horizon_step")


@query("m14_residuals", f"WITH {BACK} SELECT series_id, model_name, fold_id, horizon, horizon_step, date AS target_date, prediction AS point_forecast, actual, actual - prediction AS residual, abs(actual - prediction) AS abs_error FROM bk")
def _(spark, sf):
    return iv.residuals(backtest(spark, sf), KEYS)


# Calibration pools over the network total, so that a step has few residuals and pooling takes place.
TOTAL = BACK.replace(SEGMENT_DAILY, SEGMENT_DAILY.replace("o_orderpriority", "'all'").replace("GROUP BY 1, 2", "GROUP BY 2"))
RS = "rs AS (SELECT model_name, horizon, horizon_step, date AS target_date, prediction, actual, actual - prediction AS residual, fold_id FROM bk)"
CALIB = f"""{TOTAL}, {RS}, stp AS (SELECT DISTINCT model_name, horizon, horizon_step FROM rs),
 rad AS (SELECT s.model_name, s.horizon, s.horizon_step, r.r, greatest(1, s.horizon_step - r.r) AS a, least(s.horizon, s.horizon_step + r.r) AS b FROM stp s CROSS JOIN (SELECT unnest(range(0, 30)) AS r) r WHERE r.r < s.horizon),
 cnt AS (SELECT rad.*, count(*) AS n FROM rad JOIN rs ON rs.model_name = rad.model_name AND rs.horizon = rad.horizon AND rs.horizon_step BETWEEN a AND b GROUP BY ALL),
 fst AS (SELECT * FROM cnt WHERE n >= 24 QUALIFY row_number() OVER (PARTITION BY model_name, horizon, horizon_step ORDER BY r) = 1),
 cal AS (SELECT f.model_name, f.horizon, f.horizon_step, CASE WHEN r = 0 THEN 'step_specific' ELSE 'pooled_nearby_steps' END AS calibration_method, f.horizon AS source_horizon, a AS source_step_start, b AS source_step_end, n AS n_residuals,
   quantile_cont(residual, 0.025) AS residual_q025, quantile_cont(residual, 0.1) AS residual_q10, quantile_cont(residual, 0.9) AS residual_q90, quantile_cont(residual, 0.975) AS residual_q975
   FROM fst f JOIN rs ON rs.model_name = f.model_name AND rs.horizon = f.horizon AND rs.horizon_step BETWEEN a AND b GROUP BY ALL)"""
_Q = "round(residual_q025, 6) AS residual_q025, round(residual_q10, 6) AS residual_q10, round(residual_q90, 6) AS residual_q90, round(residual_q975, 6) AS residual_q975"


def total_backtest(spark, sf):
    total = bind(spark, sf, SEGMENT_DAILY.replace("o_orderpriority", "'all'").replace("GROUP BY 1, 2", "GROUP BY 2"))
    return bt.baseline_backtest(ft.complete_target(total, KEYS), KEYS, CONFIG)


def calibration(spark, sf):
    return iv.calibrate(iv.residuals(total_backtest(spark, sf)), 24)


@query("m15_calibrate", f"WITH {CALIB} SELECT model_name, horizon, horizon_step, calibration_method, source_horizon, source_step_start, source_step_end, n_residuals, {_Q} FROM cal")
def _(spark, sf):
    return rounded(calibration(spark, sf))


# Future forecasts at 7, 30 and 90 days: 90 has no calibration of its own and falls back to 30.
FUT = f"""{CALIB}, rr AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS r FROM comp), zz AS (SELECT max(date) AS z FROM comp),
 ff AS (SELECT CAST(z + CAST(step AS INT) AS DATE) AS date, step AS horizon_step, h.horizon, model_name, target AS prediction FROM zz CROSS JOIN (SELECT unnest(range(1, 91)) AS step) s
   CROSS JOIN (VALUES (7), (30), (90)) h(horizon) CROSS JOIN (VALUES ('naive', 1), ('seasonal_naive_7', 7), ('seasonal_naive_30', 30)) m(model_name, p) JOIN rr ON rr.r = p - (step - 1) % p WHERE step <= h.horizon),
 res AS (SELECT ff.*, c.* EXCLUDE (model_name, horizon, horizon_step, calibration_method), CASE WHEN ff.horizon = 90 THEN c.calibration_method || '+proxy_from_h30' ELSE c.calibration_method END AS calibration_method
   FROM ff LEFT JOIN cal c ON c.model_name = ff.model_name AND c.horizon = least(ff.horizon, 30) AND c.horizon_step = least(ff.horizon_step, 30)),
 app AS (SELECT date, horizon, horizon_step, model_name, prediction, prediction AS point_forecast, greatest(prediction + residual_q10, 0) AS lower_80, prediction + residual_q90 AS upper_80,
   greatest(prediction + residual_q025, 0) AS lower_95, prediction + residual_q975 AS upper_95, calibration_method AS interval_calibration_method, source_horizon AS interval_source_horizon,
   source_step_start AS interval_source_step_start, source_step_end AS interval_source_step_end, n_residuals AS interval_n_residuals FROM res)"""
_B = "round(lower_80, 6) AS lower_80, round(upper_80, 6) AS upper_80, round(lower_95, 6) AS lower_95, round(upper_95, 6) AS upper_95"


def future(spark, sf):
    total = bind(spark, sf, SEGMENT_DAILY.replace("o_orderpriority", "'all'").replace("GROUP BY 1, 2", "GROUP BY 2"))
    ahead = bt.baseline_forecast(ft.complete_target(total, KEYS), KEYS, 90)
    reached = F.filter(F.array(*[F.lit(h) for h in CONFIG.production_horizons]), lambda h: h >= F.col("horizon_step"))
    return ahead.withColumn("horizon", F.explode(reached)).drop("series_id")


@query("m16_resolve_calibration", f"WITH {FUT} SELECT date, horizon, horizon_step, model_name, prediction, calibration_method, source_horizon, source_step_start, source_step_end, n_residuals, {_Q} FROM res")
def _(spark, sf):
    return rounded(iv.resolve_calibration(future(spark, sf), calibration(spark, sf)))


@query("m17_apply_intervals", f"WITH {FUT} SELECT * EXCLUDE (lower_80, upper_80, lower_95, upper_95), {_B} FROM app")
def _(spark, sf):
    return rounded(iv.apply_intervals(future(spark, sf), calibration(spark, sf)))


@query("m18_winkler", "SELECT c_custkey, round(CASE WHEN c_acctbal < 1000 THEN 3000 + (1000 - c_acctbal) * 10 WHEN c_acctbal > 4000 THEN 3000 + (c_acctbal - 4000) * 10 ELSE 3000 END, 6) AS winkler_80 FROM customer")
def _(spark, sf):
    score = winkler(F.col("c_acctbal"), F.lit(1000.0), F.lit(4000.0), 0.20)
    return rounded(table(spark, sf, "customer").select("c_custkey", score.alias("winkler_80")))


QUAL = f"""{CALIB}, ap AS (SELECT rs.*, greatest(prediction + residual_q10, 0) AS l8, prediction + residual_q90 AS u8, greatest(prediction + residual_q025, 0) AS l9, prediction + residual_q975 AS u9
   FROM rs JOIN cal ON rs.model_name = cal.model_name AND rs.horizon = cal.horizon AND rs.horizon_step = cal.horizon_step)"""
_COV = "count(*) AS n, round(avg(CASE WHEN actual BETWEEN l8 AND u8 THEN 1 ELSE 0 END), 6) AS coverage_80, round(avg(CASE WHEN actual BETWEEN l9 AND u9 THEN 1 ELSE 0 END), 6) AS coverage_95, round(avg(u8 - l8), 6) AS avg_width_80, round(avg(u9 - l9), 6) AS avg_width_95"


def intervalized(spark, sf):
    back = total_backtest(spark, sf)
    return iv.apply_intervals(back, iv.calibrate(iv.residuals(back), 24))


@query(
    "m19_interval_quality",
    f"""WITH {QUAL} SELECT model_name, horizon, {_COV.replace(', 6)', ', 3)')}, round(avg(CASE WHEN actual < l8 THEN u8 - l8 + 10 * (l8 - actual) WHEN actual > u8 THEN u8 - l8 + 10 * (actual - u8) ELSE u8 - l8 END), 3) AS mean_winkler_80,
    round(avg(CASE WHEN actual < l9 THEN u9 - l9 + 40 * (l9 - actual) WHEN actual > u9 THEN u9 - l9 + 40 * (actual - u9) ELSE u9 - l9 END), 3) AS mean_winkler_95 FROM ap GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(iv.interval_quality(intervalized(spark, sf)), 3)


@query("m19_interval_quality_by_step", f"WITH {QUAL} SELECT model_name, horizon, horizon_step, {_COV.replace(', 6)', ', 3)')} FROM ap GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(iv.interval_quality(intervalized(spark, sf), by_step=True), 3)
