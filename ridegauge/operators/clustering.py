"""Station clusters: matrix preparation, k-means selection by validity and stability, labels and profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.config import StationConfig
from ridegauge.functions.stats import unbiased_skew
from ridegauge.operators import fleet_kmeans as fk
from ridegauge.operators.keyed import exact_quantiles
from ridegauge.session import cut_lineage

# Features of the cluster matrix.
CLUSTER_FEATURES = (
    "avg_demand_observed", "coefficient_of_variation", "zero_rate_observed", "active_day_rate_observed", "coverage_ratio",
    "lag1_autocorr", "lag7_autocorr", "weekday_effect_strength", "month_effect_strength", "weekend_ratio", "trend_slope",
    "outlier_rate", "correlation_with_system_excl_self", "demand_share_of_system_observed_window",
    "fraction_of_demand_recent_window",
)


def cluster_eligibility(summary: DataFrame, config: StationConfig = StationConfig()) -> DataFrame:
    groups = ("mature",) if config.cluster_mature_only else ("mature", "young")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(~yes(F.col("history_group").isin(*groups)), "history_group_not_cluster_eligible")
        .when(~yes(F.col("coverage_ratio") >= config.min_cluster_coverage), "coverage_too_low_for_clustering")
        .when(~yes(F.col("observed_days") >= config.min_cluster_observed_days), "insufficient_observed_days_for_clustering")
        .when(~yes(F.col("metric_reliable_behavior")), "insufficient_behavior_reliability")
        .otherwise("eligible")
    )
    return summary.withColumn("cluster_ineligible_reason", reason).withColumn(
        "cluster_eligible", F.col("cluster_ineligible_reason") == "eligible"
    )


def cluster_matrix(eligible: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES) -> tuple[DataFrame, list[str]]:
    """``station_id`` and scaled features; skewed non-negative columns are logged, nulls take the median, constants go.

    Only per-column statistics reach the driver; the quantiles come from the skew-safe exact helper.
    """
    present = [c for c in columns if c in eligible.columns]
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    stats = eligible.agg(
        *[F.count(num(c)).alias(f"{c}__n") for c in present],
        *[F.min(num(c)).alias(f"{c}__lo") for c in present],
        *[unbiased_skew(F.skewness(num(c)), F.count(num(c))).alias(f"{c}__sk") for c in present],
    ).collect()[0]
    kept = [c for c in present if stats[f"{c}__n"] > 0]
    if not kept:
        raise ValueError("all clustering features are empty")
    logged = {c for c in kept if stats[f"{c}__lo"] >= 0 and abs(stats[f"{c}__sk"] or 0.0) > 1.0}
    shaped = cut_lineage(
        eligible.select("station_id", *[(F.log1p(num(c)) if c in logged else num(c)).alias(c) for c in kept])
    )

    def quartiles(df: DataFrame) -> dict[str, object]:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in kept])))
        rows = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "lo": 0.0, "hi": 1.0})
        return {r["column"]: r for r in rows.collect()}  # one row per feature

    middle = quartiles(shaped)
    imputed = shaped.select("station_id", *[F.coalesce(c, F.lit(middle[c]["q50"])).alias(c) for c in kept])
    shape = quartiles(imputed)
    used = [c for c in kept if shape[c]["lo"] != shape[c]["hi"]]
    if not used:
        raise ValueError("all clustering features are constant")
    width = {c: (shape[c]["q75"] - shape[c]["q25"]) or 1.0 for c in used}
    scaled = imputed.select("station_id", *[((F.col(c) - shape[c]["q50"]) / width[c]).alias(c) for c in used])
    return scaled, [f"{c}:{'log1p' if c in logged else 'raw'}" for c in used]


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def ari(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two label columns from their contingency counts."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("v")).scalar()
    rows = cells.agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("both"))
    rows = rows.withColumn("a", side(a)).withColumn("b", side(b))
    expected = F.col("a") * F.col("b") / _pairs(F.col("n"))
    top = (F.col("a") + F.col("b")) / 2
    return rows.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


#: Each seed keeps the fit with the least cost of so many starts.
STARTS = 20


def evaluate_k(matrix: DataFrame, config: StationConfig = StationConfig()) -> tuple[list[dict], dict[int, list[list[float]]]]:
    """Quality and stability per k, and the centres of the best fit; the driver holds centres and counts, never stations.

    All fits (k, seed or resample, start) advance together, see :mod:`ridegauge.operators.fleet_kmeans`. A resample draws
    ``max(2 k, round(fraction n))`` stations with replacement and has its own starts; stability is the mean agreement of its best fit with the
    labels of the best seed on all stations.
    """
    columns = [c for c in matrix.columns if c != "station_id"]
    data = cut_lineage(matrix.select("station_id", F.array(*columns).cast("array<double>").alias("features")))
    n = data.count()
    threshold = max(config.min_cluster_size_abs, math.ceil(n * config.min_cluster_size_ratio))
    wanted = [k for k in sorted(set(config.k_values)) if 2 <= k < n]
    if not wanted:
        return [], {}
    draws = [(k, i) for k in wanted for i in range(config.bootstrap_iterations)]
    sizes = [max(2 * k, round(n * config.bootstrap_fraction)) for k, _ in draws]
    points = fk.prepared(data, n, sizes, [config.random_state + 1_000 * k + i for k, i in draws])
    models = [fk.Model(k, 0, seed + 1_000 * start, group) for k in wanted for group, seed in enumerate(config.cluster_seeds) for start in range(STARTS)]
    models += [fk.Model(k, 1 + at, config.random_state + k + i + 1_000 * start) for at, (k, i) in enumerate(draws) for start in range(STARTS)]
    kept = fk.best(fk.fit(points, models), lambda m: (m.weight, m.k, m.group))
    runs = [kept[0, k, group] for k in wanted for group in range(len(config.cluster_seeds))]
    quality = fk.sizes_and_silhouettes(points, runs)
    of_k = {k: [i for i, f in enumerate(runs) if f.model.k == k] for k in wanted}
    chosen = {k: max(of_k[k], key=lambda i: (-math.inf if math.isnan(quality[i][1]) else quality[i][1], -runs[i].cost)) for k in wanted}
    seed_pairs = [(k, p) for k in wanted for p in combinations(of_k[k], 2)]
    redrawn = [(k, (len(runs) + at, chosen[k])) for at, (k, _) in enumerate(draws)]
    labelled = fk.labels(points, [*runs, *[kept[1 + at, k, 0] for at, (k, _) in enumerate(draws)]])
    agreement = fk.agreements(labelled, [p for _, p in seed_pairs + redrawn])
    mean = lambda values: sum(values) / len(values) if values else None
    rows = []
    for k in wanted:
        scores = [quality[i][1] for i in of_k[k] if not math.isnan(quality[i][1])]
        found = quality[chosen[k]][0]
        middle = mean(scores)
        rows.append(
            {
                "candidate_k": k,
                "silhouette_score": middle,
                "silhouette_score_std": mean([(s - middle) ** 2 for s in scores]) ** 0.5 if scores else None,
                "seed_stability_ari": mean([a for (of, _), a in zip(seed_pairs, agreement, strict=False) if of == k]),
                "bootstrap_stability_ari": mean([a for (of, _), a in zip(redrawn, agreement[len(seed_pairs) :], strict=True) if of == k]),
                "min_cluster_size": min(found),
                "max_cluster_size": max(found),
                "tiny_cluster_count": sum(s < threshold for s in found),
                "size_threshold": threshold,
                "all_clusters_valid": all(s >= threshold for s in found),
            }
        )
    return rows, {k: runs[chosen[k]].centers.tolist() for k in wanted}


def select_k(candidates: DataFrame, preferred_k: int = 6) -> DataFrame:
    """Mark one candidate: valid sizes, bootstrap, seed stability, silhouette, closeness to the preferred k, k."""
    order = F.struct(
        (~F.col("all_clusters_valid")).alias("a"), (-F.col("bootstrap_stability_ari")).alias("b"),
        (-F.col("seed_stability_ari")).alias("c"), (-F.col("silhouette_score")).alias("d"),
        F.abs(F.col("candidate_k") - preferred_k).alias("e"), F.col("candidate_k").alias("f"),
    )
    best = candidates.agg(F.min_by("candidate_k", order).alias("k")).scalar()
    reason = F.when(F.col("all_clusters_valid"), "best_balance_of_valid_cluster_sizes_stability_and_silhouette").otherwise(
        "selected_despite_size_issues_due_to_limited_valid_candidates"
    )
    return candidates.withColumn("_k", best).select(
        "*", (F.col("candidate_k") == F.col("_k")).alias("selected"),
        F.when(F.col("candidate_k") == F.col("_k"), reason).otherwise("").alias("selection_reason"),
    ).drop("_k")


def assignment_margin(matrix: DataFrame, centers: Sequence[Sequence[float]], stability: float, config: StationConfig = StationConfig()) -> DataFrame:
    """Relative gap between the nearest two centres and the confidence it earns; centres are k literals."""
    columns = [c for c in matrix.columns if c != "station_id"]
    distances = []
    for i, center in enumerate(centers):
        total = F.lit(0.0)
        for c, v in zip(columns, center):
            total = total + (F.col(c) - float(v)) * (F.col(c) - float(v))
        distances.append(F.struct(F.sqrt(total).alias("d"), F.lit(i).alias("cluster")))
    ranked = matrix.withColumn("_d", F.array_sort(F.array(*distances)))
    d1, d2 = F.get("_d", F.lit(0))["d"], F.get("_d", F.lit(1))["d"]
    margin = (d2 - d1) / F.greatest(d2, F.lit(1e-9))
    level = (
        F.when((margin >= 0.35) & F.lit(stability >= config.stability_good), "high")
        .when((margin >= 0.15) & F.lit(stability >= config.stability_ok), "medium")
        .otherwise("low")
    )
    return ranked.select(
        "station_id", F.get("_d", F.lit(0))["cluster"].alias("raw_cluster"), margin.alias("distance_margin"),
        level.alias("cluster_assignment_confidence"),
    )


def relabel(clustered: DataFrame) -> DataFrame:
    """``cluster_1`` has the highest mean demand, then the lowest zero rate; the window sees one row per cluster."""
    profile = clustered.groupBy("raw_cluster").agg(
        F.avg("avg_demand_observed").alias("demand"), F.avg("zero_rate_observed").alias("zero")
    )
    order = W.orderBy(F.col("demand").desc(), F.col("zero"), "raw_cluster")
    names = profile.select("raw_cluster", F.concat(F.lit("cluster_"), F.row_number().over(order).cast("string")).alias("cluster_label"))
    return clustered.join(F.broadcast(names), "raw_cluster")


PROFILE_MEANS = {
    "avg_demand_mean": "avg_demand_observed", "zero_rate_mean": "zero_rate_observed", "coverage_ratio_mean": "coverage_ratio",
    "cv_mean": "coefficient_of_variation", "lag1_autocorr_mean": "lag1_autocorr", "lag7_autocorr_mean": "lag7_autocorr",
    "weekday_effect_mean": "weekday_effect_strength", "month_effect_mean": "month_effect_strength", "weekend_ratio_mean": "weekend_ratio",
    "trend_slope_mean": "trend_slope", "outlier_rate_mean": "outlier_rate", "correlation_with_system_mean": "correlation_with_system_excl_self",
    "demand_share_mean": "demand_share_of_system_observed_window",
}


def cluster_profile(clustered: DataFrame) -> DataFrame:
    mode = lambda c: F.coalesce(F.mode(c, deterministic=True), F.lit("unknown"))
    return clustered.groupBy("cluster_label").agg(
        F.count_distinct("station_id").alias("station_count"),
        *[F.avg(c).alias(name) for name, c in PROFILE_MEANS.items()],
        mode("behavior_label").alias("behavior_mode"),
        mode("cluster_assignment_confidence").alias("cluster_assignment_confidence_mode"),
    )


def cluster_stations(categorized: DataFrame, config: StationConfig = StationConfig()) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Stations with cluster labels, the cluster profile and the selection table."""
    spark = categorized.sparkSession
    base = cut_lineage(cluster_eligibility(categorized, config))
    eligible = base.filter("cluster_eligible")
    schema = (
        "candidate_k int, silhouette_score double, silhouette_score_std double, seed_stability_ari double, bootstrap_stability_ari double, "
        "min_cluster_size long, max_cluster_size long, tiny_cluster_count long, size_threshold long, all_clusters_valid boolean"
    )
    scores, models, names = [], {}, []
    if eligible.count() >= config.min_cluster_eligible:
        matrix, names = cluster_matrix(eligible)
        matrix = cut_lineage(matrix)
        scores, models = evaluate_k(matrix, config)
    if not scores:
        label = F.when(F.col("cluster_eligible"), "not_clustered_insufficient_eligible_stations").otherwise("not_clustered_not_eligible")
        out = base.withColumns(
            {"cluster_label": label, "cluster_assignment_confidence": F.lit("low"), "cluster_model_stability": F.lit(None).cast("double")}
        )
        empty = spark.createDataFrame([], schema).withColumns(
            {"selected": F.lit(True), "selection_reason": F.lit("insufficient_eligible_stations_for_clustering")}
        )
        return out, None, empty
    selection = cut_lineage(select_k(spark.createDataFrame([tuple(s.values()) for s in scores], schema), config.preferred_k))
    chosen = selection.filter("selected").collect()[0]
    stability = chosen["bootstrap_stability_ari"]
    margins = assignment_margin(matrix, models[chosen["candidate_k"]], stability, config)
    labelled = cut_lineage(relabel(eligible.join(margins, "station_id")))
    joined = base.join(labelled.select("station_id", "cluster_label", "cluster_assignment_confidence"), "station_id", "left")
    out = joined.withColumns(
        {
            "cluster_label": F.coalesce("cluster_label", F.lit("not_clustered_not_eligible")),
            "cluster_assignment_confidence": F.coalesce("cluster_assignment_confidence", F.lit("low")),
            "cluster_model_stability": F.lit(stability),
            "cluster_feature_columns_used": F.lit(",".join(n.split(":")[0] for n in names)),
        }
    )
    return out, cluster_profile(labelled), selection
