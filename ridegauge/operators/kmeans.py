"""Relational k-means over labelled points, centres carried as k values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.operators.keyed import global_rank
from ridegauge.session import cut_lineage


@dataclass(frozen=True)
class Center:
    cluster: int
    x: float
    y: float


def duration_points(trips: DataFrame, duration: str = "duration_minutes") -> DataFrame:
    """(minutes, frequency) per distinct duration."""
    return (
        trips.groupBy(F.col(duration).alias("label"))
        .agg(F.count(F.lit(1)).cast("double").alias("y"))
        .select("label", F.col("label").cast("double").alias("x"), "y")
    )


def station_points(trips: DataFrame, station: str = "start_station") -> DataFrame:
    """(trip count, 0) per station."""
    return trips.groupBy(F.col(station).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("x")).select(
        "label", "x", F.lit(0.0).alias("y")
    )


def seed_centers(points: DataFrame, ids: list[int]) -> list[Center]:
    """Initial centres by 1-based rank of the label; the driver gets the chosen k rows only."""
    ranked = global_rank(points, ["label"], "_rank").filter(F.col("_rank").isin(sorted(set(ids))))
    return [Center(n, row["x"], row["y"]) for n, row in enumerate(ranked.orderBy("_rank").collect(), start=1)]


def _nearest(centers: list[Center]) -> Column:
    """Nearest centre as an expression over k literals; ties go to the smaller cluster number."""
    scored = [
        F.struct(
            F.sqrt((F.col("x") - c.x) * (F.col("x") - c.x) + (F.col("y") - c.y) * (F.col("y") - c.y)).alias("d"),
            F.lit(c.cluster).alias("cluster"),
        )
        for c in centers
    ]
    return F.array_min(F.array(*scored))


def assign(points: DataFrame, centers: list[Center]) -> DataFrame:
    return points.withColumn("cluster", _nearest(centers)["cluster"])


def update(assigned: DataFrame) -> DataFrame:
    """Mean point per cluster; a cluster without points vanishes."""
    return assigned.groupBy("cluster").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def _collect_centers(frame: DataFrame) -> list[Center]:
    return [Center(r["cluster"], r["mean_x"], r["mean_y"]) for r in frame.orderBy("cluster").collect()]  # k rows


def iterate(points: DataFrame, seeds: list[Center], iterations: int) -> tuple[list[Center], list[Center]]:
    """Centres that made the last assignment and centres after it; the driver holds k rows per round, never points."""
    previous = current = seeds
    for _ in range(iterations):
        previous, current = current, _collect_centers(update(assign(points, current)))
    return previous, current


def _mean_columns(df: DataFrame, centers: list[Center]) -> DataFrame:
    pick = lambda attr: F.coalesce(*[F.when(F.col("cluster") == c.cluster, F.lit(getattr(c, attr))) for c in centers])
    return df.withColumn("mean_x", pick("x")).withColumn("mean_y", pick("y"))


def kmeans(points: DataFrame, ids: list[int], iterations: int) -> DataFrame:
    """``label, x, y, cluster, mean_x, mean_y`` after a fixed number of rounds.

    The points (one row per label, not per trip) are checkpointed once, so no round goes back to the fact.
    """
    points = cut_lineage(points)
    before, after = iterate(points, seed_centers(points, ids), iterations)
    return _mean_columns(assign(points, before), after)


def kmeans_delta(points: DataFrame, ids: list[int], iterations: int) -> DataFrame:
    """Rows of the last round that were not already there one round earlier; empty means converged."""
    columns = ["label", "cluster", "mean_x", "mean_y"]
    points = cut_lineage(points)
    last = kmeans(points, ids, iterations).select(*columns)
    return last.exceptAll(kmeans(points, ids, iterations - 1).select(*columns))


def rank_classes(clustered: DataFrame) -> DataFrame:
    """Class 1 is the centre that comes last in (x, y) order; k rows reach the window."""
    centers = clustered.select("cluster", "mean_x", "mean_y").distinct()
    by_center = W.orderBy(F.struct("mean_x", "mean_y").desc())
    return centers.withColumn("class", F.dense_rank().over(by_center))


def with_classes(points: DataFrame, clustered: DataFrame) -> DataFrame:
    """Points with their class and centre; unclustered points keep nulls."""
    classes = F.broadcast(rank_classes(clustered))  # k rows
    labelled = clustered.select("label", "cluster").join(classes, "cluster").select("label", "class", "mean_x", "mean_y")
    return points.join(labelled, "label", "left")


def wcss(clustered: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    return clustered.agg(F.sum(dx * dx + dy * dy).alias("wcss"))


def elbow(points: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), iterations: int = 10) -> DataFrame:
    """Within-cluster sum of squares per k, seeds spread evenly over the label order."""
    points = cut_lineage(points)
    n = points.count()
    out = None
    for k in ks:
        ids = sorted({min(n, n * (2 * j + 1) // (2 * k) + 1) for j in range(k)})
        row = wcss(kmeans(points, ids, iterations)).select(F.lit(k).alias("k"), "wcss")
        out = row if out is None else out.unionByName(row)
    return out
