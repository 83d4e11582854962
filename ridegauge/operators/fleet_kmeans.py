"""Many k-means fits in one: every model takes its Lloyd step in the same pass over the points.

A model is a number of clusters, a weight column and a start. A pass assigns each point to each model's nearest centre inside the task that holds
it and adds weight, cost and coordinates per centre; one aggregation of (centre, sums) rows follows, whose size is given by the models and not by the
points. Resamples are integer weights of exact total, so that no row is copied: the driver deals draws to blocks of consecutive ranks, and a task deals
a block's draws to its rows. Starts are k-means++ on at most ``START_POINTS`` points, a documented bound that touches starts only.

A centre without points stays where it is, so a resample with fewer distinct points than clusters has fewer centres in use and is no error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridegauge.operators.keyed import global_rank
from ridegauge.session import cut_lineage

START_POINTS = 2_048
RANK_BLOCK = 4_096
ROUNDS = 50
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Model:
    """``weight`` is a position in the points' weights, 0 is the whole table; ``group`` tells apart the fits that the best is chosen among."""

    k: int
    weight: int
    seed: int
    group: int = 0


@dataclass
class Fit:
    model: Model
    centers: np.ndarray
    cost: float


def draw(n: int, sizes: Sequence[int], seeds: Sequence[int]) -> list[np.ndarray]:
    """Draws with replacement from ``n`` ranks, dealt to blocks of ranks: one array of block totals a resample."""
    blocks = max(1, -(-n // RANK_BLOCK))
    share = np.full(blocks, RANK_BLOCK / max(n, 1))
    share[-1] = 1 - share[:-1].sum()
    return [np.random.default_rng(seed).multinomial(size, share) for size, seed in zip(sizes, seeds, strict=True)]


def with_weights(points: DataFrame, n: int, sizes: Sequence[int], seeds: Sequence[int], key: str = "station_id") -> DataFrame:
    """``key``, ``features`` and ``weights``: 1, then for each resample how often the row was drawn."""
    totals, total_rows, name_key = draw(n, sizes, seeds), n, key
    block_rows = RANK_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            rank = batch.column(2).to_numpy() - 1
            weights = np.ones((len(rank), 1 + len(seeds)), np.int32)
            for block in np.unique(rank // block_rows).tolist():
                if block not in held:
                    rows = min(block_rows, total_rows - block * block_rows)
                    held = {block: np.stack([np.random.default_rng([s, block]).multinomial(t[block], np.full(rows, 1 / rows)) for s, t in zip(seeds, totals, strict=True)], 1)} if seeds else {block: np.zeros((rows, 0))}
                mine = rank // block_rows == block
                weights[mine, 1:] = held[block][rank[mine] - block * block_rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(rank) + 1) * weights.shape[1], pa.int32()), pa.array(weights.ravel()))],
                names=[name_key, "features", "weights"],
            )

    kind = points.schema[key].dataType.simpleString()
    ranked = global_rank(points.select(key, "features"), [key]).select(key, "features", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(run, f"{key} {kind}, features array<double>, weights array<int>")


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres: each next one is drawn by weight and squared distance to those there are."""
    mass = weights / weights.sum() if weights.sum() else np.full(len(points), 1 / len(points))
    centers = [points[rng.choice(len(points), p=mass)]]
    nearest = ((points - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        chance = mass * nearest
        total = chance.sum()
        centers.append(points[rng.choice(len(points), p=chance / total if total > 0 else mass)])
        nearest = np.minimum(nearest, ((points - centers[-1]) ** 2).sum(1))
    return np.array(centers)


class _Bank:
    """Centres of many models, those with the same k together."""

    def __init__(self, fits: Sequence[tuple[int, int, np.ndarray]]):
        self.parts, self.first, at = [], [], 0
        by_k: dict[int, list[int]] = {}
        for i, (k, _, _) in enumerate(fits):
            by_k.setdefault(k, []).append(i)
        self.first = [0] * len(fits)
        for k, members in sorted(by_k.items()):
            for m in members:
                self.first[m] = at + k * members.index(m)
            self.parts.append((k, members, at, np.array([fits[m][1] for m in members]), np.concatenate([fits[m][2] for m in members])))
            at += k * len(members)
        self.size, self.count = at, len(fits)

    def assign(self, x: np.ndarray) -> Iterator[tuple]:
        """For each k: members, first centre, weight positions, labels and squared distances (points x members), all distances."""
        own = (x * x).sum(1)
        for k, members, at, weight, centers in self.parts:
            apart = np.maximum(own[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0).reshape(len(x), len(members), k)
            label = apart.argmin(2)
            yield k, members, at, weight, label, np.take_along_axis(apart, label[:, :, None], 2)[:, :, 0]


def _sums(points: DataFrame, bank: _Bank, width: int) -> list:
    """One row a centre in use: at, n, cost, squares, s0 ... (weighted sums)."""
    names = ["n", "cost", "squares", *[f"s{j}" for j in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bank.size, 3 + width))
        for batch in batches:
            x, w = _matrix(batch.column(0), batch.num_rows), _matrix(batch.column(1), batch.num_rows)
            squares = (x * x).sum(1)
            for k, members, at, weight, label, cost in bank.assign(x):
                spot = (at + k * np.arange(len(members)) + label).ravel()
                mass = w[:, weight].astype(float)
                for j, value in enumerate((None, cost, squares[:, None], *x.T[:, :, None])):
                    total[:, j] += np.bincount(spot, (mass if value is None else mass * value).ravel(), bank.size)
        used = np.flatnonzero(total[:, 0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, j]) for j in range(3 + width)]], names=["at", *names])

    partial = points.select("features", "weights").mapInArrow(run, "at bigint, " + ", ".join(f"{c} double" for c in names))
    return partial.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()  # as many rows as centres


def fit(points: DataFrame, models: Sequence[Model]) -> list[Fit]:
    """Lloyd's iterations of all ``models`` over ``points`` (features, weights), at most ``ROUNDS`` passes."""
    rows = points.select("features", "weights").orderBy(F.xxhash64("features"), "features").limit(START_POINTS).collect()
    sample, weights = np.array([r["features"] for r in rows], float), np.array([r["weights"] for r in rows], float)
    fits = [Fit(m, plus_plus(sample, weights[:, m.weight], m.k, np.random.default_rng(m.seed)), np.inf) for m in models]
    moving, width = list(range(len(fits))), sample.shape[1]
    for _ in range(ROUNDS):
        bank = _Bank([(fits[i].model.k, fits[i].model.weight, fits[i].centers) for i in moving])
        total = np.zeros((bank.size, 3 + width))
        for r in _sums(points, bank, width):
            total[r["at"]] = list(r)[1:]
        still = []
        for i, first in zip(moving, bank.first, strict=True):
            part = total[first : first + fits[i].model.k]
            used = part[:, 0] > 0
            moved = fits[i].centers.copy()
            moved[used] = part[used, 3:] / part[used, :1]
            shift = np.sqrt(((moved - fits[i].centers) ** 2).sum(1)).max()
            fits[i].centers, fits[i].cost = moved, float(part[:, 1].sum())
            if shift > TOLERANCE:
                still.append(i)
        moving = still
        if not moving:
            break
    return fits


def best(fits: Sequence[Fit], alike) -> dict:
    """The cheapest fit for each value of ``alike(model)``."""
    found: dict = {}
    for f in fits:
        key = alike(f.model)
        if key not in found or f.cost < found[key].cost:
            found[key] = f
    return found


def labels(points: DataFrame, fits: Sequence[Fit], key: str = "station_id") -> DataFrame:
    """``key`` and an array with the cluster of each fit."""
    bank, name_key = _Bank([(f.model.k, 0, f.centers) for f in fits]), key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, bank.count), np.int32)
            for _, members, _, _, label, _ in bank.assign(_matrix(batch.column(1), batch.num_rows)):
                found[:, members] = label
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bank.count, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[name_key, "labels"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "features").mapInArrow(run, f"{key} {kind}, labels array<int>")


def sizes_and_silhouettes(points: DataFrame, fits: Sequence[Fit]) -> list[tuple[list[int], float]]:
    """For each fit its cluster sizes and the mean squared-Euclidean silhouette (NaN with fewer than two clusters in use).

    Mean distances to a cluster follow from its count, sum and sum of squares, so two passes serve all fits.
    """
    bank = _Bank([(f.model.k, 0, f.centers) for f in fits])
    width = fits[0].centers.shape[1]
    total = np.zeros((bank.size, 3 + width))
    for r in _sums(points, bank, width):
        total[r["at"]] = list(r)[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.zeros(bank.count)
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows)
            own = (x * x).sum(1)
            for k, members, at, _, label, _ in bank.assign(x):
                part = total[at : at + k * len(members)]
                n = part[:, 0]
                with np.errstate(all="ignore"):
                    mean = np.maximum(own[:, None] - 2 * x @ (part[:, 3:] / n[:, None]).T + part[:, 2] / n, 0).reshape(len(x), len(members), k)
                    count = n.reshape(len(members), k)
                    mine = np.take_along_axis(mean, label[:, :, None], 2)[:, :, 0]
                    size = count[np.arange(len(members)), label]
                    inside = mine * size / (size - 1)
                    others = np.where(count > 0, mean, np.inf)
                    np.put_along_axis(others, label[:, :, None], np.inf, 2)
                    outside = others.min(2)
                    value = np.where((size > 1) & np.isfinite(outside), (outside - inside) / np.maximum(inside, outside), 0.0)
                score[members] += np.nan_to_num(value).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bank.count)), pa.array(score)], names=["fit", "score"])

    sums = {r["fit"]: r["score"] for r in points.select("features").mapInArrow(run, "fit bigint, score double").groupBy("fit").agg(F.sum("score").alias("score")).collect()}
    out = []
    for i, f in enumerate(fits):
        n = total[bank.first[i] : bank.first[i] + f.model.k, 0]
        used = n[n > 0]
        out.append(([int(v) for v in used], float(sums[i] / n.sum()) if len(used) > 1 else float("nan")))
    return out


def agreements(labelled: DataFrame, pairs: Sequence[tuple[int, int]]) -> list[float]:
    """Adjusted Rand index for each pair of positions in ``labels``, from one aggregation of contingency counts."""
    if not pairs:
        return []
    wanted = F.array(*[F.struct(F.lit(i).alias("pair"), F.get("labels", F.lit(a)).alias("a"), F.get("labels", F.lit(b)).alias("b")) for i, (a, b) in enumerate(pairs)])
    cells = labelled.select(F.inline(wanted)).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    tables: dict[int, list[tuple[int, int, int]]] = {}
    for r in cells.collect():  # k * k rows a pair
        tables.setdefault(r["pair"], []).append((r["a"], r["b"], r["n"]))
    return [_rand(tables.get(i, [])) for i in range(len(pairs))]


def _rand(cells: list[tuple[int, int, int]]) -> float:
    two = lambda n: n * (n - 1) / 2
    sides: tuple[dict, dict] = ({}, {})
    for a, b, n in cells:
        sides[0][a] = sides[0].get(a, 0) + n
        sides[1][b] = sides[1].get(b, 0) + n
    together = sum(two(n) for _, _, n in cells)
    left, right = (sum(two(n) for n in side.values()) for side in sides)
    everything = two(sum(n for _, _, n in cells))
    expected = left * right / everything if everything else 0.0
    top = (left + right) / 2
    return 1.0 if top == expected else (together - expected) / (top - expected)


def prepared(points: DataFrame, n: int, sizes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """:func:`with_weights`, written once."""
    return cut_lineage(with_weights(points, n, sizes, seeds))
