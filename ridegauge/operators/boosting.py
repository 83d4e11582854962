"""Boosted regression trees of rows that one task can hold: GBTRegressor's algorithm without jobs for every level of every tree.

Candidate thresholds, variance gains, ties, leaves and weights follow Spark's GBTRegressor (squared loss, 32 bins, all rows, all features),
so both give the same trees; only the thresholds of a table of more than 10,000 rows differ, where Spark takes them from a sample and
this takes them from all rows. Functions of this module travel to the executors by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 32
EPSILON = 2.0**-52

#: Rows of a batch that walk all trees at once.
WALK_ROWS = 1_000


class Forest:
    """Fitted trees as flat arrays: a row goes to ``left`` or, above the threshold, to the node after it; leaves point to themselves."""

    def __init__(self, columns: Sequence[str], trees: Sequence[tuple], cuts: Sequence[np.ndarray], rate: float, depth: int):
        sizes = [len(t[0]) for t in trees]
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.columns, self.depth, self.roots = list(columns), depth, start
        self.feature = np.concatenate([np.maximum(t[0], 0) for t in trees])
        self.threshold = np.concatenate([np.array([cuts[j][c] if j >= 0 else np.inf for j, c in zip(t[0], t[1])]) for t in trees])
        own = [np.arange(s) for s in sizes]
        self.left = np.concatenate([np.where(t[0] >= 0, t[2], o) + s for t, o, s in zip(trees, own, start)])
        self.value = np.concatenate([t[3] for t in trees])
        self.weights = np.array([1.0] + [rate] * (len(trees) - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x`` (rows, columns)."""
        out = np.empty(len(x))
        for at in range(0, len(x), WALK_ROWS):
            part = x[at : at + WALK_ROWS]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = self.left[node] + (part[row, self.feature[node]] > self.threshold[node])
            out[at : at + WALK_ROWS] = self.value[node] @ self.weights
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``_p``; a null or NaN feature is an error."""
        if not hasattr(self, "_udf"):
            forest = self

            def predict(*features):
                return pd.Series(forest.predict(finite(features)))

            self._udf = F.pandas_udf(predict, "double")
        return rows.withColumn("_p", self._udf(*[F.col(c).cast("double") for c in self.columns]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_udf"}


def finite(features: Sequence) -> np.ndarray:
    x = np.column_stack([np.asarray(f, dtype=float) for f in features])
    if np.isnan(x).any():
        raise ValueError("a feature is null or not a number")
    return x


# ---- thresholds ------------------------------------------------------------------------------------------------------


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Split candidates of one feature from its sorted distinct values: all midpoints, or the ones nearest to equal strides."""
    rows = int(counts.sum())
    most = min(MAX_BINS, rows) - 1
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    reached = np.cumsum(counts).astype(float)
    half = (reached[:-1] + reached[1:]) / 2  # a value past it leaves the target nearer to the value before
    stride = rows / (most + 1)
    out, at, target = [], 0, stride
    while (at := max(at, int(np.searchsorted(half, target, side="right")))) < len(half):
        out.append(middle[at])
        at, target = at + 1, target + stride
    return np.array(out)


def feature_cuts(rows: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Thresholds of every column, from the counts of its distinct values; a task holds those of one column."""

    def cut(table: pa.Table) -> pa.Table:
        value, n = (table[c].to_numpy() for c in ("value", "n"))
        order = np.argsort(value)
        return pa.table({"at": table["at"][:1], "cuts": pa.array([thresholds(value[order], n[order])], pa.list_(pa.float64()))})

    cells = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("at", "value"))
    counted = cells.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    found = {r["at"]: r["cuts"] for r in counted.groupBy("at").applyInArrow(cut, "at int, cuts array<double>").collect()}
    return [np.array(found[i], dtype=float) for i in range(len(columns))]


# ---- growing ---------------------------------------------------------------------------------------------------------


def variance(n, total, squares):
    """Population variance from sums; zero without rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (squares - total * total / n) / n, 0.0)


def grow(bins: np.ndarray, y: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[tuple, np.ndarray]:
    """One tree over ``bins`` (features, rows) and the value of each row. Level by level; of equal gains the first feature and lowest threshold win."""
    features, width = len(bins), int(sizes.max(initial=0)) + 1
    feature, cut, left, value = [-1], [0], [0], [0.0]
    at = np.zeros(y.size, np.int64)  # tree node of each row
    open_nodes, impurity = np.array([0]), None
    live, where, x, r = None, np.zeros(y.size, np.int64), bins, y  # rows of open nodes and the place of their node
    exists = np.arange(width - 1) < sizes[:, None]
    for level in range(depth):
        k = len(open_nodes)
        sums = np.empty((3, k, features, width))
        base, squares = where * width, r * r
        for j in range(features):
            cell = base + x[j]
            for i, w in enumerate((None, r, squares)):
                sums[i, :, j] = np.bincount(cell, w, k * width).reshape(k, width)
        sums = sums.cumsum(axis=-1)
        lower, upper = sums[..., :-1], sums[..., -1:] - sums[..., :-1]
        if impurity is None:
            if not exists.any():
                value[0] = sums[1, 0, 0, -1] / sums[0, 0, 0, -1]
                break
            j = int(np.argmax(sizes > 0))
            whole = lower[:, 0, j, 0] + upper[:, 0, j, 0]
            impurity, value[0] = np.array([float(variance(*whole))]), whole[1] / whole[0]
        low, high = variance(*lower), variance(*upper)
        n = lower[0] + upper[0]
        gain = impurity[:, None, None] - lower[0] / n * low - upper[0] / n * high
        gain[~(exists & (lower[0] > 0) & (upper[0] > 0) & (gain >= 0))] = -np.inf
        best = gain.reshape(k, -1).argmax(axis=1)
        split = np.flatnonzero(gain.reshape(k, -1)[np.arange(k), best] > 0)
        if not len(split):
            break
        f, c = np.divmod(best, width - 1)
        child = np.full((k, 2), -1)  # place of a child that stays open
        first = np.full(k, -1)
        opened, spread = [], []
        for s in split.tolist():
            a, b = int(f[s]), int(c[s])
            node = int(open_nodes[s])
            feature[node], cut[node], left[node] = a, b, len(value)
            first[s] = len(value)
            for side, (sums_, var) in enumerate(((lower, low), (upper, high))):
                feature.append(-1)
                cut.append(0)
                left.append(0)
                value.append(sums_[1, s, a, b] / sums_[0, s, a, b])
                if level + 1 < depth and abs(var[s, a, b]) >= EPSILON:
                    child[s, side] = len(opened)
                    opened.append(len(value) - 1)
                    spread.append(var[s, a, b])
        right = (x[f[where], np.arange(where.size)] > c[where]).astype(np.int64)
        moved = first[where] >= 0
        rows = np.flatnonzero(moved) if live is None else live[moved]
        at[rows] = (first[where] + right)[moved]
        if not opened:
            break
        where = np.where(moved, child[where, right], -1)
        kept = where >= 0
        if not kept.all():
            live = np.flatnonzero(kept) if live is None else live[kept]
            where, x, r = where[kept], x[:, kept], r[kept]
        open_nodes, impurity = np.array(opened), np.array(spread)
    tree = np.array(feature), np.array(cut), np.array(left), np.array(value)
    return tree, tree[3][at]


def boost(bins: np.ndarray, y: np.ndarray, cuts: Sequence[np.ndarray], params: dict) -> list[tuple]:
    """Trees fitted to the residuals of those before; all but the first count with the learning rate."""
    sizes, rate = np.array([len(c) for c in cuts]), float(params["learning_rate"])
    trees, predicted, residual = [], None, y
    for _ in range(int(params["n_estimators"])):
        tree, value = grow(bins, residual, sizes, int(params["max_depth"]))
        trees.append(tree)
        predicted = value if predicted is None else predicted + value * rate
        residual = 2.0 * (y - predicted)
    return trees


# ---- on Spark --------------------------------------------------------------------------------------------------------


def fit(rows: DataFrame, many: Sequence[dict], columns: Sequence[str]) -> list[Forest]:
    """A forest for each parameter set, each fitted in a task of its own. A row travels as a byte a feature and its target."""
    cuts = feature_cuts(rows, columns)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = finite([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
                bins = np.stack([np.searchsorted(cut, x[:, j]).astype(np.uint8) for j, cut in enumerate(cuts)])
                y = batch.column("target").to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "y": [y.tobytes()]})

    blocks = rows.select(*columns, F.col("target").cast("double").alias("target")).mapInArrow(encode, "bins binary, y binary").collect()
    if not blocks:
        raise ValueError("no rows to fit trees on")
    y = np.concatenate([np.frombuffer(b["y"]) for b in blocks])
    bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(len(columns), -1) for b in blocks], axis=1)
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((bins, y))
    try:
        jobs = context.parallelize(list(enumerate(many)), len(many))
        fitted = dict(jobs.map(lambda job: (job[0], boost(*shared.value, cuts, job[1]))).collect())
    finally:
        shared.destroy()
    return [Forest(columns, fitted[i], cuts, float(p["learning_rate"]), int(p["max_depth"])) for i, p in enumerate(many)]
