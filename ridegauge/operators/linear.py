"""Least squares for a fleet of series: scaled cross products are aggregated by Spark, only p x p systems are solved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ridegauge.session import cut_lineage


def fleet_ols(
    df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, intercept: bool = True, null_regressor: float | None = None
) -> DataFrame:
    """``coefficients`` (intercept first), ``standard_errors``, ``sse``, ``nobs`` per series.

    The products are sums, so partial aggregation keeps a long series from landing whole in one task; the solve sees one
    small row per series. Values are centred and scaled per series before they are multiplied, and the residual comes from a
    second pass over the rows, so offsets and trends of any size do not cancel. Rows with a null target are left out; a null
    regressor leaves its row out too, or counts as ``null_regressor`` where that is given.
    """
    keys = list(keys)
    k = len(xs)
    numbers = [f"_x{i}" for i in range(k)]
    values = {n: F.col(c).cast("double") for n, c in zip(numbers, xs)} | {"_y": F.col(y).cast("double")}
    rows = df.select(*keys, *[v.alias(n) for n, v in values.items()])
    if null_regressor is not None:
        rows = rows.na.fill(float(null_regressor), subset=numbers) if numbers else rows
    rows = cut_lineage(rows.na.drop(subset=[*numbers, "_y"]))  # read by three passes
    names = [*numbers, "_y"]
    if intercept:
        shape = [F.avg(n).alias(f"m{n}") for n in names] + [F.stddev_pop(n).alias(f"s{n}") for n in names]
    else:
        shape = [F.lit(0.0).alias(f"m{n}") for n in names] + [F.sqrt(F.avg(F.col(n) * F.col(n))).alias(f"s{n}") for n in names]
    scales = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("nobs"), *shape)
    scaled = rows.join(scales, keys) if keys else rows.crossJoin(F.broadcast(scales))  # one row without keys
    unit = {n: F.when(F.col(f"s{n}") > 0, (F.col(n) - F.col(f"m{n}")) / F.col(f"s{n}")).otherwise(0.0) for n in names}
    sums = scaled.select(*keys, *[v.alias(n) for n, v in unit.items()]).groupBy(*keys).agg(
        F.array(*[F.sum(F.col(numbers[i]) * F.col(numbers[j])) for i in range(k) for j in range(i, k)]).alias("xx"),
        F.array(*[F.sum(F.col(n) * F.col("_y")) for n in numbers]).alias("xy"),
    )
    systems = (sums.join(scales, keys) if keys else sums.crossJoin(F.broadcast(scales))).select(
        *keys, "nobs", "xx", "xy", F.array(*[f"m{n}" for n in names]).alias("means"), F.array(*[f"s{n}" for n in names]).alias("deviations")
    )
    arrays = ["coefficients", "_inverse"]
    schema = T.StructType(
        [*[systems.schema[c] for c in (*keys, "nobs", "means")], *[T.StructField(a, T.ArrayType(T.DoubleType())) for a in arrays]]
    )
    upper = np.triu_indices(k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas, inverses = [], []
            for xx, xy, means, deviations in zip(pdf["xx"], pdf["xy"], pdf["means"], pdf["deviations"]):
                m = np.zeros((k, k))
                m[upper] = np.asarray(xx, dtype=float)
                m = m + m.T - np.diag(np.diag(m))
                sd, mean = np.asarray(deviations, dtype=float), np.asarray(means, dtype=float)
                inverse = np.linalg.pinv(m, rcond=1e-12, hermitian=True) if k else m
                safe = np.where(sd[:k] > 0, sd[:k], 1.0)
                slope = np.where(sd[:k] > 0, (inverse @ np.asarray(xy, dtype=float)) * sd[k] / safe, 0.0)
                inverse = inverse / np.outer(safe, safe)
                betas.append(([mean[k] - slope @ mean[:k]] if intercept else []) + slope.tolist())
                # Diagonal of the inverse of the unscaled system; the intercept's is 1/n plus the part of the means.
                inverses.append(([float(mean[:k] @ inverse @ mean[:k])] if intercept else []) + np.diag(inverse).tolist())
            out = pdf[[*keys, "nobs", "means"]].copy()
            out["coefficients"], out["_inverse"] = betas, inverses
            yield out

    solved = cut_lineage(systems.mapInPandas(solve, schema))  # one row per series
    first = int(intercept)
    both = rows.join(solved, keys) if keys else rows.crossJoin(F.broadcast(solved))
    residual = F.col("_y") - F.get("means", F.lit(k)) if intercept else F.col("_y")
    for i, n in enumerate(numbers):
        residual = residual - F.get("coefficients", F.lit(i + first)) * (F.col(n) - F.get("means", F.lit(i)))
    sse = both.select(*keys, residual.alias("_r")).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r")).alias("sse"))
    fitted = solved.join(sse, keys) if keys else solved.crossJoin(F.broadcast(sse))
    free = F.col("nobs") - (k + first)
    variance = F.when(free > 0, F.col("sse") / free)
    part = lambda d, i: d + F.when(i == 0, 1.0 / F.col("nobs")).otherwise(0.0) if intercept else d
    errors = F.transform("_inverse", lambda d, i: F.when(part(d, i) * variance > 0, F.sqrt(part(d, i) * variance)))
    return fitted.select(*keys, "coefficients", errors.alias("standard_errors"), "sse", "nobs")
