"""Change points of a series' level: optimal partitioning with a penalty, pruned.

The cost of a segment is its sum of squares around its mean, read from running sums at both ends, so the search is a fold over positions whose
state is a set of candidates for the last change (numpy arrays, one step of vector arithmetic a position). A candidate whose cost has reached
that of the best partition can't win any more once the present position may itself be a change, and leaves; each candidate carries its path, so
no table of predecessors is kept. Long series are folded in blocks: the state of one block is the start of the next, so a group never holds
more than ``BLOCK`` positions and the candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.session import cut_lineage

BLOCK = 8_192
MIN_POINTS = 40
#: Fewest points of a segment.
MIN_SEGMENT = 2
METHOD = "penalised_partitioning_least_squares"
_NEVER = 2**31 - 1


def signal(value: str) -> Column:
    return F.log1p(F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)))


def _folder(least: int, names: Sequence[str]):
    """The fold over one block of one series, for ``applyInArrow`` on (rows, state); nested, so that it travels by value."""
    import numpy as np
    import pyarrow as pa

    never = _NEVER

    def fold(positions, sums, squares, penalty, state):
        pos, s, q, f, until, paths = state
        for t, st, qt in zip(positions, sums, squares):
            alive = until >= t
            if not alive.all():
                pos, s, q, f, until = pos[alive], s[alive], q[alive], f[alive], until[alive]
                paths = [p for p, a in zip(paths, alive) if a]
            d = st - s
            v = f + qt - q - d * d / (t - pos)
            fit = int(np.searchsorted(pos, t - least, "right"))  # candidates stand in order
            if not fit:
                continue
            best = int(v[:fit].argmin())
            cost = v[best] + penalty
            until = np.where(v >= cost, np.minimum(until, t + least - 1), until)  # the last position at which a candidate may still win
            path = (paths[best], int(pos[best])) if pos[best] > 0 else paths[best]
            pos, s, q, f = np.append(pos, t), np.append(s, st), np.append(q, qt), np.append(f, cost)
            until, paths = np.append(until, never), [*paths, path]
        return pos, s, q, f, until, paths

    def listed(path):
        out = []
        while isinstance(path, tuple):
            path, at = path
            out.append(at)
        return [*path, *reversed(out)]

    def run(key, rows, state):
        if not rows.num_rows:  # the series has ended
            return state.select(list(names))
        rows = rows.sort_by("pos")
        column = lambda table, name: table.column(name).to_numpy()
        penalty = rows.column("_penalty")[0].as_py()
        if state.num_rows:
            state = state.sort_by("pos")
            begin = *(column(state, n) for n in ("pos", "s", "q", "f", "until")), state.column("path").to_pylist()
        else:
            begin = np.array([0]), np.array([0.0]), np.array([0.0]), np.array([-penalty]), np.array([never]), [[]]
        pos, s, q, f, until, paths = fold(column(rows, "pos"), column(rows, "s"), column(rows, "q"), penalty, begin)
        made = {"pos": pa.array(pos, pa.int32()), "s": pa.array(s), "q": pa.array(q), "f": pa.array(f), "until": pa.array(until, pa.int32())}
        made["path"] = pa.array([listed(p) for p in paths], pa.list_(pa.int32()))
        for name in names[: -len(made)]:
            made[name] = pa.array([rows.column(name)[0].as_py()] * len(pos), rows.schema.field(name).type)
        return pa.table({name: made[name] for name in names})

    return run


def change_points(prepared: DataFrame, keys: Sequence[str], value: str = "value_filled", least: int = MIN_SEGMENT, block: int | None = None) -> DataFrame:
    """``keys``, ``position`` (rows before the change, from 1), ``timestamp`` of the last of them, ``shift`` of the mean of ``log1p``, ``label``.

    The penalty of a change is ``max(log(n) * variance, 1)``. Nulls count as 0, negatives too. Series under ``MIN_POINTS`` rows have none.
    """
    block = block or BLOCK
    series = W.partitionBy(*keys)
    ordered = series.orderBy("timestamp")
    rows = prepared.select(*keys, "timestamp", signal(value).alias("_x"))
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(series), "_mean": F.avg("_x").over(series), "_var": F.var_pop("_x").over(series)})
    rows = rows.filter(F.col("_n") >= MIN_POINTS).withColumn("_d", F.col("_x") - F.col("_mean"))
    rows = rows.select(
        *keys, "timestamp", "_x", "_n", F.greatest(F.log(F.col("_n")) * F.col("_var"), F.lit(1.0)).alias("_penalty"),
        F.row_number().over(ordered).alias("pos"), F.sum("_d").over(ordered).alias("s"), F.sum(F.col("_d") * F.col("_d")).over(ordered).alias("q"),
    )
    rows = cut_lineage(rows)
    last = rows.agg(F.max("pos")).first()[0]
    if last is None:
        return rows.select(*keys, F.lit(0).alias("position"), "timestamp", F.lit(0.0).alias("shift"), F.lit("").alias("label"))
    points = rows.select(*keys, "_penalty", "pos", "s", "q")
    state = points.limit(0).select(
        *keys, F.lit(0).alias("pos"), "s", "q", F.lit(0.0).alias("f"), F.lit(0).alias("until"), F.array().cast("array<int>").alias("path")
    )
    folder = _folder(least, state.columns)
    for b in range((last - 1) // block + 1):
        part = points.filter(F.floor((F.col("pos") - 1) / block) == b)
        state = cut_lineage(part.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInArrow(folder, state.schema))
    final = state.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by("path", "pos").alias("_path"))
    # Segment means from the rows: a row belongs to the segment behind the last change before it.
    joined = rows.join(final, [rows[k].eqNullSafe(final[f"_{k}"]) for k in keys])
    segment = F.size(F.filter("_path", lambda p: p < F.col("pos")))
    parts = joined.groupBy(*keys, segment.alias("_segment")).agg(F.avg("_x").alias("_level"), F.max("pos").alias("position"), F.max("timestamp").alias("timestamp"))
    following = W.partitionBy(*keys).orderBy("_segment")  # one row a segment
    found = parts.withColumn("shift", F.lead("_level").over(following) - F.col("_level")).filter("shift IS NOT NULL")
    return found.select(*keys, "position", "timestamp", "shift", F.lit("detected_level_shift").alias("label"))


def level_shift_status(prepared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether a series was searched, how, and why not."""
    enough = F.count(F.lit(1)) >= MIN_POINTS
    return prepared.groupBy(*keys).agg(
        F.when(enough, "ok").otherwise("insufficient_history").alias("level_shift_detection_status"),
        F.lit(METHOD).alias("level_shift_detection_method"),
        F.when(enough, "the whole series was searched").otherwise(f"fewer than {MIN_POINTS} rows").alias("level_shift_detection_reason"),
    )
