"""Building blocks that stay whole under key skew: keyed dedupe, exact quantiles, global ranks, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ridegauge.session import cut_lineage


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """True when ``df`` has no more than ``bound`` rows; reads at most ``bound + 1`` of them."""
    return df.limit(bound + 1).count() <= bound


#: Rows that a task of windows over whole keys gets, about.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, keys: Sequence[str], rows: int, per_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` asks for, so that the sorts of a task stay of one size however large the table.

    ``rows`` counts what the tasks make of ``df``, which may be more than it holds. An explicit number is not merged again by adaptive execution.
    """
    return df.repartition(max(1, -(-rows // per_task)), *keys)


def spread_days(daily: DataFrame, key: str) -> DataFrame:
    """``daily`` written once and dealt by ``key``, counting a row for each key and day between the first and last date of all."""
    daily = cut_lineage(daily)
    days = F.coalesce(F.datediff(F.max("date"), F.min("date")) + 1, F.lit(1))
    return spread(daily, [key], daily.agg((F.approx_count_distinct(key) * days).alias("n")).first()["n"])


def with_one_row(df: DataFrame, frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the columns of ``frame``, an aggregate of one row, by a single subquery however many columns it has."""
    names = list(columns or frame.columns)
    packed = frame.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", packed).select(*df.columns, *[F.col("_row")[n].alias(n) for n in names])


def per_date(df: DataFrame) -> DataFrame:
    """Mark a frame with one row per calendar date.

    A date column holds at most one row per day of history, so a century is under 40,000 rows whatever the fact size.
    """
    return F.broadcast(df)


def deal(df: DataFrame) -> DataFrame:
    """``df`` in even shares for all tasks, its columns computed.

    Comes before lookups that make many rows of one: their generated code would evaluate the expressions of ``df`` anew for every match.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a side that a lookup sends whole to every executor, some 50 MB.
LOOKUP_ROWS = 500_000

#: Rows of one key in a larger side for which a lookup deals its matches to one more task.
LOOKUP_REPEATS = 100


def lookup(df: DataFrame, side: DataFrame, key: str, most: int = LOOKUP_ROWS) -> DataFrame:
    """Inner join on ``key`` where a key may repeat in ``side`` and so make many rows of each row of ``df``.

    A shuffled join makes all rows of such a key in one task, and adaptive execution does not see it, because its input is small. Up to
    ``most`` rows of ``side`` are counted and broadcast, so rows are made where ``df`` lies; beyond that, rows of ``df`` with a repeated key
    are dealt to tasks, each with a copy of the key's rows.
    """
    if rows_at_most(side, most):
        return df.join(F.broadcast(side), key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeats = side.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LOOKUP_REPEATS)
    repeats = repeats.select(key, F.least(F.ceil(F.col("_n") / LOOKUP_REPEATS), F.lit(parts)).cast("int").alias("_shares"))
    shares = F.coalesce("_shares", F.lit(1))
    dealt = df.join(repeats, key, "left").withColumn("_share", F.pmod(F.monotonically_increasing_id(), shares).cast("int"))
    copied = side.join(repeats, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.drop("_shares").join(copied.drop("_shares"), [key, "_share"]).drop("_share")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key; partial aggregation absorbs hot keys."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary-key check at load; raises with one offending key."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"key {list(keys)} is not unique, for example {bad[0].asDict()}")
    return df


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Consecutive 1-based ranks over a total order without a single-task window.

    Range partitioning sorts in parallel; only one count per partition is accumulated. The sorted rows are checkpointed
    so that the counts and the rows come from the same materialisation even if an executor is lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tagged = cut_lineage(ordered.withColumn("_mono", F.monotonically_increasing_id()))
    block = F.shiftright("_mono", 33)
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(block.alias("_block")).agg((F.max(local) + 1).alias("_n"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        tagged.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, local + F.col("_offset") + 1)
        .drop("_block", "_mono", "_offset")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    splits: int = 64,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated exact quantiles per key; no task ever holds a whole group.

    Equal values collapse into counts first. A sketch per key only *places* values into ``splits`` ordered buckets; the
    bucket counts locate the order statistics and just the buckets that hold them are ranked.
    Returns one row per key with ``n`` and one column per entry of ``probs``.
    """
    keys = list(keys)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(size.cast("long").alias("_c"))
    )
    cuts = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    sketch = F.percentile_approx("_v", cuts, F.lit(splits * 20)).alias("_cuts")
    if keys:
        placed = counted.join(counted.groupBy(*keys).agg(sketch), keys)
    else:
        placed = counted.withColumn("_cuts", counted.agg(sketch).scalar())
    placed = placed.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")

    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # at most ``splits`` rows per key below
    buckets = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    before = by_key.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_off", F.coalesce(F.sum("_bc").over(before), F.lit(0))).withColumn(
        "n", F.sum("_bc").over(by_key)
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("pos"),
            )
            for name, p in probs.items()
        ]
    )
    holds = lambda w: (F.floor(w["pos"]) < F.col("_off") + F.col("_bc")) & (F.ceil(w["pos"]) >= F.col("_off"))
    needed = buckets.withColumn("_w", F.filter(wanted, holds)).filter(F.size("_w") > 0).select(
        *keys, "_b", "_off", "n", "_w"
    )
    rows = placed.join(needed, [*keys, "_b"]) if keys else placed.join(F.broadcast(needed), "_b")
    in_bucket = W.partitionBy(*keys, "_b").orderBy("_v")
    rows = rows.withColumn("_hi", F.col("_off") + F.sum("_c").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_lo", F.col("_hi") - F.col("_c"))
    inside = lambda p: (p >= F.col("_lo")) & (p < F.col("_hi"))
    picked = rows.select(*keys, "n", "_v", "_lo", "_hi", F.explode("_w").alias("_w")).select(
        *keys,
        "n",
        F.col("_w.name").alias("_name"),
        F.col("_w.pos").alias("_pos"),
        F.when(inside(F.floor("_w.pos")), F.col("_v")).alias("_vlo"),
        F.when(inside(F.ceil("_w.pos")), F.col("_v")).alias("_vhi"),
    )

    def one(name: str) -> Column:
        mine = F.col("_name") == name
        low, high = F.max(F.when(mine, F.col("_vlo"))), F.max(F.when(mine, F.col("_vhi")))
        pos = F.max(F.when(mine, F.col("_pos")))
        return (low + (high - low) * (pos - F.floor(pos))).alias(name)

    return picked.filter("_vlo IS NOT NULL OR _vhi IS NOT NULL").groupBy(*keys, "n").agg(*[one(n) for n in probs])
