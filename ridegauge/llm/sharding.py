"""Sharding by extendible hashing.

A document's hash is 60 bits of the MD5 of its id. A directory entry is a prefix of those bits; a bucket over the byte limit splits on
one more bit, others never do, so a document's shard is its shortest prefix whose bucket fits. Bucket sizes come from one aggregation
of (prefix, bytes) a round; only rows of buckets that no prefix of the round could make fit go to the next round, with more bits.

A document above the limit is a shard of its own, marked ``oversized``. Rows that repeat one id share all bits: if they do not fit
together, they are dealt to overflow pages of that bucket by their rank. Null texts have 0 bytes, a null id is an id. Further columns
are not read. An empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ridegauge.llm.common import materialize, ready, table

SHARD_BYTES = 64 << 20
HASH_BITS = 60
BITS_A_ROUND = 8


def hash_of(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(value: Column, bits: Column | int) -> Column:
    return F.shiftrightunsigned(value, HASH_BITS - bits) if isinstance(bits, int) else F.expr(f"shiftright(hash, {HASH_BITS} - depth)")


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, bytes, depth, prefix, page, shard, shard_bytes, oversized for every row of ``docs``."""
    ready(docs.sparkSession)
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_of(F.col("doc_id")).alias("hash"))
    rest = sized = materialize(sized)
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 4))
    done = []
    while True:
        fine = rest.withColumn("fine", _prefix(F.col("hash"), high))
        cells = fine.groupBy("fine").agg(F.sum("bytes").alias("b"))
        levels = cells.select("fine", "b", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.min("fine").alias("first"))
        fitting = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS))
        # A cell belongs to the shallowest prefix that fits.
        leaf = (
            levels.select("fine", "depth", "prefix")
            .join(fitting, ["depth", "prefix"])
            .groupBy("fine")
            .agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        )
        placed = fine.join(leaf, "fine", "left")
        done.append(placed.filter("leaf IS NOT NULL").select("doc_id", "bytes", "hash", "leaf.depth", "leaf.prefix", "leaf.shard_bytes"))
        if high == HASH_BITS:
            break
        rest = materialize(placed.filter("leaf IS NULL").select("doc_id", "bytes", "hash"))
        if rest.isEmpty():
            break
        low, high = high + 1, min(HASH_BITS, high + BITS_A_ROUND)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _pages(out, limit)


def _pages(placed: DataFrame, limit: int) -> DataFrame:
    """Split buckets that are over the limit with all bits used: rows of one id, dealt to overflow pages."""
    from ridegauge.operators.keyed import global_rank

    fits = placed.filter(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long")).withColumn("oversized", F.lit(False))
    over = placed.filter(F.col("shard_bytes") > limit)
    if not over.isEmpty():
        # The largest row sets how many rows a page holds, so every page of smaller rows fits.
        ranked = global_rank(over, ["hash", "bytes", "doc_id"], "rank")
        first = ranked.groupBy("hash").agg(F.min("rank").alias("first"), F.max("bytes").alias("most"))
        paged = ranked.join(first, "hash").withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1)))))
        paged = paged.withColumn("page", F.floor((F.col("rank") - F.col("first")) / F.col("rows")))
        sizes = paged.groupBy("hash", "page").agg(F.sum("bytes").alias("page_bytes"))
        paged = paged.join(sizes, ["hash", "page"]).withColumn("shard_bytes", F.col("page_bytes")).withColumn("oversized", F.col("page_bytes") > limit)
        fits = fits.unionByName(paged.select(fits.columns))
    return fits.select(
        "doc_id", "bytes", "depth", "prefix", "page", F.concat_ws("-", F.col("depth"), F.col("prefix"), F.col("page")).alias("shard"), "shard_bytes", "oversized"
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write ``docs`` to ``path``, one folder a shard. Rows of an id with overflow pages take its pages in the order of their sizes."""
    from ridegauge.operators.keyed import global_rank

    docs = docs.drop("shard")
    placed = materialize(assign(docs, limit).select(F.col("doc_id").alias("_id"), F.col("bytes").alias("_bytes"), "page", "shard"))
    ids = placed.groupBy("_id").agg(F.min("shard").alias("shard"), F.max("shard").alias("_last"))
    single, paged = ids.filter("shard = _last").drop("_last"), ids.filter("shard <> _last").select(F.col("_id").alias("_paged"))
    out = docs.join(single, docs["doc_id"].eqNullSafe(single["_id"])).drop("_id")
    if not paged.isEmpty():
        # Both sides hold the same ids and sizes, so equal ranks are rows of equal id and size; the last key spreads equal rows over tasks.
        row = F.monotonically_increasing_id()
        pages = placed.join(paged, placed["_id"].eqNullSafe(paged["_paged"]), "left_semi").withColumn("_row", row)
        ranks = global_rank(pages, ["_id", "_bytes", "page", "_row"], "_rank").select("_rank", "shard")
        rows = docs.join(paged, docs["doc_id"].eqNullSafe(paged["_paged"]), "left_semi")
        rows = rows.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("_row", row)
        rows = global_rank(rows, ["doc_id", "_bytes", "_row"], "_rank").join(ranks, "_rank").select(*docs.columns, "shard")
        out = out.unionByName(rows)
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), F.col("prefix").cast("long").alias("prefix"), "page", "shard", "shard_bytes", "oversized")


SQL = f"""
WITH sized AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash FROM documents),
     levels AS (SELECT doc_id, bytes, depth, hash >> (60 - depth) AS prefix FROM sized, range(0, 61) r(depth)),
     sums AS (SELECT *, sum(bytes) OVER (PARTITION BY depth, prefix)::BIGINT AS shard_bytes FROM levels),
     leaf AS (SELECT doc_id, bytes, min_by(depth, depth) AS depth, min_by(prefix, depth) AS prefix, min_by(shard_bytes, depth) AS shard_bytes
              FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60 GROUP BY doc_id, bytes)
SELECT doc_id, bytes, depth::INTEGER AS depth, prefix::BIGINT AS prefix, 0::BIGINT AS page,
       concat_ws('-', depth, prefix, 0) AS shard, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized
FROM leaf
"""
