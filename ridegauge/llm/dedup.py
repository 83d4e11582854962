"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every partition normalises its texts, hashes them and cuts its rows into blocks (written once: id, hash, block; no texts).
2. A block sends each owner of a fingerprint range its sorted distinct fingerprints, Golomb-coded, with a bitmap of those that the
   block itself holds more than once.
3. An owner compares the blocks' lists and answers each block with a bitmap of the fingerprints that occur elsewhere too.
4. Rows under a set bit are suspects. Up to ``BROADCAST_GROUPS`` distinct suspect hashes are broadcast, so that only suspects' texts leave their task;
   beyond that, texts meet the hashes in a join on (hash, salt), which spreads a large group. Grouping by the whole normalised text compares bytes, with
   partial aggregation before the shuffle, so that a group of copies of any size is one row a task.

Null counts as empty. White space inside a text is one space for each run of ``[\\x20\\x09-\\x0D]``; ends are not trimmed. Of equal
texts, the smallest id stays. Rows that repeat both id and text are the same document and get the same answer; a null id is
larger than any other. Columns beyond doc_id and text are not read by :func:`find_copies`; :func:`drop_copies` keeps them, and of rows that
repeat the id and text that stay it keeps one, chosen by a hash of all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridegauge.llm.common import fresh, materialize, partitions, raw, ready, slices, table, texts_of
from ridegauge.llm.exchange import rice_decode, rice_encode

BLOCK_ROWS = 1 << 18
BLOCKS_AN_OWNER = 8
FINGERPRINT_BITS = 48
#: At about 100 bytes a group, 50 MB are broadcast at most.
BROADCAST_GROUPS = 500_000
SALTS = 16
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    data = data.translate(_TO_SPACE)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def normalised(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaced, " {2,}", " ")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, sha (32 bytes), fingerprint, block; one row per document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            shas = [hashlib.sha256(normalise(raw(t))).digest() for t in texts_of(batch)]
            marks = [int.from_bytes(s[: FINGERPRINT_BITS // 8], "big") for s in shas]
            blocks = [(part << 24) + (seen + i) // BLOCK_ROWS for i in range(len(shas))]
            seen += len(shas)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.binary()), pa.array(marks, pa.int64()), pa.array(blocks, pa.int64())],
                names=["doc_id", "sha", "fingerprint", "block"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, sha binary, fingerprint bigint, block bigint")


def _owner(fingerprints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of fingerprints, so a block's sorted list falls into one run for each owner."""
    return (fingerprints * owners) >> FINGERPRINT_BITS


def _send(owners: int):
    def send(block: pd.DataFrame) -> pd.DataFrame:
        marks, counts = np.unique(block["fingerprint"].to_numpy(), return_counts=True)
        whose = _owner(marks, owners)
        width = (1 << FINGERPRINT_BITS) // owners
        out = []
        for o in np.unique(whose):
            mine = whose == o
            offset = marks[mine] - int(o) * (1 << FINGERPRINT_BITS) // owners
            bits = max(1, int(width).bit_length())
            out.append((int(o), int(block["block"].iloc[0]), int(mine.sum()), rice_encode(offset, bits), np.packbits(counts[mine] > 1).tobytes()))
        return pd.DataFrame(out, columns=["owner", "block", "n", "coded", "twice"])

    return send


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of one owner's fingerprints that occur more than once, in the order each block sent them."""
    decoded = [rice_decode(c, n) for c, n in zip(lists["coded"], lists["n"], strict=True)]
    twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(lists["twice"], lists["n"], strict=True)]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    common = values[counts > 1]
    bitmaps = []
    for d, t in zip(decoded, twice, strict=True):
        bitmaps.append(np.packbits(t | np.isin(d, common, assume_unique=True)).tobytes())
    return pd.DataFrame({"block": lists["block"], "owner": lists["owner"], "n": lists["n"], "bitmap": bitmaps})


def _mark(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    answers = answers.sort_values("owner")
    marks = np.unique(block["fingerprint"].to_numpy())
    flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(answers["bitmap"], answers["n"], strict=True)]
    suspect = np.concatenate(flags)[np.searchsorted(marks, block["fingerprint"].to_numpy())] if len(block) else np.zeros(0, bool)
    return pd.DataFrame({"doc_id": block["doc_id"], "sha": block["sha"], "suspect": suspect})


def owners_for(spark: SparkSession, blocks: int) -> int:
    """An owner's lists hold about ``BLOCKS_AN_OWNER`` blocks' worth of fingerprints; small inputs use all partitions."""
    return max(partitions(spark), blocks // BLOCKS_AN_OWNER)


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    spark = ready(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = materialize(_hashed(docs))
    owners = owners_for(spark, hashed.select("block").distinct().count())
    sent = hashed.select("block", "fingerprint").groupBy("block").applyInPandas(_send(owners), "owner int, block bigint, n int, coded binary, twice binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "block bigint, owner int, n int, bitmap binary")
    flagged = materialize(
        hashed.select("block", F.struct("doc_id").alias("doc_id"), "sha", "fingerprint")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_mark, f"doc_id struct<doc_id: {id_type}>, sha binary, suspect boolean")
        .select("doc_id.doc_id", "sha", "suspect")
    )
    suspects = flagged.filter("suspect").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"))
    wanted = suspects.select(F.col("text_sha256").alias("sha")).distinct()
    few = wanted.count() <= BROADCAST_GROUPS
    texts = docs.select("doc_id", normalised(F.col("text")).alias("whole")).withColumn("sha", F.sha2("whole", 256))
    found = _meet(texts, wanted, "sha", few, "left_semi")
    # Grouping by the whole text compares bytes; two texts behind one hash would be an error, never a merge.
    verified = found.groupBy("sha", "whole").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = verified.groupBy("sha").agg(
        F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    groups = groups.select("sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts with one hash"))).cast("long").alias("group_size"))
    alone = flagged.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    shared = _meet(suspects.withColumnRenamed("text_sha256", "sha"), groups, "sha", few, "inner").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(shared)


def _meet(rows: DataFrame, one_a_key: DataFrame, key: str, few: bool, how: str) -> DataFrame:
    """``rows`` joined with a side that has one row a key: broadcast if that side is known to be small, else with its rows repeated for each salt."""
    if few:
        return rows.join(F.broadcast(one_a_key), key, how)
    salted = one_a_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts; all columns stay."""
    rows = materialize(find_copies(docs).select("doc_id", "kept", "text_sha256"))
    # One row for each document that has to go or that is there more than once.
    listed = rows.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("times")).filter("NOT kept OR times > 1")
    listed = materialize(listed.select(F.col("doc_id").alias("listed_id"), F.col("text_sha256").alias("listed_sha"), "kept"))
    many, repeated = listed.agg(F.count(F.lit(1)), F.count_if("kept")).first()
    if many <= BROADCAST_GROUPS:
        listed = F.broadcast(listed)
    sha = fresh(docs, "whole_sha")
    marked = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    same = marked["doc_id"].eqNullSafe(listed["listed_id"]) & (marked[sha] == listed["listed_sha"])
    left = marked.join(listed, same, "left_anti").drop(sha)
    if not repeated:
        return left
    again = marked.join(listed.filter("kept"), same, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy("doc_id", sha).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return left.unionByName(one.select("row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH whole AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM whole
"""
