"""SimHash near-dedup with vantage-point trees.

Fingerprints are taken over three-word shingles (XXH64, repeats included); equal fingerprints are one point. A vantage-point tree, grown
on a bounded sample of points, deals points out to shards: a node sends a point to the side of its vantage point's median distance on
which it lies (its home) and, as a visitor, also to the other side when the triangle bound allows a point within the radius there. In a
shard the same pruning goes on until the parts are small enough to compare; every pair within the radius is found in the home of one of
its points. A shard returns a spanning forest of its links, never the pairs, and connected components follow from those by large-star
and small-star rounds over written tables.

Null and empty texts have fingerprint 0 and are linked like any other. A component's id is the smallest id in it; null ids count only if
there is no other. Repeated rows share their fingerprint. Further columns are not read by :func:`components`; :func:`keep_first` passes
them through. An empty table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ridegauge.llm.common import add_columns, fresh, hash_sample, materialize, partitions, raw, ready, table
from ridegauge.llm.links import connected

SHINGLE = 3
SEED = 42
RADIUS = 2
SHARD_POINTS, LEAST_SHARD_POINTS = 16_384, 2_048
SAMPLE_A_SHARD = 64
COMPARE_AT_ONCE = 1 << 20


def fingerprint(data: bytes) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes have it."""
    words = data.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = list(map(len, words))
        starts = [0, *accumulate(s + 1 for s in sizes)]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:], strict=False)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed integer of 64 bits in a further column."""
    ready(docs.sparkSession)
    return add_columns(docs, f"`{name}` bigint", lambda texts: ([signed(fingerprint(raw(t))) for t in texts],))


class Tree:
    """Inner nodes in heap order: vantage point and distance limit; a leaf is a shard."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 11):
        self.depth = depth
        self.vantage, self.limit = np.zeros(2**depth - 1, np.uint64), np.zeros(2**depth - 1, np.int64)
        rng = np.random.default_rng(seed)
        parts = {0: sample}
        for node in range(2**depth - 1):
            points = parts.pop(node)
            best = None
            for v in rng.choice(points, min(8, len(points)), replace=False) if len(points) else []:
                d = np.bitwise_count(points ^ v).astype(int)
                m = int(np.median(d))
                # Fewest points near the limit, then the most even halves.
                cost = (float(((d >= m - 1) & (d <= m + 2)).mean()) + abs(float((d <= m).mean()) - 0.5), m, v)
                best = min(best or cost, cost)
            if best:
                _, self.limit[node], self.vantage[node] = best
                near = np.bitwise_count(points ^ self.vantage[node]) <= self.limit[node]
                parts[2 * node + 1], parts[2 * node + 2] = points[near], points[~near]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = points

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """shard, position in ``points``, whether at home; a point has one home and visits where the bound allows."""
        node, at, home = np.zeros(len(points), np.int64), np.arange(len(points)), np.ones(len(points), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int64)
            limit = self.limit[node]
            left, right = d <= limit + radius, d > limit - radius
            inside = d <= limit
            node = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
            home = np.concatenate((home[left] & inside[left], home[right] & ~inside[right]))
            at = np.concatenate((at[left], at[right]))
        return node - (2**self.depth - 1), at, home


class Groups:
    """Labels of linked positions, merged batch by batch; the label is the smallest position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            ra, rb = label[a], label[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := label[label], label):
                label = up
            self.label = label


def search(points: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels of ``points`` by links of a point at home to any point within ``radius``."""
    groups = Groups(len(points))
    rng = np.random.default_rng(5)
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        own, all_ = todo.pop()
        if not len(own) or not len(all_):
            continue
        if len(own) > 128 and len(own) * len(all_) > COMPARE_AT_ONCE // 4:
            vantage = points[own[rng.integers(len(own))]]
            d_own, d_all = np.bitwise_count(points[own] ^ vantage).astype(int), np.bitwise_count(points[all_] ^ vantage).astype(int)
            m = int(np.median(d_own))
            if d_own.max() == m:
                m -= 1
            near, far = own[d_own <= m], own[d_own > m]
            to_near, to_far = all_[d_all <= m + radius], all_[d_all > m - radius]
            if len(near) * len(to_near) + len(far) * len(to_far) < 0.9 * len(own) * len(all_):
                todo += [(near, to_near), (far, to_far)]
                continue
        rows = max(1, COMPARE_AT_ONCE // len(all_))
        for at in range(0, len(own), rows):
            part = own[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[all_][None, :]) <= radius)
            a, b = part[i], all_[j]
            groups.link(a[a != b], b[a != b])
    return groups.label


def _forest(shard: pd.DataFrame) -> pd.DataFrame:
    points = shard["fp"].to_numpy().view(np.uint64)
    label = search(points, shard["home"].to_numpy())
    linked = np.flatnonzero(label != np.arange(len(points)))
    return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[label[linked]].view(np.int64)})


def linked_points(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """node, root of the distinct fingerprints ``fp`` in ``points`` that have another within ``radius``, directly or by others."""
    spark = points.sparkSession
    count = points.count()
    # Small inputs use more and smaller shards, so that all partitions have one.
    shards = max(count / shard_points, min(partitions(spark), count / LEAST_SHARD_POINTS), 1)
    depth = int(np.ceil(np.log2(shards)))
    wanted = min(SAMPLE_A_SHARD * 2**depth, count // 4)
    sample = [r["fp"] for r in hash_sample(points.select("fp"), wanted, "fp").orderBy("fp").collect()] if depth else []
    tree = Tree(np.array(sample, np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            shard, at, home = tree.route(np.ascontiguousarray(fps).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fps[at]), pa.array(home)], names=["shard", "fp", "home"])

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp bigint, home boolean")
    links = dealt.groupBy("shard").applyInPandas(_forest, "a bigint, b bigint")
    return connected(materialize(links.distinct()))


def components(docs: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    ready(docs.sparkSession)
    rows = materialize(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = linked_points(nodes, radius, shard_points)
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("fp", "component_id")
    of_all = nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(of_all, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    Rows that repeat this id and fingerprint stay together.
    """
    dropped = components(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("near_id"), F.col("fp").alias("near_fp")).distinct()
    name = fresh(docs, "simhash_fp")
    marked = fingerprints(docs, name)
    return marked.join(dropped, marked["doc_id"].eqNullSafe(dropped["near_id"]) & (marked[name] == dropped["near_fp"]), "left_anti").drop(name)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
