"""Near-dedup by the Jaccard similarity of word shingles.

A text is the set of its five-word shingles (ASCII lower case, ASCII white space; a shorter text is one shingle). Two texts are linked if
their sets' exact Jaccard similarity is 0.8 or more; connected components of links are groups of near copies.

1. Texts with equal words are one node. A node has 128 min-hashes of its set in 32 bands of 4; nodes that share a band are a bucket. A pair
   with similarity s shares a band with probability 1 - (1 - s^4)^32: all but 5 in 10^8 at 0.8, more above.
2. Method 8 comes first: SimHash fingerprints of the sets are linked through the vantage-point tree of :mod:`ridegauge.llm.simhash`, each node meets
   the least node of its component, and exact similarity confirms or drops that pair. Its radius reaches the closest copies only (at 0.8 two
   fingerprints are some 10 bits apart), so the bands below settle what it leaves.
3. Crowded buckets (``CROWD`` nodes) are thinned: shingles that only one of the crowded nodes has bound what a node may have in common with another, and
   one that can't come to 0.8 leaves the bucket. The nodes that stay carry ``PARITY`` bits, whose differences are a lower bound of the sets' differing
   shingles. Both bounds are exact and drop no link.
4. Every pair of a bucket is settled: either both nodes are in one component already, or their texts are compared. Bands are taken in
   steps (``STEPS``): the first few unite most of a large group, so that in later bands its buckets hold one component, which a count
   without texts tells. Within a step, rounds go by pivots: ``PIVOTS`` nodes of each bucket meet the bucket's other components, links are
   merged, pivots leave the bucket. Pivots are the nodes of least hash, so the buckets of one group share them. A round takes four times
   the pivots of the last, and what is left when it is no more than twice a round's work is compared in one. Only nodes that share a band
   take part, with the bands that they share.
5. Set sizes whose ratio rules 0.8 out are never compared, nor are pairs of which fewer than ``LEAST_EQUAL`` of the 128 min-hashes agree in their
   lowest ``PLANES`` bits: at 0.8 that happens with probability 6e-8. Rows of a band carry these bits (48 bytes), so the join on the
   band itself drops such pairs, and loose groups (texts with a passage in common, say) make no rows. Only texts of the pairs left are
   compared. Texts of a popular pivot are replicated for every ``PAIRS_A_TASK`` of its pairs.

Null and empty texts are one node without shingles. A component's id is the smallest id in it; null ids count only if there is no other.
Further columns are not read by :func:`components`; :func:`keep_first` passes them through. An empty table has no components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ridegauge.llm.common import add_columns, discard, fresh, give_back, materialize, raw, ready
from ridegauge.llm.links import connected
from ridegauge.llm.simhash import linked_points, majority, signed

SHINGLE = 5
#: The least similarity of a link, as a fraction.
PART, WHOLE = 4, 5
BANDS, ROWS = 32, 4
SEED = 42
#: Buckets of so many nodes are thinned first.
CROWD = 64
#: Bits of a crowded node's parity.
PARITY = 1024
#: Bands of each step.
STEPS = ((0, 2), (2, 8), (8, BANDS))
PIVOTS = 1
PAIRS_A_TASK = 256
#: So few pairs are settled in one last round; larger corpora allow ``PAIRS_A_ROW`` for each pivot and row of the bands, twice what the
#: round would make at most.
LAST_PAIRS = 100_000
PAIRS_A_ROW = 2
#: Bits kept of each min-hash; unequal ones agree in all three once in eight.
PLANES = 3
#: 128 draws at 0.8 + 0.2 / 8 give 105.6 on average; 81 is 5.7 standard deviations below.
LEAST_EQUAL = 81
#: So many keys of some 40 bytes are broadcast at most; beyond that the join is left to a shuffle.
BROADCAST_KEYS = 500_000
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = np.random.default_rng(SEED + 1).integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def shingles(data: bytes) -> set[bytes]:
    words = data.lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def node_of(data: bytes) -> bytes:
    """16 bytes; equal for texts with equal words."""
    return hashlib.blake2b(b" ".join(data.lower().split()), digest_size=16).digest()


def digests(found: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def min_hashes(found: set[bytes]) -> np.ndarray:
    return _min_hashes(digests(found))


def _min_hashes(wide: np.ndarray) -> np.ndarray:
    hashes = wide.astype(np.uint32)  # the lower half
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    return least


def bands(found: set[bytes]) -> list[int]:
    """One signed integer a band; none for an empty set."""
    return _bands(min_hashes(found)) if found else []


def _bands(least: np.ndarray) -> list[int]:
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketch(least: np.ndarray) -> list[int]:
    """Bit planes of the min-hashes' lowest bits, 64 a signed integer: two integers a plane."""
    planes = [np.packbits((least >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in range(PLANES)]
    return np.concatenate(planes).view(np.int64).tolist()


def _signatures(texts: list[str | None]) -> tuple[list[bytes], list[int], list[int | None], list[list[int]], list[list[int]]]:
    nodes, sizes, points, keys, sketches = [], [], [], [], []
    for t in texts:
        data = raw(t)
        found = shingles(data)
        wide = digests(found)
        least = _min_hashes(wide) if found else None
        nodes.append(node_of(data))
        points.append(signed(majority(wide)) if found else None)
        sizes.append(len(found))
        keys.append([] if least is None else _bands(least))
        sketches.append([] if least is None else _sketch(least))
    return nodes, sizes, points, keys, sketches


def likely(a: str, b: str) -> Column:
    """Whether the sketches in columns ``a`` and ``b`` leave a similarity of 0.8 open."""
    each = BANDS * ROWS // 64
    unequal = F.lit(0)
    for at in range(each):
        planes = [F.col(a)[k * each + at].bitwiseXOR(F.col(b)[k * each + at]) for k in range(PLANES)]
        unequal = unequal + F.bit_count(reduce(Column.bitwiseOR, planes))
    return unequal <= BANDS * ROWS - LEAST_EQUAL


def _parity(wide: np.ndarray) -> list[int]:
    """``PARITY`` bits, 64 a signed integer; a bit tells whether an odd number of the hashes fall on it."""
    odd = np.bincount((wide >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def apart(a: str, b: str) -> Column:
    """Bits in which the parities in columns ``a`` and ``b`` differ; the sets differ by as many shingles at least."""
    return reduce(Column.__add__, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(PARITY // 64)])


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, a_texts, b_texts, *rest = batch.columns
        ids = b.to_pylist()
        kept, last, pivot = [], None, set()
        for i in sorted(range(len(ids)), key=ids.__getitem__):  # one pivot's shingles at a time
            if ids[i] != last:
                last, pivot = ids[i], shingles(raw(b_texts[i].as_py()))
            if similar(shingles(raw(a_texts[i].as_py())), pivot):
                kept.append(i)
        kept = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([c.take(kept) for c in (a, b, *rest)], names=["a", "b", *batch.schema.names[4:]])
    give_back()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b and further columns) whose texts (node, text) are similar."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("copies"))
    pivots = copies.join(texts, F.col("b") == F.col("node")).select("b", F.col("text").alias("b_text"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    rows = dealt.join(texts, F.col("a") == F.col("node")).select("a", "b", *rest, "copy", F.col("text").alias("a_text")).join(pivots, ["b", "copy"])
    return rows.select("a", "b", "a_text", "b_text", *rest).mapInArrow(_confirm, pairs.select("a", "b", *rest).schema)


def _active(nodes: DataFrame) -> DataFrame:
    """node, first_id, size, sketch and shared (a list of at, band) of the nodes that share a band with another."""
    bands = nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(bands.select("band"))
    held = nodes.select("node", F.posexplode("bands").alias("at", "band")).join(small(shared), "band", "left_semi")
    held = held.groupBy("node").agg(F.collect_list(F.struct("at", "band")).alias("shared"))  # at most BANDS
    return materialize(nodes.drop("bands", "fp").join(held, "node"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.columns
        for key, text in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
            found = digests(shingles(raw(text))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], names=["key", "hash"])
    give_back()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, texts = batch.columns
        made = [_parity(digests(shingles(raw(t)))) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([nodes, pa.array(made, pa.list_(pa.int64()))], names=["node", "parity"])
    give_back()


def _thinned(active: DataFrame, texts: DataFrame) -> DataFrame:
    """``active`` without the bands in crowded buckets where the node can't have a link, and with the parity of nodes that stay in one.

    Of a node's shingles, some are in no other node of any crowded bucket; the others are all that it may have in common with one. A
    similarity of 0.8 takes 4 / 9 of both sizes in common, and the other's size is no less than the least in the bucket and 0.8 of the own.
    """
    held = active.select("node", "size", F.explode("shared").alias("own")).select("node", "size", F.col("own.at").alias("at"), F.col("own.band").alias("band"))
    full = materialize(held.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWD).select("band"))
    if full.isEmpty():
        return active.withColumn("parity", F.lit(None).cast("array<bigint>"))
    crowd = materialize(held.join(small(full), "band", "left_semi").withColumn("key", F.xxhash64("node")))
    n = crowd.count()
    while n:
        members = crowd.select("node", "key").distinct()
        rows = texts.join(small(members), "node").select("key", "text").mapInArrow(_hashes, "key bigint, hash bigint")
        once = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).filter("n = 1")
        alone = materialize(once.groupBy("key").agg(F.count(F.lit(1)).alias("alone")))
        least = materialize(crowd.groupBy("band").agg(F.min("size").alias("least")))
        common = F.col("size") - F.coalesce("alone", F.lit(0))
        other = F.greatest(WHOLE * F.col("least"), PART * F.col("size"))
        may = WHOLE * (WHOLE + PART) * common >= PART * (WHOLE * F.col("size") + other)
        crowd = materialize(crowd.join(small(alone), "key", "left").join(small(least), "band").filter(may).select(*crowd.columns))
        before, n = n, crowd.count()
        if 10 * n > 9 * before:
            break
    left = held.join(small(full), "band", "left_anti").unionByName(crowd.drop("key"))
    left = left.groupBy("node").agg(F.collect_list(F.struct("at", "band")).alias("shared"))
    parities = texts.join(small(crowd.select("node").distinct()), "node").select("node", "text").mapInArrow(_parities, "node binary, parity array<bigint>")
    return materialize(active.drop("shared").join(left, "node").join(parities, "node", "left"))


def _close(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Pairs that method 8 proposes and those that their texts confirm; None without any.

    Fingerprints of the shingle sets are linked through the vantage-point tree; each node meets the least node of its component.
    """
    points = nodes.filter("fp IS NOT NULL").select("node", "fp")
    several = points.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.hex("node")).alias("least"))
    several = materialize(several)
    roots = materialize(linked_points(several))
    group = several.join(roots.withColumnRenamed("node", "point"), F.col("fp") == F.col("point"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("group"))
    heads = group.groupBy("group").agg(F.sum("n").alias("members"), F.min("least").alias("head")).filter("members > 1")
    headed = materialize(group.join(heads, "group").select("fp", F.unhex("head").alias("b")))
    pairs = materialize(points.join(small(headed), "fp").filter("node <> b").select(F.col("node").alias("a"), "b"))
    return None if pairs.isEmpty() else (pairs, materialize(confirmed(pairs, texts)))


def _texts(docs: DataFrame, active: DataFrame) -> DataFrame:
    """node, text of the ``active`` nodes."""
    wanted = small(active.select(F.col("node").alias("wanted"), "first_id"))
    named = add_columns(docs.select("doc_id", "text"), "node binary", lambda texts: ([node_of(raw(t)) for t in texts],))
    # Both keys, so that copies of one text are spread over the tasks; only rows that repeat an id are left to merge.
    found = named.join(wanted, (named["node"] == wanted["wanted"]) & named["doc_id"].eqNullSafe(wanted["first_id"]))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with each node's root, itself if it has no link."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    named = roots.select(F.col("node").alias("linked"), F.col("root").alias("of_linked"))
    return rows.join(named, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("of_linked", "node")).drop("linked", "of_linked")


def _lifted(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """``roots`` after those of their roots, and of nodes without links so far, that ``merged`` hangs on smaller ones."""
    up = small(merged.select(F.col("node").alias("old"), F.col("root").alias("to")))
    moved = roots.join(up, F.col("root") == F.col("old"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(merged).distinct()


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """node, root of all nodes that have a link; None if no node shares a band with another."""
    active = _active(nodes)
    if active.isEmpty():
        return None
    texts = materialize(_texts(docs, active))
    roots = seen = None
    close = _close(active.select("node").join(nodes.select("node", "fp"), "node"), texts)
    if close:
        seen, new = close
        roots = None if new.isEmpty() else materialize(connected(new))
    active = _thinned(active, texts)
    for first, last in STEPS:
        sets, pivots, old = None, PIVOTS, []
        while True:
            if sets is None:  # roots meet nodes, not bands
                own = F.explode(F.filter("shared", lambda s: (s["at"] >= first) & (s["at"] < last)))
                sets = _rooted(active, roots).select("node", "size", "sketch", "parity", "root", own.alias("own")).select("node", "size", "sketch", "parity", "root", F.col("own.band").alias("band"))
            else:
                sets = _rooted(sets.drop("root"), roots)
            each = sets.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
            state = each.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
            state = materialize(state.filter("parts > 1").select("band", "n", "within"))
            work, rows = state.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2), F.sum("n")).first()
            if work is None:
                break
            if work <= max(LAST_PAIRS, PAIRS_A_ROW * pivots * rows):
                pivots = 1 << 30
            chance = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(1 << 30)) / F.lit(1 << 30)
            chosen = (chance * F.col("n") < pivots) | (F.col("n") <= pivots)
            sets = materialize(sets.join(state.drop("within"), "band").withColumn("pivot", chosen).drop("n"))
            discard(state, *old)
            old = [sets]
            against = sets.filter("pivot").select("band", *[F.col(c).alias(f"b_{c}") for c in ("node", "size", "root", "sketch", "parity")])
            sizes = F.greatest("size", "b_size") * PART <= F.least("size", "b_size") * WHOLE
            differ = F.coalesce((WHOLE + PART) * apart("parity", "b_parity") <= (WHOLE - PART) * (F.col("size") + F.col("b_size")), F.lit(True))
            once = ~F.col("pivot") | (F.col("node") > F.col("b_node"))
            met = sets.withColumnRenamed("band", "at").join(
                against, (F.col("at") == F.col("band")) & (F.col("root") != F.col("b_root")) & once & sizes & likely("sketch", "b_sketch") & differ
            )
            pairs = met.select(F.col("node").alias("a"), F.col("b_node").alias("b"), "root", "b_root").distinct()
            if seen is not None:
                ends = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
                pairs = pairs.select("*", *ends).join(seen.select(*ends), ["low", "high"], "left_anti").drop("low", "high")
            pairs = materialize(pairs)
            seen = pairs.select("a", "b") if seen is None else seen.unionByName(pairs.select("a", "b"))
            if not pairs.isEmpty():
                new = materialize(confirmed(pairs, texts))
                if not new.isEmpty():
                    # Earlier links are known by their roots, so only roots are linked.
                    merged = materialize(connected(new.select(F.col("root").alias("a"), F.col("b_root").alias("b"))))
                    last_roots, roots = roots, merged if roots is None else materialize(_lifted(roots, merged))
                    discard(new, *([] if last_roots is None else [last_roots, merged]))
            if pivots == 1 << 30:
                break
            sets = sets.filter("NOT pivot").drop("pivot")
            pivots *= 4
    return roots


def components(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id for every row of ``docs``."""
    ready(docs.sparkSession)
    rows = materialize(add_columns(docs.select("doc_id", "text"), "node binary, size int, fp bigint, bands array<bigint>, sketch array<bigint>", _signatures).drop("text"))
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    ids = nodes.select("node", F.col("first_id").alias("component_id"))
    roots = _links(docs, nodes)
    if roots is not None:
        linked = roots.join(nodes, "node").select("node", "root", "first_id")
        smallest = linked.groupBy("root").agg(F.min("first_id").alias("of_root"))
        ids = ids.join(linked.join(smallest, "root").select("node", "of_root"), "node", "left").select("node", F.coalesce("of_root", "component_id").alias("component_id"))
    return rows.select("doc_id", "node").join(ids, "node").select("doc_id", "node", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    Rows that repeat this id and its words stay together.
    """
    found = components(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped = found.select(F.col("doc_id").alias("near_id"), F.col("node").alias("near_node")).distinct()
    dropped = small(materialize(dropped))
    name = fresh(docs, "shingle_node")
    marked = add_columns(docs, f"`{name}` binary", lambda texts: ([node_of(raw(t)) for t in texts],))
    return marked.join(dropped, marked["doc_id"].eqNullSafe(dropped["near_id"]) & (marked[name] == dropped["near_node"]), "left_anti").drop(name)
