"""Exact copies, near copies, shards and url rules: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridegauge.llm import dedup, exchange, links, sharding, simhash, urls


def whole(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("bits", [8, 32, 48])
def test_rice_code_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 200):
        values = np.unique(rng.integers(0, 1 << bits, n, np.uint64))
        assert exchange.rice_decode(exchange.rice_encode(values, bits), len(values)).tolist() == values.tolist()
    ends = np.array([0, (1 << bits) - 1], np.uint64)
    assert exchange.rice_decode(exchange.rice_encode(ends, bits), 2).tolist() == ends.tolist()
    dense = np.unique(rng.integers(0, 1 << 40, 20_000, np.uint64))
    assert len(exchange.rice_encode(dense, 40)) * 8 < len(dense) * 30


def test_packed_words_and_numbers_round_trip():
    words = [b"", b"a", "é中".encode(), b"x" * 1000]
    assert exchange.unpack_words(exchange.pack_words(words[1:])) == words[1:] and exchange.unpack_words(exchange.pack_words([])) == []
    for kind in (np.int64, np.uint32, np.float32):
        a = np.arange(1000).astype(kind)
        assert (exchange.unpack_numbers(exchange.pack_numbers(a), kind) == a).all()
        assert len(exchange.unpack_numbers(exchange.pack_numbers(a[:0]), kind)) == 0


@pytest.mark.parametrize(("block_rows", "broadcast_groups"), [(dedup.BLOCK_ROWS, dedup.BROADCAST_GROUPS), (7, 0)])
def test_exact_copies(messy, monkeypatch, block_rows, broadcast_groups):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(dedup, "BROADCAST_GROUPS", broadcast_groups)
    rows = messy.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[whole(r["text"])].append(r["doc_id"])
    want = Counter()
    for text, ids in groups.items():
        for i in ids:
            want[i, smallest(ids), len(ids), i == smallest(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in dedup.find_copies(messy).collect())
    assert got == want
    kept = dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    left = kept.select("doc_id", "text").collect()
    assert sorted(whole(r["text"]) for r in left) == sorted(groups)
    assert all(r["doc_id"] == smallest(groups[whole(r["text"])]) for r in left)


def test_no_documents(nothing):
    assert dedup.find_copies(nothing).count() == 0 and dedup.drop_copies(nothing).count() == 0
    assert simhash.components(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0
    assert sharding.assign(nothing).count() == 0


def test_a_group_of_copies_with_most_rows(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    assert dedup.find_copies(docs).filter("kept").count() == 1667 + 1
    found = simhash.components(docs)
    assert found.filter("doc_id % 3 > 0").select("component_id").distinct().count() == 1


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_near_copies(messy):
    rows = messy.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[root(i)] = root(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[root(i)].append(r["doc_id"])
    want = Counter((r["doc_id"], prints[i], smallest(members[root(i)])) for i, r in enumerate(rows))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(messy).collect()) == want
    kept = simhash.keep_first(messy)
    assert kept.columns == messy.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {smallest(m) for m in members.values()}


def planted(rng, n: int) -> np.ndarray:
    points = rng.integers(0, 1 << 63, n, np.uint64)
    half = n // 2
    for _ in range(2):
        points[half:] = points[:half] ^ (np.uint64(1) << rng.integers(0, 64, half, np.uint64))
        points[: half // 4] = points[half : half + half // 4] ^ (np.uint64(1) << rng.integers(0, 64, half // 4, np.uint64))
    return np.unique(points)


def test_tree_shards_find_every_pair():
    points = planted(np.random.default_rng(1), 4_000)
    every = simhash.Groups(len(points))
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points[i] ^ points) <= 2)
        every.link(np.full(len(near), i), near)
    assert len(np.unique(every.label)) < len(points)
    assert (simhash.search(points, np.ones(len(points), bool)) == every.label).all()
    tree = simhash.Tree(points[::7], 4)
    shard, at, home = tree.route(points, 2)
    assert sorted(at[home].tolist()) == list(range(len(points)))
    merged = simhash.Groups(len(points))
    for s in range(16):
        mine = at[shard == s]
        merged.link(mine, mine[simhash.search(points[mine], home[shard == s])])
    assert (merged.label == every.label).all()


def test_shards_on_spark_find_every_pair(spark):
    """With small shards the tree is deep, and links cross its boundaries."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(w), F.pmod(F.xxhash64(F.col("id") % 900, F.lit(w)), F.lit(50))) for w in "abcdefghijklm"], F.when(F.col("id") % 7 == 0, F.lit("more"))).alias("text"))
    deep = {tuple(r) for r in simhash.components(docs, shard_points=40).collect()}
    assert deep == {tuple(r) for r in simhash.components(docs).collect()}
    assert len({r[2] for r in deep}) < 3_000


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1_000, 1_000 + i) for i in range(1, 300)]
    found = {r["node"]: r["root"] for r in links.connected(spark.createDataFrame(chain + hub + [(7, 7), (5, 4)], "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{1_000 + i: 1_000 for i in range(300)}}


@pytest.mark.parametrize("limit", [200, 3_000, 10**9])
def test_shards_are_the_shortest_prefixes_that_fit(messy, limit):
    rows = sharding.assign(messy, limit).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in messy.select("doc_id").collect())
    bits = {i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i in {r["doc_id"] for r in rows}}
    sums, shards = Counter(), Counter()
    for r in rows:
        shards[r["shard"]] += r["bytes"]
        for d in range(61):
            sums[d, bits[r["doc_id"]] >> (60 - d)] += r["bytes"]
    for r in rows:
        depth = next((d for d in range(61) if sums[d, bits[r["doc_id"]] >> (60 - d)] <= limit), 60)
        assert (r["depth"], r["prefix"]) == (depth, bits[r["doc_id"]] >> (60 - depth))
        assert r["shard_bytes"] == shards[r["shard"]] and r["oversized"] == (shards[r["shard"]] > limit)
        assert not r["oversized"] or r["bytes"] > limit


def test_rows_of_one_id_overflow_to_pages(spark):
    docs = spark.createDataFrame([(1, "x" * 10)] * 50 + [(2, "y" * 10)], "doc_id bigint, text string")
    rows = sharding.assign(docs, 100).collect()
    pages = Counter(r["page"] for r in rows if r["doc_id"] == 1)
    assert pages == {p: 10 for p in range(5)} and not any(r["oversized"] for r in rows)


def test_written_shards(messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "out"), 50_000)
    back = messy.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == messy.count()


def test_url_rules_on_spark(spark):
    rng = random.Random(2)
    hosts = ["example.org", "a.example.org", "Ex.com", "x.Ex.com", "org", "xorg", "com", "", "a..b.org", "example.org:80", "exampleXorg"]
    paths = ["/", "/en/1", "/en/12", "/es/", "/es", "", "/de/x?y=/fr/", "/fr/#a", "?q", "/ü/中"]
    links_ = [(i, rng.choice(["http://", "ftp://", "", "x:/"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(2_000)]
    links_ += [(3_000 + i, "https://m.example.org/en/1") for i in range(1_500)] + [(9_000, None), (9_001, ""), (9_002, "a://b://c/d"), (None, "http://x.org/"), (9_003, "http://x.org/" + "p" * 50_000)] * 2
    pages = spark.createDataFrame([(i, u, "clash") for i, u in links_], "page_id bigint, url string, rule string")
    rules = [*urls.RULES, ("a.example.org", "/en/", "allow"), ("example.org", "/", "block"), ("Ex.com", "", "block")]

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    small = [(h.lower(), p, v) for h, p, v in rules]
    want = Counter((i, *parts(u), *urls.longest_rule(*parts(u), small)) for i, u in links_)
    got = Counter(tuple(r) for r in urls.apply_rules(pages, urls.rule_table(spark, rules)).collect())
    assert got == want
    assert urls.apply_rules(pages.limit(0), urls.rule_table(spark)).count() == 0
    none = urls.apply_rules(pages, urls.rule_table(spark).limit(0))
    assert none.filter("rule IS NOT NULL OR verdict <> 'allow'").count() == 0 and none.count() == len(links_)
