"""The pipeline's near-dedup stage on planted near copies against a Jaccard brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from conftest import sentence
from ridegauge.llm import shingles


def grams(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_ids(rows: list[tuple]) -> set:
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return set(least.values())


def planted() -> list[tuple]:
    rng = random.Random(8)
    rows = []
    for _ in range(30):  # copies with 1 to 12 changed words in 200, on both sides of 0.8
        words = sentence(rng, 200).split()
        for edits in (0, 1, 2, 4, 5, 8, 12):
            new = list(words)
            for at in rng.sample(range(200), edits):
                new[at] = f"edit{rng.random()}"
            rows.append(" ".join(new))
    hub = sentence(rng, 150).split()
    rows.append(" ".join(hub))
    for k in range(100):  # one large group whose members are often closer to the middle than to each other
        new = list(hub)
        for at in rng.sample(range(150), 2 + k % 4):
            new[at] = f"hub{k}"
        rows.append(" ".join(new))
    chain = sentence(rng, 100).split()
    for k in range(8):  # a chain: each one is near the next only
        chain[k * 12] = f"link{k}"
        rows.append(" ".join(chain))
    rows += [sentence(rng, rng.randint(1, 8)) for _ in range(40)] + ["", " \n", None, "one", "ONE", "one two three four five six"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("last_pairs", [0, shingles.LAST_PAIRS])
def test_planted_near_copies_against_jaccard(spark, monkeypatch, last_pairs):
    monkeypatch.setattr(shingles, "LAST_PAIRS", last_pairs)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()]
    want = first_ids(rows)
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert len(want) < len(rows) - 150


def test_bands_reach_similar_sets():
    rng = random.Random(1)
    for _ in range(60):
        words = sentence(rng, 204).split()
        near = list(words)
        for at in (3, 50, 97, 150):  # 20 of 200 shingles differ: 180 / 220 = 0.818
            near[at] = "other"
        a, b = (shingles.shingles(" ".join(w).encode()) for w in (words, near))
        assert not shingles.similar(a, b) or set(shingles.bands(a)) & set(shingles.bands(b))


def test_sketches_count_equal_low_bits(spark):
    rng = random.Random(2)
    rows, want = [], []
    for k in range(40):
        words = sentence(rng, 120).split()
        near = list(words)
        for at in rng.sample(range(120), k // 2):
            near[at] = f"other{k}"
        a, b = (shingles.min_hashes(shingles.shingles(" ".join(w).encode())) for w in (words, near))
        rows.append((k, shingles._sketch(a), shingles._sketch(b)))
        want.append(int((a % 8 == b % 8).sum()) >= shingles.LEAST_EQUAL)
    got = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>").select("k", shingles.likely("a", "b").alias("ok")).orderBy("k").collect()
    assert [r["ok"] for r in got] == want and 0 < sum(want) < 40


def crowd() -> list[tuple]:
    """Near copies of one text of which most are too far from each other for a link, among close ones."""
    rng = random.Random(5)
    base = sentence(rng, 150).split()
    rows = []
    for k in range(160):
        new = list(base)
        for at in rng.sample(range(150), (1, 2, 7, 8, 9, 10, 12, 14)[k % 8]):
            new[at] = f"own{k}x{at}"
        rows.append((k, " ".join(new)))
    return rows


def test_a_crowd_is_not_compared_pair_by_pair(spark, monkeypatch):
    compared, confirmed = [], shingles.confirmed
    monkeypatch.setattr(shingles, "confirmed", lambda pairs, texts: compared.append(pairs.count()) or confirmed(pairs, texts))
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == first_ids(rows) and len(kept) > 60
    assert sum(compared) < 12 * len(rows), compared


def test_method_8_proposes_the_closest_copies(spark, monkeypatch):
    found, close = [], shingles._close
    monkeypatch.setattr(shingles, "_close", lambda nodes, texts: found.append(close(nodes, texts)) or found[-1])
    rng = random.Random(6)
    texts = [sentence(rng, 400) for _ in range(5)]
    rows = list(enumerate([t + end for t in texts for end in ("", " more")] + ["alone", ""]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {0, 2, 4, 6, 8, 10, 11}
    ((pairs, confirmed),) = found
    assert pairs.count() == confirmed.count() == 5


def test_parities_differ_in_no_more_bits_than_sets(spark):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        words = sentence(rng, 60 + 40 * k).split()
        near = list(words)
        for at in rng.sample(range(len(words)), k):
            near[at] = f"other{k}"
        a, b = (shingles.shingles(" ".join(w).encode()) for w in (words, near))
        rows.append((len(a ^ b), shingles._parity(shingles.digests(a)), shingles._parity(shingles.digests(b))))
    got = spark.createDataFrame(rows, "n int, a array<bigint>, b array<bigint>").select("n", shingles.apart("a", "b").alias("bits")).collect()
    assert all(r["bits"] <= r["n"] and r["bits"] >= 0.6 * r["n"] for r in got if r["n"] < 400)


def test_roots_are_lifted_to_those_that_their_roots_hang_on(spark):
    make = lambda rows: spark.createDataFrame(rows, "node string, root string")
    roots = make([("b", "b"), ("c", "b"), ("d", "d"), ("e", "d"), ("y", "y"), ("z", "y")])
    merged = make([("d", "a"), ("b", "a"), ("a", "a")])  # a and two roots; y stays
    want = {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "y": "y", "z": "y"}
    got = shingles._lifted(roots, merged).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
