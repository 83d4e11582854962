"""Connected components against union-find, and the rounds that they take."""

from __future__ import annotations

import random

import pytest

from ridegauge.llm import links


def roots(pairs: list[tuple[int, int]]) -> dict[int, int]:
    up = {n: n for p in pairs if p[0] != p[1] for n in p}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return {n: find(n) for n in up}


def graphs() -> dict[str, list[tuple[int, int]]]:
    rng = random.Random(9)
    return {
        "none": [],
        "loops": [(1, 1), (2, 2)],
        "stars": [(1, k) for k in range(2, 40)] + [(k, 50) for k in range(51, 80)] + [(1, 2), (2, 1), (3, 3)],
        "chain": [(k, k + 1) for k in rng.sample(range(60), 60)],
        "wheel": [(90, k) for k in range(80)] + [(k, k + 1) for k in range(0, 79, 2)],
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)],
        "high root": [(100 - k, 200 + k) for k in range(30)] + [(200 + k, 99 - k) for k in range(30)],
    }


@pytest.mark.parametrize("name", graphs())
def test_components_against_union_find(spark, name):
    pairs = graphs()[name]
    got = links.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == roots(pairs)


def test_stars_take_no_round_and_a_bridge_takes_one(spark, monkeypatch):
    written, materialize = [], links.materialize
    monkeypatch.setattr(links, "materialize", lambda df: written.append(1) or materialize(df))
    pairs = graphs()["stars"]
    links.connected(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert len(written) == 1
    links.connected(spark.createDataFrame([*pairs, (30, 70)], "a bigint, b bigint"))
    assert len(written) <= 4
