"""Shuffle files that stages leave behind."""

from __future__ import annotations

import random
import time
from pathlib import Path

import corpus_pipeline
from conftest import sentence
from ridegauge.llm import links
from ridegauge.llm.common import materialize, ready


def shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for f in folders for p in Path(str(f)).glob("*/shuffle_*")}


def left_behind(spark, before: set[str]) -> set[str]:
    """New files; they are removed beside the next query, so there is a wait."""
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return left


def test_a_written_table_leaves_no_shuffle_files(spark):
    ready(spark)
    before = shuffle_files(spark)
    table = materialize(spark.range(5000).repartition(7, "id"))
    assert table.count() == 5000 and not left_behind(spark, before)


def test_near_dedup_leaves_no_shuffle_files(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 300) for _ in range(20)]
    rows = list(enumerate([t + end for t in texts for end in ("", " more")]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = shuffle_files(spark)
    kept = {r["doc_id"] for r in materialize(corpus_pipeline.near_dedup(spark, docs, "")).collect()}
    assert kept == set(range(0, 40, 2)) and not left_behind(spark, before)


def test_a_plan_run_twice_gives_the_same_rows(spark):
    ready(spark)
    counted = spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()
    before = shuffle_files(spark)
    first = sorted(map(tuple, counted.collect()))
    assert not left_behind(spark, before)
    assert first == sorted(map(tuple, counted.collect())) == [(k, 100) for k in range(10)]


def test_rounds_leave_no_tables_but_the_last(spark, monkeypatch):
    ready(spark)
    written = []
    monkeypatch.setattr(links, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    assert {r["root"] for r in links.connected(chain).collect()} == {0}
    there = [Path("/" + t.inputFiles()[0].removeprefix("file:").lstrip("/")).exists() for t in written]
    assert len(there) > 2 and there == [False] * (len(there) - 1) + [True]
