"""Memory that Python workers keep from one task to the next."""

from __future__ import annotations

import os
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from ridegauge.llm import packing
from ridegauge.llm.common import add_columns

ROLLUP = Path("/proc/self/smaps_rollup")
pytestmark = pytest.mark.skipif(not ROLLUP.exists(), reason="needs Linux")


def held_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", ROLLUP.read_text()))) / 1024


def task_of(make, docs, monkeypatch):
    """The function that ``make(docs)`` hands to the workers."""
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run))
    make(docs)
    monkeypatch.undo()
    return found[0]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_a_task_gives_its_memory_back(spark, monkeypatch):
    pins = []

    def lengths(texts):
        blocks = [bytes(1000) for _ in range(200_000)]
        pins.append(bytes(1000))  # stays behind all blocks: without a trim the allocator keeps their 200 MB
        return ([len(blocks)] * len(texts),)

    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    run = task_of(lambda d: add_columns(d, "n bigint", lengths), docs, monkeypatch)
    before = held_mb()
    assert [b.column("n").to_pylist() for b in run(iter([batch(["a"])]))] == [[200_000]]
    assert held_mb() - before < 50


def test_packing_tasks_do_not_add_up(spark, monkeypatch, tokenizer):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    run = task_of(lambda d: packing.pack(d, tokenizer), docs, monkeypatch)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(at, at + 100)) for at in range(0, 300_000, 100)]
    before = held_mb()
    pieces = sum(b.column("length").to_numpy().sum() for b in run(iter([batch(texts)])))
    assert pieces > 300_000 and held_mb() - before < 60
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false" and "tokenizers" in sys.modules
