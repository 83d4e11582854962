"""Registered queries that SQL cannot express, run as registered on the smallest documents table, against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from test_dedup import slow_fingerprint
from test_models import remainder, slow_counts, slow_model
from test_tokens import plain

from ridegauge.llm import packing
from ridegauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name: str, columns: list[str], texts: dict) -> dict:
    query = QUERIES[name](spark, SF)
    assert query.columns[: len(columns)] == columns
    rows = query.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    return {r["doc_id"]: r for r in rows}


def test_op1_labels_are_the_only_teacher(spark, texts):
    for i, r in rows_of(spark, "op1_quality_classifier", ["doc_id", "held_out", "score", "predicted"], texts).items():
        assert r["held_out"] == (remainder(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op5_counts_and_base_rules(spark, texts):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for i, r in rows_of(spark, "op5_quality_rules", columns, texts).items():
        counts = slow_counts(texts[i])
        assert tuple(r)[1:6] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])


def test_op6_held_out_and_values(spark, texts):
    languages = {r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang").distinct().collect()}
    for i, r in rows_of(spark, "op6_language_id", ["doc_id", "held_out", "lang_pred", "score"], texts).items():
        assert r["held_out"] == (remainder(i, 4) == 2) and r["lang_pred"] in languages | {"und"} and 0 <= r["score"] <= 1


def test_op7_ids_and_decoded_texts(spark, texts, tokenizer):
    t = plain(tokenizer)
    for i, r in rows_of(spark, "op7_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], texts).items():
        ids = t.encode(texts[i], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8_fingerprints_and_components(spark, texts):
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if least[j] < least[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    least[i], changed = least[j], True
    for i, r in rows_of(spark, "op8_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"], texts).items():
        assert r["fingerprint"] == f"{prints[i]:016x}" and r["component_id"] == least[i]
    assert len(set(least.values())) < len(texts)


def test_op9_base_and_model_scores(spark, texts):
    train = [t.encode() for i, t in texts.items() if remainder(i, 10) != 0]
    model, counts = slow_model(train), Counter()
    for t in train:
        counts.update([*t.lower().split(), "end"])
    below = sum(counts.values()) + 0.1 * (len(counts) + 1)
    rows = rows_of(spark, "op9_lm_scoring", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], texts)
    for i, r in rows.items():
        tokens = [*texts[i].encode().lower().split(), "end"]
        assert r["held_out"] == (remainder(i, 10) == 0) and r["n_tokens"] == len(tokens) and r["train_tokens"] == sum(counts.values())
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / below) for t in tokens), rel=1e-6)
    for i in sorted(texts)[:60]:
        assert rows[i]["score"] == pytest.approx(model(texts[i].encode()), rel=1e-4, abs=0.05)


def test_op10_pieces(spark, texts, tokenizer):
    import zlib

    import numpy as np

    t = plain(tokenizer)
    query = QUERIES["op10_packing"](spark, SF)
    assert query.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in query.collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = [*t.encode(texts[i], add_special_tokens=False).ids, packing.END_ID], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW


def test_op4_splits_as_its_sql_does(spark):
    """The registered SQL with a limit that splits this table and one that single documents exceed."""
    import duckdb

    from ridegauge.llm import sharding

    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    columns = ["doc_id", "bytes", "depth", "prefix", "page", "shard", "shard_bytes", "oversized"]
    for limit in (100_000, 15_000):
        sql = sharding.SQL.replace(str(sharding.SHARD_BYTES), str(limit))
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        got = [tuple(r) for r in sharding.assign(spark.read.parquet(path), limit).select(*columns).collect()]
        assert sorted(got) == sorted(want)
        assert len({r[5] for r in got}) >= 8 and len({r[2] for r in got}) > 1
    assert any(r[7] for r in got)
