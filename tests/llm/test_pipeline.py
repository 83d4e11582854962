"""The pipeline on a small table against a plain version of each stage's effect, and the queries with SQL."""

from __future__ import annotations

from collections import defaultdict

import pytest
from compare import compare, oracle
from test_tokens import check_pieces, plain

import __spark_entry__
import corpus_pipeline
from ridegauge.llm import queries, quality, rules, textstats
from test_dedup import whole
from test_shingles import first_ids

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    ok, message = compare(spark, oracle(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_pipeline_against_brute_force(spark, tokenizer):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    first, second = quality.train(docs, labels), rules.train(docs, labels)
    left = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        counts, features = textstats.describe_all([(r["text"] or "").encode()])
        if first.probability(features)[0] < 0.3 or second.probability(features)[0] < 0.3:
            continue
        if counts[0, 0] < 50 or 2 * counts[0, 4] > counts[0, 0]:
            continue
        if whole(r["text"]) not in {whole(t) for t in left.values()}:
            left[r["doc_id"]] = r["text"]
    stay = first_ids(list(left.items()))
    t = plain(tokenizer)
    ids = defaultdict(list)
    for i in left:
        if i in stay:
            ids[i].append([*t.encode(left[i] or "", add_special_tokens=False).ids, 1])
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(ids) and len(ids) > 50
    check_pieces(rows, ids, 2048)


def test_stages_keep_the_columns_and_take_messy_rows(spark, messy, nothing):
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()
