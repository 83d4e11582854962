"""Every written shard keeps the limit, also when one id has many rows."""

from __future__ import annotations

from collections import Counter

from ridegauge.llm import sharding


def test_written_shards_keep_the_limit(spark, tmp_path):
    rows = [(7, "x" * (10 + i % 5) + str(i)) for i in range(120)] + [(7, "same row")] * 30 + [(None, "n" * 40)] * 50 + [(100 + i, "y" * 30) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)
    sizes = Counter()
    for r in back:
        sizes[r["shard"]] += len(r["text"])
    assert max(sizes.values()) <= 500
