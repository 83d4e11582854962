"""Quality rules: counted base rules, then gradient-boosted trees that are monotonic in the statistics that mark junk.

The score may only fall as symbols, repeated lines, repeated words, capitals or exclamation marks rise, so a text never gains
by more of them. Trees are fitted in numpy on a bounded sample of labelled rows (see ``quality``) and travel as flat arrays;
everything else is row-local.

Null and empty texts have no words and fail the base rules. Repeated rows are judged one by one. Without usable labels only
the base rules decide. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ridegauge.llm import textstats, trees
from ridegauge.llm.common import add_columns, fresh, raw, ready, table
from ridegauge.llm.quality import SAMPLE, training_statistics

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.3
#: Statistics with a direction: the score may only fall as they rise.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Forest:
    ready(docs.sparkSession)
    directions = {textstats.FEATURES.index(name): -1 for name in FALLING}
    return trees.fit(*training_statistics(docs, labels, sample), monotone=directions)


def judge(docs: DataFrame, model: trees.Forest, name: str = "judged") -> DataFrame:
    """``docs`` with a struct column: the exact counts, ``base_failed``, ``score`` and ``kept``."""
    ready(docs.sparkSession)
    forest = model

    def judged(texts):
        counts, features = textstats.describe_all([raw(t) for t in texts])
        scores = forest.probability(features)
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        out = []
        for c, f, s in zip(counts.tolist(), failed.tolist(), scores.tolist(), strict=True):
            out.append(dict(zip(textstats.COUNTS, c, strict=True)) | {"base_failed": f, "score": s, "kept": not f and s >= KEEP_FROM})
        return (out,)

    fields = ", ".join(f"{c}: bigint" for c in textstats.COUNTS)
    return add_columns(docs, f"`{name}` struct<{fields}, base_failed: boolean, score: double, kept: boolean>", judged)


def keep_passing(docs: DataFrame, model: trees.Forest) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the trees, with their own columns."""
    name = fresh(docs, "rule_result")
    return judge(docs, model, name).filter(F.col(name)["kept"]).drop(name)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "judged.*").select("doc_id", *textstats.COUNTS, "base_failed", "kept", "score")
