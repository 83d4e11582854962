"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a bounded sample of labelled rows come to the driver (``sample`` rows of about 25 numbers), the trees are fitted
there in numpy, and their flat arrays travel with the scoring tasks. Scoring is row-local: no shuffle.

Null and empty texts have zero statistics and are scored like any text. Rows with null labels are not learned from. Repeated
rows and repeated ids are scored one by one. Without usable labels the score is the constant 0.5. Further columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ridegauge.llm import textstats, trees
from ridegauge.llm.common import add_columns, fresh, hash_sample, id_remainder, raw, ready, table

SAMPLE = 20_000
HELD_OUT_OF = 5
KEEP_FROM = 0.3


def _statistics(texts):
    return (list(textstats.describe_all([raw(t) for t in texts])[1]),)


def training_statistics(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled training rows, chosen by a hash of the id."""
    order = F.xxhash64("doc_id")
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(
        (id_remainder(F.col("doc_id"), HELD_OUT_OF) != 0) & F.col("quality").isNotNull()
    )
    chosen = hash_sample(usable, sample, "doc_id").orderBy(order, "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` small rows
    # The order of the top rows names no text, so that none comes to the driver.
    rows = (
        add_columns(texts, "stats array<double>", _statistics)
        .select(order.alias("first"), "doc_id", "quality", "tie", "stats")
        .orderBy("first", "doc_id", "quality", "tie")
        .select("quality", "stats")
        .limit(sample)
        .collect()
    )
    x = np.array([r["stats"] for r in rows], float).reshape(-1, len(textstats.FEATURES))
    return x, np.array([r["quality"] == 1 for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Forest:
    ready(docs.sparkSession)
    return trees.fit(*training_statistics(docs, labels, sample))


def score(docs: DataFrame, model: trees.Forest, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a further column."""
    ready(docs.sparkSession)
    spark_model = model

    def probabilities(texts):
        return (spark_model.probability(textstats.describe_all([raw(t) for t in texts])[1]),)

    return add_columns(docs, f"`{name}` double", probabilities)


def keep_good(docs: DataFrame, model: trees.Forest, at_least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``at_least``, with their own columns."""
    name = fresh(docs, "quality_score")
    return score(docs, model, name).filter(F.col(name) >= at_least).drop(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), HELD_OUT_OF) == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )
