"""URL filters: a sort-merge range join of urls with host and path rules.

The host's labels in reverse (``a.example.org`` -> ``org.example.a.``) make a rule's host and all its subdomains one interval of
the sorted keys, and below one host a path prefix is again an interval. Urls and rules are sorted together; a sweep keeps the stack
of host rules that enclose the current key and, inside a run of one host, the stack of path rules that enclose the current path.
The longest open rule wins.

Work is dealt by cut keys from a sample of the urls: a task gets one stretch of the key order, and a rule goes to the stretches that
its interval meets. Equal urls are told apart by a hash of the row in the key, so that a very common url spreads over stretches.
Sweeping is streaming: a task holds the open rules only.

Null urls and urls without ``://`` have empty host and path, meet no rule and get the default verdict. Repeated rows are judged one by
one. Among rules of equal length the block rule wins. Empty rules leave every url with the default.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridegauge.llm.common import add_columns, hash_sample, partitions, ready, table

DEFAULT_VERDICT = "allow"
#: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRETCHES_A_PARTITION = 4
SAMPLE_A_STRETCH = 16
KEY_BYTES = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _cut_keys(keyed: DataFrame, stretches: int) -> list[str]:
    """At most ``stretches - 1`` keys that deal the urls out evenly, from a sample of ``SAMPLE_A_STRETCH`` urls a stretch."""
    sample = hash_sample(keyed.select("sort_key", "tie"), stretches * SAMPLE_A_STRETCH, "tie").select("sort_key").collect()
    keys = sorted(r["sort_key"] for r in sample)
    return sorted({keys[len(keys) * i // stretches] for i in range(1, stretches)}) if keys else []


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url)."""
    spark = ready(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("host_key", reversed_host(F.col("host")))
    keyed = keyed.withColumn("tie", F.lower(F.hex(F.xxhash64("page_id", "host_key", "path"))))
    # A key longer than KEY_BYTES is only cut for dealing out; the sweep compares whole keys.
    keyed = keyed.withColumn("sort_key", F.concat(F.substring("host_key", 1, KEY_BYTES), F.lit("\0"), F.substring("path", 1, KEY_BYTES), F.lit("\0"), F.col("tie")))
    stretches = partitions(spark) * STRETCHES_A_PARTITION
    cuts = _cut_keys(keyed, stretches)
    place = lambda df, key, name: add_columns(df, f"{name} int", lambda keys: ([bisect.bisect_right(cuts, k) for k in keys],), key)
    urls = place(keyed, "sort_key", "stretch").select(
        "stretch", "host_key", "path", F.lit(1).alias("kind"), "page_id", "host",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    ruled = rules.select(F.translate("host", CAPITALS, SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host IS NOT NULL")
    ruled = ruled.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", reversed_host(F.col("host")))
    ruled = ruled.withColumn("low", F.substring("host_key", 1, KEY_BYTES)).withColumn("high", F.concat("low", F.lit("\U0010ffff")))
    starts = place(place(ruled, "low", "first"), "high", "last").select(
        F.explode(F.sequence("first", "last")).alias("stretch"), "host_key", "path", F.lit(0).alias("kind"),
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "host", F.concat("host", "path").alias("rule"), "verdict",
    )
    swept = urls.unionByName(starts).repartition(stretches, "stretch").sortWithinPartitions("stretch", "host_key", "kind", "path")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return swept.mapInArrow(_sweeper(default), f"page_id {id_type}, host string, path string, rule string, verdict string")


def _sweeper(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, host_key = None, None
        around: list[tuple[str, list]] = []  # host rules that enclose the current key, outermost first
        paths: list[tuple[str, str, str]] = []  # path rules of the current host, in order
        inside: list[tuple[str, str, str]] = []  # those that enclose the current path
        at = 0
        for batch in batches:
            names = batch.schema.names
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            picked, found, verdicts = [], [], []
            for i in range(batch.num_rows):
                if cols["stretch"][i] != stretch:
                    stretch, host_key, around = cols["stretch"][i], None, []
                key, path = cols["host_key"][i], cols["path"][i]
                if key != host_key:
                    while around and not key.startswith(around[-1][0]):
                        around.pop()
                    host_key, paths = key, []
                if cols["kind"][i] == 0:
                    if not around or around[-1][0] != key:
                        around.append((key, []))
                    around[-1][1].append((path, cols["rule"][i], cols["verdict"][i]))
                    continue
                if not paths and around:
                    paths, inside, at = sorted(r for _, own in around for r in own), [], 0
                while at < len(paths) and paths[at][0] <= path:
                    while inside and not paths[at][0].startswith(inside[-1][0]):
                        inside.pop()
                    inside.append(paths[at])
                    at += 1
                while inside and not path.startswith(inside[-1][0]):
                    inside.pop()
                best = max(inside, key=lambda r: (len(r[1]), r[2]), default=None) if paths else None
                picked.append(i)
                found.append(best and best[1])
                verdicts.append(best[2] if best else default)
            kept = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(names.index(n)) for n in ("page_id", "host", "path")), pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return sweep


def longest_rule(host: str, path: str, rules=RULES, default: str = DEFAULT_VERDICT) -> tuple[str | None, str]:
    """The same judgement by trying every rule, for tests."""
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return (max(fits)[2], max(fits)[1]) if fits else (None, default)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(ready(spark)))


SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
     split AS (SELECT page_id,
                      coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
     rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     urls AS (SELECT DISTINCT host, path FROM split),
     fits AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
              FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, split.host, split.path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits ON split.host = fits.host AND split.path = fits.path
"""
