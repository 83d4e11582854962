"""Writers and artifact reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ridegauge.sources.readers import read_table


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """CSV or Parquet folder by suffix; parts are written in parallel, never merged on the driver."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.lower().endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.lower().endswith(".csv.gz"):
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        writer.parquet(path)
    return path


def flatten_summary(df: DataFrame) -> DataFrame:
    """Nested values become JSON text so that a summary row stays flat."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_summary(df: DataFrame, path: str) -> str:
    """JSON lines keep nesting; any other suffix writes the flat form."""
    if path.lower().endswith(".json"):
        df.write.mode("overwrite").json(path)
        return path
    return write_table(flatten_summary(df), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stored_or_computed(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a stored table, else compute and store it, then read it back (which also cuts its lineage)."""
    if not path_exists(spark, path):
        write_table(compute(), path)
    return read_table(spark, path)
