"""What the operators share: batch limits, shared tables, hold-out rules, text bytes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridegauge.session import ensure_checkpoint_dir, prepare

BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings that bound what one Arrow batch holds, however long the texts are, and what stays on disk.

    Shuffle files go when the query that made them ends; without that they stay until the driver collects garbage, which for a long row of
    written tables is their sum. A plan that is run once more makes them again.
    """
    prepare(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there: later steps survive lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0])
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(0))


def hash_sample(df: DataFrame, wanted: int, *keys: str) -> DataFrame:
    """About ``wanted`` rows of ``df`` (all of them if there are no more), chosen by a hash of ``keys``.

    A filter, so that no task and not the driver gets more than its share; a caller that needs a firm bound adds a limit.
    """
    n = df.count()
    space = 1 << 40
    return df if n <= wanted else df.filter(F.pmod(F.xxhash64(*keys), F.lit(space)) < int(space * min(1.0, 1.1 * wanted / n)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with further columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def give_back() -> None:
    """Return freed memory to the system. Spark reuses Python workers, and their allocators keep the pages of the largest tasks they ran."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def add_columns(df: DataFrame, fields: str, of_texts, text: str = "text") -> DataFrame:
    """Pass every row of ``df`` through and append columns that ``of_texts`` makes from its texts, batch by batch.

    ``fields`` is a schema string of the new columns; ``of_texts(list of str or None)`` returns one list or array for each. A column
    that has the name of a new one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    target = to_arrow_schema(new)
    df = df.drop(*[c for c in df.columns if c != text and c.lower() in {n.lower() for n in new.names}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = of_texts(texts_of(batch, text))
            yield with_columns(batch, {f.name: pa.array(v, f.type) for f, v in zip(target, made, strict=True)})
        batch = made = None
        give_back()

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
