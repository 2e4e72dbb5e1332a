"""Small helpers shared by the operators: columns, Arrow batches, held-out rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

__all__ = ["added", "cut_lineage", "emitted", "held_out", "read", "settle", "without"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of an Arrow batch. Texts average kilobytes, so Spark's default of 10,000 rows is tens of megabytes,
# several times over: in the JVM, on the way, and in each Python worker of a chain.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_DEFAULT = "10000"


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch, unless it was set to something else than the default."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _release() -> None:
    """Give freed memory back when a task ends: its worker waits for the next task and keeps what it holds."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def settle(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and broadcasts of frames that are no longer in use.

    It does so when the driver collects the objects that stand for them. A job of many small steps would
    fill the executors' disks before a driver with free memory gets there by itself.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that a result is about to replace, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept out of learning: crc32 of the id as text divisible by ``folds``; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def added(
    df: DataFrame,
    fields: Sequence[T.StructField],
    compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``df`` with columns computed from Arrow batches; columns of the same names are replaced.

    ``compute`` is called once per task and returns the function from a batch to its new columns.
    """
    df = without(df, [f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], names)
        del work
        _release()

    _small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def emitted(
    df: DataFrame,
    schema: str,
    compute: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """Rows made from the Arrow batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compute(batch for batch in batches if batch.num_rows)
        _release()

    _small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
