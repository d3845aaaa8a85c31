"""Spark-side helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.session import checkpoint_dir, delete_at_exit


#: bytes of an Arrow batch on its way to a Python worker
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have batches for Python workers cut by bytes: texts differ a thousandfold in length,
    and both ends hold a batch or two.  A value that the session was given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Unlike a cached frame this survives lost executors, and unlike an RDD
    checkpoint it keeps column pruning and compression.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(n)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra or clashing ones cannot interfere."""
    return df.select(*[F.col(n) for n in names])


def input_gb(df: DataFrame, column: str) -> float:
    """Bytes of a text column over all rows, in GB (one aggregate)."""
    return (df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0) / 1e9


def ship(spark: SparkSession, model):
    """Broadcast a model of bounded size; classes of this package go by value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(broadcast):
    """The model of ``ship`` inside a task."""
    return pickle.loads(broadcast.value)


def returning_memory(run):
    """A function over Arrow batches that gives freed memory back as its task ends:
    workers stay for later stages, and would keep what their largest one took."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def rows_of(batch):
    """Rows of an Arrow batch as dicts, one at a time: rows that pack many entries
    would take several times the batch's memory together."""
    for r in range(batch.num_rows):
        yield batch.slice(r, 1).to_pylist()[0]
