"""Ordered row numbering and contiguous shards for batch consumers.

The reference reads a log in consecutive slices and gives each loader worker
a contiguous range ``[w * per, min((w + 1) * per, n))`` with
``per = ceil(n / workers)``.  Here every row gets its global position under a
total order -- without a single-partition window -- and a shard id; shards
are written with ``partitionBy("shard")`` so each consumer reads only its own
folder, in row order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.operators.indexing import staged
from rankfold.session import checkpoint_dir, default_parallelism, delete_at_exit


def row_index(df: DataFrame, order_cols: list[str], start: int = 0, out_col: str = "row_idx",
              num_partitions: int | None = None) -> DataFrame:
    """``df`` plus the 0-based (``start``-based) position of each row under
    ``order_cols`` (which must be a total order for a deterministic result).

    Range partitioning on the whole key spreads even a hot leading key over
    partitions.
    """
    n = num_partitions or default_parallelism(df.sparkSession)
    return numbered(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols), out_col, start)


def _placed(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered rows with partition and place, written once as Parquet (range
    bounds are sampled per execution, so every reader must see the same rows),
    and the rows of each partition."""
    d = staged(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "rows")
    return d, d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))


def numbered(ordered: DataFrame, out_col: str = "row_idx", start: int = 0) -> DataFrame:
    """``ordered`` (a globally sorted frame) plus each row's position; offsets
    come from one count per partition, not from a global window."""
    return _with_position(*_placed(ordered), out_col, start)


def _with_position(d: DataFrame, counts: DataFrame, out_col: str, start: int) -> DataFrame:
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_p", (F.sum("_c").over(w) - F.col("_c")).alias("_off"))
    pos = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    # one row per partition
    return (d.join(F.broadcast(offsets), "_p")
            .withColumn(out_col, (F.col("_off") + pos + F.lit(start)).cast("long"))
            .drop("_p", "_m", "_off"))


def shard_rows(df: DataFrame, order_cols: list[str], num_shards: int) -> DataFrame:
    """``df`` + row_idx + shard: contiguous shards of ``ceil(n / num_shards)`` rows."""
    n_parts = default_parallelism(df.sparkSession)
    d, counts = _placed(df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols))
    n = counts.agg(F.sum("_c").alias("n")).first()["n"] or 0  # the source is not counted again
    per = max(1, -(-n // num_shards))
    return _with_position(d, counts, "row_idx", 0).withColumn("shard", F.floor(F.col("row_idx") / F.lit(per)).cast("int"))


def write_shards(df: DataFrame, order_cols: list[str], num_shards: int, path: str, mode: str = "errorifexists") -> None:
    """Write shards as ``path/shard=<w>/`` folders, rows sorted inside each."""
    sharded = shard_rows(df, order_cols, num_shards)
    # ranges of row numbers, so a shard is written by several tasks, in order
    n = default_parallelism(df.sparkSession)
    (sharded.repartitionByRange(n, "row_idx").sortWithinPartitions("row_idx")
     .write.mode(mode).partitionBy("shard").parquet(path))


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One worker's shard (partition pruning reads only its folder), in row order."""
    return spark.read.parquet(path).filter(F.col("shard") == shard).orderBy("row_idx")


def _deal_slices(rows: DataFrame, position: Column, batch_rows: int, path: str) -> None:
    """Rows into folders ``path/slice=<number>/`` by their position; one pass."""
    (rows.withColumn("slice", F.floor(position / F.lit(batch_rows)).cast("long"))
     .write.partitionBy("slice").parquet(path))


def write_slices(df: DataFrame, order_cols: list[str], batch_rows: int, path: str) -> DataFrame:
    """Consecutive slices of ``batch_rows`` rows under a total order, as folders
    ``path/slice=<number>/`` (S9); returns them read back, with ``row_idx`` and ``slice``.

    The source is computed once and its rows are dealt to all slices in one pass;
    a reader of one slice (``read_slice``) opens that folder only.
    """
    numbered = row_index(staged(df, "slice-source"), order_cols)
    _deal_slices(numbered, F.col("row_idx"), batch_rows, path)
    return df.sparkSession.read.parquet(path)


def read_slice(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One slice, in row order, by partition pruning."""
    return spark.read.parquet(path).filter(F.col("slice") == number).drop("slice").orderBy("row_idx")


def iter_slices(df: DataFrame, order_col: str, batch_rows: int) -> Iterator[DataFrame]:
    """Consecutive slices of a numbered frame: rows with ``order_col`` in
    [offset, offset + batch_rows), from the smallest number on (S9/O7).

    The frame is computed once, its rows are dealt to their slices once, and each
    slice that is asked for reads its own folder.
    """
    spark, columns = df.sparkSession, df.columns
    rows = staged(df, "slice-source")
    # from the written table's column of numbers
    bounds = rows.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    if bounds["lo"] is None:
        return
    lo, hi = int(bounds["lo"]), int(bounds["hi"])
    path = f"{checkpoint_dir(spark).rstrip('/')}/slices-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    # private names: the frame may have a column called slice
    private = rows.toDF(*[f"_c{i}" for i in range(len(columns))])
    _deal_slices(private, F.col(f"_c{columns.index(order_col)}") - F.lit(lo), batch_rows, path)
    for number in range((hi - lo) // batch_rows + 1):
        part = spark.read.schema(f"{_fields(private)}, slice bigint").parquet(path).filter(F.col("slice") == number)
        yield part.drop("slice").toDF(*columns)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def iter_rows(df: DataFrame, order_col: str, batch_rows: int) -> Iterator[Row]:
    """Rows of a numbered frame in order, one slice at a time (S9): the driver holds
    parts of one slice at most, and the frame is computed once for all of them."""
    for part in iter_slices(df, order_col, batch_rows):
        yield from part.orderBy(order_col).toLocalIterator()
