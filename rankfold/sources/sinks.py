"""Writers: Parquet (lz4), CSV statistic tables, JSON metric reports,
embedding tables, and the reference's "prefix on collision" output naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve_output_path(spark: SparkSession, dst_dir: str, file_name: str, prefix: str) -> str:
    """``dst_dir/file_name``; if taken, ``dst_dir/<prefix>_file_name``; if that
    is taken too, raise (never overwrite)."""
    first = f"{dst_dir.rstrip('/')}/{file_name}"
    if not _fs_exists(spark, first):
        return first
    second = f"{dst_dir.rstrip('/')}/{prefix}_{file_name}"
    if _fs_exists(spark, second):
        raise FileExistsError(second)
    return second


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None, compression: str = "lz4") -> None:
    """Parquet with lz4 (column statistics are written by default)."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small statistic tables as one headed CSV file.

    Only for tables whose size is bounded by the number of groups (event kinds,
    bins); ``coalesce(1)`` narrows the final stage without a shuffle.
    """
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric table (metric, k, value) as one JSON object ``{metric: {k: value}}``."""
    report = metrics.groupBy("metric").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), "value"))).alias("values"))
    one = report.agg(F.map_from_entries(F.collect_list(F.struct("metric", "values"))).alias("report"))
    one.select(F.to_json("report").alias("value")).coalesce(1).write.mode(mode).text(path)


def save_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(id, embedding) table to Parquet; ids must be unique (see validate)."""
    write_parquet(df.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>")), path, mode)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
