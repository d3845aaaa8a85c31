"""Dense id dictionaries and id replacement.

``dense_index`` numbers distinct values in sorted order without a global
single-partition window: values are range-partitioned, sorted inside each
partition, counted per partition (a frame with one row per partition), and
each row's index is its partition offset plus its position in the partition.
The numbered frame is checkpointed once so every branch reads the same
partition contents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import checkpoint_dir, default_parallelism, delete_at_exit


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the shared checkpoint folder (eager).

    Used for intermediate tables that several branches of one plan consume:
    each branch then reads the written table instead of recomputing it from
    the event log, and the lineage is cut, so a lost executor costs a re-read
    rather than a recomputation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Like ``materialise``, but columnar: later steps prune columns and see
    statistics, and joins against it are plain shuffle joins whose skewed
    partitions AQE can split.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete the files of a ``staged`` frame that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise_once(d: DataFrame) -> DataFrame:
    """Materialise a range-partitioned, position-numbered frame exactly once.

    Its partition ids and positions come from the range partitioner, whose
    bounds are sampled per execution; every consumer (the per-partition counts,
    the rows themselves, later joins) must therefore read ONE materialisation.
    Exchange reuse gives that only when the optimizer happens to unify the
    branches, so the frame is checkpointed to the shared checkpoint folder
    (``spark.checkpoint.dir``) instead -- reliable, and it survives executor
    loss.
    """
    checkpoint_dir(d.sparkSession)
    return d.checkpoint(eager=True)


def dense_index(df: DataFrame, col: str, start: int = 0, out_col: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """(col, idx): distinct values of ``col`` numbered start, start+1, ... in
    ascending order (W2 with start=0, W3 with start=1)."""
    out_col = out_col or f"{col}_idx"
    n = num_partitions or default_parallelism(df.sparkSession)
    d = (df.select(col).distinct().repartitionByRange(n, col).sortWithinPartitions(col)
         .select(col, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    d = materialise_once(d)
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # running sum over one row per partition (the frame has <= n rows)
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_p", (F.sum("_c").over(w) - F.col("_c")).alias("_off"))
    pos = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return (d.join(F.broadcast(offsets), "_p")
            .select(col, (F.col("_off") + pos + F.lit(start)).cast("long").alias(out_col)))



def map_ids(df: DataFrame, col: str, dictionary: DataFrame, idx_col: str, *, strict: bool = True,
            default_unknown: bool = False, out_col: str | None = None) -> DataFrame:
    """Replace ``col`` by its dictionary index.

    strict: every value must be mapped; an unmapped value fails the job with
    ``raise_error`` (evaluated lazily, no extra pass).
    default_unknown: unmapped values get ``len(dictionary)`` (a spare index).
    """
    out_col = out_col or col
    key = dictionary.columns[0]
    j = df.join(dictionary.withColumnRenamed(key, col), col, "left")
    idx = F.col(idx_col)
    if default_unknown:
        size = dictionary.agg(F.count(F.lit(1))).scalar()
        idx = F.coalesce(idx, size)
    elif strict:
        idx = F.when(idx.isNull(), F.raise_error(F.concat(F.lit(f"unmapped {col}: "), F.col(col).cast("string"))))\
               .otherwise(idx)
    if out_col == col:
        cols = [idx.cast("long").alias(col) if c == col else F.col(c) for c in df.columns]
    else:
        cols = [F.col(c) for c in df.columns] + [idx.cast("long").alias(out_col)]
    return j.select(*cols)


def map_ids_in_lists(seq: DataFrame, list_col: str, dictionary: DataFrame, idx_col: str, *,
                     max_rows_per_key: int | None = None) -> DataFrame:
    """Strict replacement inside list elements, order kept.

    posexplode -> equi join with the dictionary, an item that many lists hold spread
    over sub-keys -> regroup by row in position order.  Histories cut into bounded
    rows (``chunk``) are regrouped chunk by chunk, so neither a hot item nor a hot
    user ends in one task.  Scales with the number of list elements; no literal map.
    """
    from rankfold.operators.skew import DEFAULT_MAX_ROWS_PER_KEY, salted_join

    key = dictionary.columns[0]
    keys = ["uid", "chunk"] if "chunk" in seq.columns else ["uid"]
    others = [c for c in seq.columns if c not in (*keys, list_col)]
    ex = seq.select(*keys, F.posexplode(list_col).alias("_pos", "_v"))
    j = salted_join(ex, dictionary.withColumnRenamed(key, "_v"), "_v", "left", max_rows_per_key=max_rows_per_key or DEFAULT_MAX_ROWS_PER_KEY)
    idx = F.when(F.col(idx_col).isNull(), F.raise_error(F.lit(f"unmapped element of {list_col}")))\
           .otherwise(F.col(idx_col)).cast("long")
    folded = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), idx.alias("_i")))).alias("_l"))
    folded = folded.select(*keys, F.transform("_l", lambda e: e["_i"]).alias(list_col))
    if not others:
        return folded
    # rows whose list was empty keep an empty list
    base = seq.select(*keys, *others, F.size(list_col).alias("_n"))
    out = base.join(folded, keys, "left")
    return out.select(*keys, F.when(F.col("_n") == 0, F.array().cast("array<long>"))
                      .otherwise(F.col(list_col)).alias(list_col), *others)
