"""Skew handling for equi joins with very hot keys.

A key holding a large share of the rows (one user with a third of all
events, one item everybody played) would put all of its join work into one
task.  ``salted_join`` splits every *hot* key of the left side into sub-keys
by a hash of the row, and replicates the right side's rows of that key once
per sub-key.  Cold keys keep a single salt (0) and are joined as usual.

A key is hot by rows (``hot_keys``/``hot_from_counts``: more than
``max_rows_per_key`` left rows, ``ceil(rows / max)`` sub-keys) or by work
(``hot_from_work``: e.g. n * n produced pairs in a self-join, ``ceil(work /
max)`` sub-keys).  Either table has at most total / threshold rows, which
grows with the data, so it carries no broadcast hint: AQE broadcasts it when
it is small at run time and shuffles it otherwise.

``spread``/``spread_rows`` repartition the input of row-multiplying steps to
the configured shuffle partitions, which AQE does not coalesce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS_PER_KEY = 2_000_000
# for joins whose output per key is left rows x right rows (self-joins): the
# largest number of produced pairs one task may handle
DEFAULT_MAX_PAIRS_PER_TASK = 200_000_000


def hot_keys(df: DataFrame, key: str | list[str], max_rows_per_key: int) -> DataFrame:
    """(key.., _salts) for keys with more than ``max_rows_per_key`` rows."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > max_rows_per_key).select(
        *keys, F.ceil(F.col("_n") / F.lit(max_rows_per_key)).cast("int").alias("_salts"))


def hot_from_counts(counts: DataFrame, key: str | list[str], count_col: str, max_rows_per_key: int,
                    factor: int = 1) -> DataFrame:
    """Hot-key table from an aggregate the caller already has
    (``count_col`` = rows per key on the left side, times ``factor``)."""
    keys = [key] if isinstance(key, str) else list(key)
    n = F.col(count_col) * F.lit(factor)
    return counts.filter(n > max_rows_per_key).select(
        *keys, F.ceil(n / F.lit(max_rows_per_key)).cast("int").alias("_salts"))


def spread(df: DataFrame, *cols: str, partitions: int | None = None) -> DataFrame:
    """Hash-repartition ``df`` on ``cols`` into the configured number of
    shuffle partitions before a step that multiplies rows (an expanding join,
    an ``explode``, a grouped pandas function).

    AQE sizes shuffle partitions by their *input* bytes, so a small input to
    a row-multiplying step would otherwise be coalesced into a few tasks that
    do all of the multiplied work; an explicit partition count is kept as is.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *cols) if cols else df.repartition(n)


def spread_rows(df: DataFrame, *cols: str, partitions: int | None = None) -> DataFrame:
    """``spread`` for the input of a generator (``explode``): partitions by a
    hash *expression* of ``cols``.  Partitioning on the bare key would be
    dropped as redundant after an aggregate on the same key, whose shuffle AQE
    may then coalesce into a single task."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, F.xxhash64(*cols))


def hot_from_work(counts: DataFrame, key: str | list[str], work, max_work: int) -> DataFrame:
    """Hot-key table from a per-key *work* estimate (a Column over ``counts``),
    e.g. n_u * n_u produced pairs for a self-join on the user: keys whose work
    exceeds ``max_work`` get ``ceil(work / max_work)`` sub-keys.  The table has
    at most total_work / max_work rows."""
    keys = [key] if isinstance(key, str) else list(key)
    w = work.cast("double")
    return counts.filter(w > float(max_work)).select(
        *keys, F.ceil(w / F.lit(float(max_work))).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", *,
                max_rows_per_key: int = DEFAULT_MAX_ROWS_PER_KEY, salt_cols: list[str] | None = None,
                hot: DataFrame | None = None, expanding: bool = False) -> DataFrame:
    """``left.join(right, key, how)`` with hot left keys spread over sub-tasks.

    ``salt_cols``: left columns hashed to pick a row's sub-key (default: all
    left columns).  ``hot``: a precomputed hot-key table (see
    ``hot_from_counts``) -- saves the extra counting pass over ``left`` when
    the per-key counts are already aggregated.  Only inner and left joins are
    supported (a left row meets each right row of its key exactly once either
    way).  ``expanding=True`` marks a join whose output is much larger than
    its inputs: both sides are then spread over the configured shuffle
    partitions on (key, salt) so the multiplied work is not coalesced away.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = [key] if isinstance(key, str) else list(key)
    hot = hot if hot is not None else hot_keys(left, keys, max_rows_per_key)
    salt_src = [F.col(c) for c in (salt_cols or left.columns)]
    lft = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0))
                  .otherwise(F.pmod(F.xxhash64(*salt_src), F.col("_salts"))).cast("int")).drop("_salts")
    rgt = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_salts").isNull(), F.array(F.lit(0)))
                           .otherwise(F.sequence(F.lit(0), F.col("_salts") - 1)))).drop("_salts")
    if expanding:
        lft, rgt = spread(lft, *keys, "_salt"), spread(rgt, *keys, "_salt")
    return lft.join(rgt, keys + ["_salt"], how).drop("_salt")
