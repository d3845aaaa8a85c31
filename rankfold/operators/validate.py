"""Preconditions of the evaluation frames (M8, J9), as lazy violation frames.

Each ``*_violations`` function returns the offending rows (empty when the
frame is valid); ``require_valid`` runs them and raises.  The checks are
grouped aggregates or a per-user ``lag`` window over ranked rows (bounded by
the list length), never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys that occur more than once (ids must be unique)."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unsorted_scores(ranked: DataFrame) -> DataFrame:
    """Ranked rows whose score is higher than the score one rank above."""
    w = Window.partitionBy("uid").orderBy("rank")
    return ranked.withColumn("_prev", F.lag("score").over(w)).filter(F.col("_prev") < F.col("score"))


def bad_ks(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """One row per k outside ``0 < k <= width`` (width = longest list)."""
    width = ranked.agg(F.max("rank")).scalar()
    spark = ranked.sparkSession
    kdf = spark.createDataFrame([(int(k),) for k in ks], "k INT")
    return kdf.filter((F.col("k") <= 0) | (F.col("k") > width))


def missing_target_users(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Target users without a ranked list (J9: the reference asserts none)."""
    return targets.select("uid").distinct().join(ranked.select("uid").distinct(), "uid", "left_anti")


def cut_off_ranked(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranked lists of target users only."""
    return ranked.join(targets.select("uid").distinct(), "uid", "left_semi")


def require_valid(ranked: DataFrame, targets: DataFrame | None = None, ks: list[int] | None = None) -> None:
    """Raise ``ValueError`` on the first violated precondition."""
    checks = [("duplicate (uid, rank)", duplicate_ids(ranked, ["uid", "rank"])),
              ("scores not sorted", unsorted_scores(ranked))]
    if ks:
        checks.append(("k outside (0, width]", bad_ks(ranked, ks)))
    if targets is not None:
        checks.append(("ranked lacks target users", missing_target_users(ranked, targets)))
        if targets.limit(1).count() == 0:
            raise ValueError("targets empty")
    for name, df in checks:
        if df.limit(1).count() > 0:
            raise ValueError(name)
