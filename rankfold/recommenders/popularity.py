"""Time-decayed item popularity (one list for every user).

score(i) = sum over train events of i of tau ** (max_ts - ts), with
tau = decay ** (1 / 86400 / (hour / 24)); ``hour == 0`` means plain counts.

The hour grid is evaluated in ONE job: a single aggregation by item carries
one decayed sum per grid value, and its result is expanded to one row per
(hour, item).  Per-hour top-k lists are selected with a window over at most
k rows per hour after a partial WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.functions.exprs import decay_tau


def max_timestamp(train: DataFrame):
    """Global max timestamp as a scalar subquery (no collect)."""
    return train.agg(F.max("timestamp")).scalar()


def item_counts(train: DataFrame) -> DataFrame:
    """(item_id, n) events per item (A1)."""
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def item_scores(train: DataFrame, hour: float, decay: float = C.DECAY) -> DataFrame:
    """(item_id, score) for one hour value (A1/A2)."""
    if hour == 0:
        return train.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    tau = decay_tau(hour, decay)
    w = F.pow(F.lit(tau), (max_timestamp(train) - F.col("timestamp")).cast("double"))
    return train.groupBy("item_id").agg(F.sum(w).alias("score"))


def grid_item_scores(train: DataFrame, hours: list[float], decay: float = C.DECAY) -> DataFrame:
    """(trial, hour, item_id, score) for every hour of the grid in one pass.

    ONE aggregation by item carries one decayed sum per grid value (plus the
    count for ``hour == 0``) in its buffer, with map-side partial sums; the
    per-item result is then expanded to one row per grid value -- events are
    never multiplied by the grid size.
    """
    mx = max_timestamp(train)
    d = (mx - F.col("timestamp")).cast("double")
    aggs = [F.count(F.lit(1)).cast("double").alias("_n")]
    aggs += [F.sum(F.pow(F.lit(float(decay_tau(h, decay))), d)).alias(f"_s{i}")
             for i, h in enumerate(hours) if h != 0]
    per_item = train.groupBy("item_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(float(h)).alias("hour"),
                              F.col("_n" if h == 0 else f"_s{i}").alias("score"))
                     for i, h in enumerate(hours)])
    return per_item.select("item_id", F.inline(rows)).select("trial", "hour", "item_id", "score")


def grid_top_k(grid_scores: DataFrame, k: int, round_digits: int | None = None) -> DataFrame:
    """(trial, hour, rank, item_id, score): k best items per grid value."""
    s = F.col("score") if round_digits is None else F.round("score", round_digits)
    w = Window.partitionBy("trial").orderBy(F.desc("score"), F.asc("item_id"))
    g = grid_scores.withColumn("score", s)
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("trial", "hour", "rank", "item_id", "score"))
