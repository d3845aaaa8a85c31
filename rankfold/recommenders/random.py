"""Random recommender: k items per train user, drawn uniformly with replacement.

Draws are md5 hashes of (seed, uid, position) -- a pure function of the row,
so retries and recomputation reproduce them.  The item dictionary maps a
dense index (0..n-1, ascending item_id) to the item; the lookup is an equi
join on that index (AQE broadcasts the dictionary when it is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.functions.exprs import hashed_int
from rankfold.operators.indexing import dense_index
from rankfold.operators.skew import spread_rows


def random_draws(train: DataFrame, item_dict: DataFrame, k: int = C.NUM_RANKED_ITEMS, seed: int = 42,
                 exclude_last: bool = False) -> DataFrame:
    """(uid, item_ids): every train user's k draws in one list, as indices of ``item_dict``.

    ``exclude_last=True`` reproduces the reference's draw range, which never
    picks the last item of the sorted item list.
    """
    users = train.select("uid").distinct()
    n = item_dict.agg(F.count(F.lit(1))).scalar()
    if exclude_last:
        n = n - F.lit(1)
    # a column: a scalar subquery may not sit inside a higher-order function
    users = spread_rows(users, "uid").select("uid", n.alias("_n"))
    draw = lambda rank: hashed_int(F.col("_n"), F.lit(seed), F.col("uid"), rank)
    return users.select("uid", F.transform(F.sequence(F.lit(1), F.lit(k)), draw).alias("item_ids"))


def random_ranked(train: DataFrame, k: int = C.NUM_RANKED_ITEMS, seed: int = 42,
                  exclude_last: bool = False, item_dict: DataFrame | None = None) -> DataFrame:
    """(uid, rank, item_id, score) with score = k - rank + 1 (the default scores), of
    ``random_draws``."""
    if item_dict is None:
        item_dict = dense_index(train, "item_id", 0, "item_idx")
    draws = random_draws(train, item_dict, k, seed, exclude_last).select("uid", F.posexplode("item_ids").alias("_pos", "item_idx"))
    rank = F.col("_pos") + F.lit(1)
    return draws.join(item_dict, "item_idx", "inner").select(
        "uid", rank.cast("int").alias("rank"), "item_id", (F.lit(k) - rank + F.lit(1)).cast("double").alias("score"))
