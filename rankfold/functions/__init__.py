from rankfold.functions.exprs import (
    decay_tau,
    rank_discount,
    ideal_dcg,
    hashed_int,
    last_n,
    parse_metrics,
    seconds_since,
    max_k,
)

__all__ = [
    "decay_tau", "rank_discount", "ideal_dcg", "hashed_int", "last_n",
    "parse_metrics", "seconds_since", "max_k",
]
