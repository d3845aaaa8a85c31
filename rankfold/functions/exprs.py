"""Scalar and array expression helpers.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfold import constants as C


def decay_tau(hour: float, decay: float = C.DECAY) -> float:
    """Per-second decay so that weight falls by ``decay`` every ``hour`` hours.

    ``hour == 0`` gives 0.0: with ``pow(0, 0) = 1`` only events at the latest
    timestamp keep weight one.
    """
    if hour == 0:
        return 0.0
    return decay ** (1.0 / C.DAY_SECONDS / (hour / 24.0))


def rank_discount(rank: Column) -> Column:
    """DCG discount ``1 / log2(rank + 1)`` for ranks starting at 1."""
    return F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))


def ideal_dcg(n: Column) -> Column:
    """Sum of discounts of the first ``n`` positions (0 when ``n <= 0``)."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), n.cast("int")),
            F.lit(0.0),
            lambda acc, r: acc + F.lit(1.0) / F.log2(r.cast("double") + F.lit(1.0)),
        )
    )


def hashed_int(n: Column | int, *parts: Column | str | int) -> Column:
    """Deterministic uniform draw in ``[0, n)`` from the md5 of the parts.

    Draws are a pure function of their inputs, so task retries and
    recomputation give identical values (``rand()`` would not after a
    re-shuffle).  The first 15 hex digits (60 bits) of the md5 are used.
    """
    cols = [p if isinstance(p, Column) else (F.lit(p) if isinstance(p, int) else F.col(p)) for p in parts]
    key = F.concat_ws(":", *[c.cast("string") for c in cols])
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    n_col = n if isinstance(n, Column) else F.lit(n)
    # non-nullable: otherwise joins on the draw get an inferred isnotnull
    # filter that re-evaluates the md5 (15 hex digits always convert)
    return F.coalesce(F.pmod(h, n_col.cast("long")), F.lit(0).cast("long"))


def last_n(arr: Column, n: int) -> Column:
    """Last ``n`` elements of an array (all of it when shorter)."""
    size = F.size(arr)
    return F.when(size <= n, arr).otherwise(F.slice(arr, size - F.lit(n) + F.lit(1), n))


def seconds_since(ts: Column, epoch: str) -> Column:
    """Whole seconds from ``epoch`` (a timestamp literal) to ``ts``.

    ``timestamp_diff`` on ``timestamp_ntz`` ignores the session time zone.
    """
    return F.timestamp_diff("SECOND", F.lit(epoch).cast("timestamp_ntz"), ts).cast("long")


def within_seconds(ts: str, epoch: str, since: int | None, until: int | None) -> Column:
    """Whether ``seconds_since(ts, epoch)`` lies in [since, until), as a range of the raw
    ``timestamp_ntz`` column against literals of its own type, so that it reaches
    the Parquet reader (row groups outside of it are skipped)."""
    def at(seconds):
        when = datetime.fromisoformat(epoch) + timedelta(seconds=int(seconds))
        return F.lit(when.isoformat(" ")).cast("timestamp_ntz")

    raw, out = F.col(ts), F.lit(True)
    out = out if since is None else out & (raw >= at(since))
    return out if until is None else out & (raw < at(until))


def parse_metrics(names: list[str]) -> dict[str, list[int]]:
    """Cut-offs by metric: ``["ndcg@10", "recall@50"]`` -> ``{"ndcg": [10], "recall": [50]}``."""
    cutoffs: dict[str, list[int]] = {}
    for text in names:
        metric, at, cutoff = text.partition("@")
        if not at or not cutoff.isdigit():
            raise ValueError(f"{text!r} is no metric with a cut-off, such as ndcg@10")
        cutoffs.setdefault(metric, []).append(int(cutoff))
    return cutoffs


def max_k(names: list[str]) -> int:
    return max(k for ks in parse_metrics(names).values() for k in ks)


def field(name: str):
    """One-argument lambda extracting struct field ``name`` (for ``transform``)."""
    return lambda e: e.getField(name)
