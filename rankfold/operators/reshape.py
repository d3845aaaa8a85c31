"""Reshaping event logs: multi-event union, total-order sort, fold to
per-user sequences and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.functions.exprs import field


def union_event_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """Tagged union of the single-kind tables.

    Adds ``event_type`` (kind name) and ``event_ord`` (enum order: listen,
    dislike, like, undislike, unlike); columns a kind lacks (the two listen
    measures) come out as typed nulls.  ``unionByName`` is a narrow operator:
    no shuffle.
    """
    parts = []
    for kind in C.EVENT_KINDS:
        if kind not in tables:
            continue
        t = tables[kind]
        for c in ("played_ratio_pct", "track_length_seconds"):
            if c not in t.columns:
                t = t.withColumn(c, F.lit(None).cast("long"))
        t = t.withColumn("event_type", F.lit(kind)).withColumn("event_ord", F.lit(C.EVENT_KINDS.index(kind)))
        parts.append(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sort_events(df: DataFrame, tie_cols: list[str] | None = None) -> DataFrame:
    """Total order by (uid, timestamp, event_ord, *tie_cols) (O1).

    Spark's sort is not stable, so the union order of the reference is
    reproduced with explicit keys.  ``orderBy`` range-partitions on the whole
    composite key: a very active user is split across partitions by time
    rather than landing in one task.
    """
    keys = ["uid", "timestamp"]
    if "event_ord" in df.columns:
        keys.append("event_ord")
    keys += [c for c in (tie_cols or []) if c in df.columns and c not in keys]
    return df.orderBy(*keys)


def to_sequences(df: DataFrame, layout: str = "columns", order_cols: list[str] | None = None,
                 value_cols: list[str] | None = None, max_events_per_row: int | None = None) -> DataFrame:
    """Fold a flat log into one row per user (A4 ``columns`` / A5 ``structs``).

    ``collect_list`` has no order guarantee, so each event is collected as a
    struct led by its order keys and the list is sorted with ``array_sort``
    (struct comparison is field by field).  The aggregate is an
    ObjectHashAggregate with map-side partial lists, so only one partial list
    per user and map task crosses the shuffle.

    The layout itself puts a user's whole history into one row.  With
    ``max_events_per_row`` the history is cut into consecutive chunks instead
    -- rows ``(uid, chunk, lists...)`` holding at most that many events -- so
    a user with a third of all events becomes many bounded rows built by many
    tasks.  Positions come from range-partitioned row numbering under
    (uid, order keys), never from a per-user window.
    """
    order_cols = order_cols or ["timestamp"]
    value_cols = value_cols or [c for c in df.columns if c != "uid"]
    keys = [f"_k{i}" for i in range(len(order_cols))]
    group = ["uid"]
    if max_events_per_row is not None:
        df = _chunk_positions(df, order_cols, max_events_per_row)
        group = ["uid", "chunk"]
    ev = F.struct(*[F.col(c).alias(k) for c, k in zip(order_cols, keys)], *[F.col(c) for c in value_cols])
    folded = df.groupBy(*group).agg(F.array_sort(F.collect_list(ev)).alias("_ev"))
    if layout == "columns":
        return folded.select(*group, *[F.transform("_ev", field(c)).alias(c) for c in value_cols])
    if layout == "structs":
        return folded.select(
            *group, F.transform("_ev", lambda e: F.struct(*[e[c].alias(c) for c in value_cols])).alias("events"))
    raise ValueError(f"unknown layout {layout!r}")


def _chunk_positions(df: DataFrame, order_cols: list[str], size: int) -> DataFrame:
    """``df`` + chunk = floor(position within the user / size)."""
    from rankfold.operators.skew import DEFAULT_MAX_ROWS_PER_KEY, hot_from_counts, salted_join
    from rankfold.streaming.shards import row_index

    numbered = row_index(df, ["uid", *order_cols], out_col="_pos")
    first = numbered.groupBy("uid").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    hot = hot_from_counts(first, "uid", "_cnt", DEFAULT_MAX_ROWS_PER_KEY)
    j = salted_join(numbered, first.select("uid", "_first"), "uid", hot=hot)
    return j.withColumn("chunk", F.floor((F.col("_pos") - F.col("_first")) / F.lit(size)).cast("int")) \
            .drop("_pos", "_first")


def fold_chunks(seq: DataFrame) -> DataFrame:
    """Rows of a history cut into chunks back to one row per user: the chunks' lists in
    order, one after the other."""
    cols = [c for c in seq.columns if c not in ("uid", "chunk")]
    folded = seq.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk", *cols))).alias("_c"))
    return folded.select("uid", *[F.flatten(F.transform("_c", field(c))).alias(c) for c in cols])


def explode_sequences(seq: DataFrame) -> DataFrame:
    """Inverse of the ``columns`` fold: one row per list position, order kept
    by a ``pos`` column when requested downstream."""
    cols = [c for c in seq.columns if c not in ("uid", "chunk")]
    z = seq.select("uid", F.inline(F.arrays_zip(*[F.col(c).alias(c) for c in cols])))
    return z.select("uid", *cols)
