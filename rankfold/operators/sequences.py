"""Data jobs for next-item sequence models (everything up to collated batches).

prepare_sequences   listen threshold inside lists, item index from 1 over all
                    items, sequential split, last n train events, ids -> index (R9)
next_item_rows      input seq[:-1], positives seq[1:], hashed negatives (R10)
eval_rows           uid, last n train items, held-out items (R11)
flatten_batches     concatenated ids + lengths per batch (R12)
position_table      item, position, reverse position (newest = 0) (R13)
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.functions.exprs import hashed_int, last_n
from rankfold.operators.indexing import dense_index, map_ids_in_lists, staged
from rankfold.operators.reshape import fold_chunks
from rankfold.operators.split import split_sequences
from rankfold.streaming.shards import row_index


class SequenceData:
    """train, val (or None) and test as item indices, and ``item_index`` (item_id,
    item_idx) with idx from 1.  A segment is prepared when it is first asked for."""

    def __init__(self, item_index: DataFrame, train, val, test):
        self.item_index, self._train, self._val, self._test = item_index, train, val, test

    @cached_property
    def train(self) -> DataFrame:
        return self._train()

    @cached_property
    def val(self) -> DataFrame | None:
        return self._val()

    @cached_property
    def test(self) -> DataFrame:
        return self._test()

    def num_items(self):
        return self.item_index.agg(F.count(F.lit(1))).scalar()


def _row_keys(seq: DataFrame) -> list[str]:
    return ["uid", "chunk"] if "chunk" in seq.columns else ["uid"]


def listen_lists(seq: DataFrame, threshold: int = C.TRACK_LISTEN_THRESHOLD) -> DataFrame:
    """Keep item_id and timestamp at positions with played_ratio_pct >= threshold;
    other list columns are dropped; rows left empty disappear (P3)."""
    keys = _row_keys(seq)
    base = seq.select(*keys, F.col("item_id").alias("_i"), F.col("timestamp").alias("_t"),
                      F.col("played_ratio_pct").alias("_p"))
    keep = lambda x, i: F.get(F.col("_p"), i) >= threshold
    out = base.select(*keys, F.filter("_i", keep).alias("item_id"), F.filter("_t", keep).alias("timestamp"))
    return out.filter(F.size("item_id") > 0)


def last_events(seq: DataFrame, n: int) -> DataFrame:
    """One row per user with the last ``n`` events of its lists.

    Of a history cut into chunks, the rows that reach into the last ``n`` events are
    found by the lengths alone (one number a row), so no more than ``n`` events of a
    user ever meet.
    """
    cols = [c for c in seq.columns if c not in ("uid", "chunk")]
    if "chunk" not in seq.columns:
        return seq.select("uid", *[last_n(F.col(c), n).alias(c) for c in cols])
    later = Window.partitionBy("uid").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = seq.select("uid", "chunk", F.size(cols[0]).alias("_s"))
    after = sizes.select("uid", "chunk", F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_after")).filter(F.col("_after") < n)
    tail = seq.join(after, ["uid", "chunk"])
    room = F.lit(n) - F.col("_after")
    cut = [F.slice(c, F.greatest(F.size(c) - room + 1, F.lit(1)).cast("int"), F.least(F.size(c), room).cast("int")).alias(c) for c in cols]
    return fold_chunks(tail.select("uid", "chunk", *cut))


def prepare_sequences(seq: DataFrame, interaction: str = "likes", *, test_ts: int = C.TEST_TIMESTAMP,
                      val_size: int = C.VAL_SIZE, gap: int = C.GAP_SIZE,
                      max_seq_len: int = C.MAX_SEQ_LEN, fit_on: str = "all") -> SequenceData:
    """R9.  Cutting train lists to the last ``max_seq_len`` events happens
    before the id replacement, which shrinks the replacement's shuffle.

    ``fit_on="all"`` numbers every item of the log, test included, as the
    reference does (D14); ``fit_on="train"`` numbers train items only and
    drops unseen items from the held-out lists so the strict mapping holds.
    Histories cut into bounded rows stay so in the held-out segments; train lists
    are bounded by ``max_seq_len`` and come as one row per user either way.

    The item index, the train users and both sides of every segment's mapping read the
    lists: they are written once, so that the log is folded once.
    """
    seq = staged(listen_lists(seq) if interaction == "listens" else seq, "sequences")
    s = split_sequences(seq, test_ts, val_size, gap, drop_unseen_items=(fit_on == "train"))
    src = seq if fit_on == "all" else s.train
    item_index = dense_index(src.select(F.explode("item_id").alias("item_id")), "item_id", 1, "item_idx")

    def indexed(rows: DataFrame) -> DataFrame:
        return map_ids_in_lists(rows, "item_id", item_index, "item_idx")

    return SequenceData(item_index, lambda: indexed(last_events(s.train, max_seq_len)),
                        lambda: None if s.val is None else indexed(s.val), lambda: indexed(s.test))


def next_item_rows(train: DataFrame, num_items, max_seq_len: int = C.MAX_SEQ_LEN, seed: int = 42) -> DataFrame:
    """(uid, item_ids, positive_ids, negative_ids, length).

    Negatives are uniform in 1..num_items from hashed draws of (seed, uid,
    position); positives are not excluded, as in the reference.  Users with a
    single event get empty arrays.
    """
    n_items = num_items if not isinstance(num_items, int) else F.lit(num_items)
    ids = F.col("item_id")
    size = F.size(ids)
    inp = F.when(size <= 1, F.array().cast("array<long>")).otherwise(last_n(F.slice(ids, 1, size - 1), max_seq_len))
    pos = F.when(size <= 1, F.array().cast("array<long>")).otherwise(last_n(F.slice(ids, 2, size - 1), max_seq_len))
    # the item count is attached as a column: a scalar subquery may not sit
    # inside a higher-order function
    rows = train.select("uid", inp.alias("item_ids"), pos.alias("positive_ids"), n_items.alias("_n"))
    neg = F.transform(F.col("item_ids"),
                      lambda x, i: hashed_int(F.col("_n"), F.lit(seed), F.col("uid"), i) + F.lit(1))
    return rows.select("uid", "item_ids", "positive_ids", neg.alias("negative_ids"),
                       F.size("item_ids").alias("length"))


def eval_rows(train: DataFrame, held_out: DataFrame, max_seq_len: int = C.MAX_SEQ_LEN) -> DataFrame:
    """(uid, item_id_train, item_id_valid): users present in both (J7 + O8)."""
    t = train.select("uid", last_n(F.col("item_id"), max_seq_len).alias("item_id_train"))
    v = held_out.select("uid", F.col("item_id").alias("item_id_valid"))
    return t.join(v, "uid", "inner")


def flatten_batches(rows: DataFrame, list_cols: list[str], batch_size: int, order_cols: list[str] | None = None,
                    key_col: str = "uid") -> DataFrame:
    """(batch_id, <key>_ids, <c>_ids, <c>_lengths ...) per batch of ``batch_size`` rows.

    Rows are numbered under ``order_cols`` (default the key) without a global
    window; every batch is one group of at most ``batch_size`` rows.
    """
    order_cols = order_cols or [key_col]
    numbered = row_index(rows, order_cols)
    numbered = numbered.withColumn("batch_id", F.floor(F.col("row_idx") / F.lit(batch_size)).cast("long"))
    parts = [F.col("row_idx"), F.col(key_col)] + [F.col(c) for c in list_cols]
    g = numbered.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("_rows"))
    out = [F.col("batch_id"), F.transform("_rows", lambda r: r.getField(key_col)).alias(f"{key_col}_ids")]
    for c in list_cols:
        out.append(F.flatten(F.transform("_rows", _getter(c))).alias(f"{c}_ids"))
        out.append(F.transform("_rows", _size_getter(c)).alias(f"{c}_lengths"))
    return g.select(*out)


def _getter(c: str):
    return lambda r: r.getField(c)


def _size_getter(c: str):
    return lambda r: F.size(r.getField(c))


def position_table(seq: DataFrame, list_col: str = "item_id") -> DataFrame:
    """(uid, pos, item, rev_pos, valid): reverse position, newest event = 0."""
    ex = seq.select("uid", F.size(list_col).alias("_n"), F.posexplode(list_col).alias("pos", "item"))
    return ex.select("uid", "pos", "item", (F.col("_n") - 1 - F.col("pos")).alias("rev_pos"),
                     F.lit(True).alias("valid"))
