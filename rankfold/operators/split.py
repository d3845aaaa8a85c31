"""Global-time split with a gap, for flat and sequential logs.

Segments (half-open, in seconds):
  train  ts <  test_ts - gap - val_size - (gap if val_size else 0)
  val    test_ts - val_size - gap <= ts < test_ts - gap      (only if val_size)
  test   ts >= test_ts
Events inside a gap belong to no segment.  Validation and test keep only
users seen in train (and optionally only items seen in train).

Plan shape: each segment is a range filter pushed to the Parquet scan (where the
time is stored in another type, ``split_read`` asks the source for the range, which
tests it on the stored column); the "seen in train" rule is a LEFT SEMI join against the distinct train keys.  The
distinct keys are written once, when a segment first needs them: both held-out
segments read them, and a plain shuffle join against a written table is a
shape whose skewed partitions AQE splits (a join right above the distinct's
own exchange is not).  A small key set is still broadcast at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.functions.exprs import field
from rankfold.operators.indexing import staged


class Split:
    """train, val (or None) and test; held-out segments are built when asked for."""

    def __init__(self, train: DataFrame, val, test):
        self.train, self._val, self._test = train, val, test

    @cached_property
    def val(self) -> DataFrame | None:
        return self._val() if self._val else None

    @cached_property
    def test(self) -> DataFrame:
        return self._test()

    def __iter__(self):
        return iter((self.train, self.val, self.test))


class _Seen:
    """Distinct keys of train, each written once on first use."""

    def __init__(self, **frames):
        self._frames, self._written = frames, {}

    def __call__(self, key: str) -> DataFrame:
        if key not in self._written:
            self._written[key] = staged(self._frames[key].distinct(), f"train-{key}")
        return self._written[key]


def boundaries(test_ts: int, val_size: int = 0, gap: int = C.GAP_SIZE) -> dict[str, int]:
    train_ts = test_ts - gap - val_size - (gap if val_size != 0 else 0)
    if gap < 0:
        raise ValueError("gap_size must be >= 0")
    if val_size < 0:
        raise ValueError("val_size must be >= 0")
    if train_ts <= 0:
        raise ValueError("train boundary must be > 0")
    return {"train_end": train_ts, "val_start": test_ts - val_size - gap,
            "val_end": test_ts - gap, "test_start": test_ts}


def split_flat(df: DataFrame, test_ts: int, val_size: int = 0, gap: int = C.GAP_SIZE,
               drop_unseen_items: bool = False, ts_col: str = "timestamp") -> Split:
    """Flat split; returns ``Split(train, val or None, test)``."""
    ts = F.col(ts_col)

    def read(since=None, until=None):
        out = df if since is None else df.filter(ts >= since)
        return out if until is None else out.filter(ts < until)

    return split_read(read, test_ts, val_size, gap, drop_unseen_items)


def split_read(read: Callable[..., DataFrame], test_ts: int, val_size: int = 0, gap: int = C.GAP_SIZE,
               drop_unseen_items: bool = False) -> Split:
    """Flat split of a source that reads a range of time: ``read(since=, until=)``
    gives the events of [since, until), either end open when left out."""
    b = boundaries(test_ts, val_size, gap)
    train = read(until=b["train_end"])
    seen = _Seen(uid=train.select("uid"), item_id=train.select("item_id"))

    def keep_seen(seg: DataFrame) -> DataFrame:
        seg = seg.join(seen("uid"), "uid", "left_semi")
        if drop_unseen_items:
            seg = seg.join(seen("item_id"), "item_id", "left_semi")
        return seg.select(train.columns)

    val = (lambda: keep_seen(read(since=b["val_start"], until=b["val_end"]))) if val_size != 0 else None
    return Split(train, val, lambda: keep_seen(read(since=b["test_start"])))


def _list_columns(seq: DataFrame) -> list[str]:
    return [c for c in seq.columns if c not in ("uid", "chunk")]


def _keys(seq: DataFrame) -> list[str]:
    """Row keys: uid, plus chunk for histories cut into bounded rows."""
    return ["uid", "chunk"] if "chunk" in seq.columns else ["uid"]


def _gather(seq: DataFrame, pred, ts_col: str) -> DataFrame:
    """Keep, in every list column, the positions whose timestamp satisfies
    ``pred``; users left with nothing are dropped.  Map-only (no shuffle)."""
    # Inputs get private names first: inside one select, a lambda referring to
    # "timestamp" could otherwise bind to the *output* alias "timestamp"
    # (lateral column alias) and filter the other lists by filtered positions.
    lc = _list_columns(seq)
    keys = _keys(seq)
    tmp = {c: f"_g{i}" for i, c in enumerate(lc)}
    base = seq.select(*keys, *[F.col(c).alias(tmp[c]) for c in lc])
    ts = F.col(tmp[ts_col])
    cols = [F.filter(F.col(tmp[c]), lambda x, i: pred(F.get(ts, i))).alias(c) for c in lc]
    return base.select(*keys, *cols).filter(F.size("item_id") > 0)


def drop_unseen_items_in_lists(seq: DataFrame, train_items: DataFrame) -> DataFrame:
    """Remove list positions whose item is not in ``train_items``, order kept.

    Scalable form: posexplode the lists, LEFT SEMI join on item_id (a plain
    equi join, no literal item list), then rebuild the lists per user in
    position order.  Users left empty disappear.
    """
    cols = _list_columns(seq)
    keys = _keys(seq)
    zipped = seq.select(*keys, F.posexplode(F.arrays_zip(*[F.col(c) for c in cols])).alias("pos", "e"))
    flat = zipped.select(*keys, "pos", *[F.col(f"e.{c}").alias(c) for c in cols])
    kept = flat.join(train_items, "item_id", "left_semi")
    folded = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("_ev"))
    return folded.select(*keys, *[F.transform("_ev", field(c)).alias(c) for c in cols])


def split_sequences(seq: DataFrame, test_ts: int, val_size: int = 0, gap: int = C.GAP_SIZE,
                    drop_unseen_items: bool = False, ts_col: str = "timestamp") -> Split:
    """Sequential split: the same rules applied inside index-aligned lists."""
    b = boundaries(test_ts, val_size, gap)
    train = _gather(seq, lambda t: t < b["train_end"], ts_col)
    seen = _Seen(uid=train.select("uid"), item_id=train.select(F.explode("item_id").alias("item_id")))

    def finish(seg: DataFrame) -> DataFrame:
        seg = seg.join(seen("uid"), "uid", "left_semi")
        if drop_unseen_items:
            seg = drop_unseen_items_in_lists(seg, seen("item_id"))
        return seg.filter(F.size("item_id") > 0).select(seq.columns)

    val = (lambda: finish(_gather(seq, lambda t: (t >= b["val_start"]) & (t < b["val_end"]), ts_col))) if val_size != 0 else None
    return Split(train, val, lambda: finish(_gather(seq, lambda t: t >= b["test_start"], ts_col)))
