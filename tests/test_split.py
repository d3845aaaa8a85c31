"""Flat and sequential splits agree (the reference's own cross-check), seeded,
plus the paths the reference never tested: unseen-item dropping, val_size=0."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.operators.reshape import explode_sequences, to_sequences
from rankfold.operators.split import boundaries, split_flat, split_sequences


def make_events(spark, n=10_000, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "uid": rng.integers(1, int(n * 0.05), size=n),
        "item_id": rng.integers(100, 200, size=n),
        "timestamp": rng.integers(0, 100_000, size=n),
        "is_organic": rng.integers(0, 2, size=n).astype("int16"),
    })
    pdf["seq"] = np.arange(n)  # tie-break for equal (uid, timestamp)
    return spark.createDataFrame(pdf).select(
        F.col("uid").cast("long"), F.col("item_id").cast("long"), F.col("timestamp").cast("long"),
        F.col("is_organic").cast("short"), F.col("seq").cast("long"))


def same_multiset(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("val_size,drop", [(1000, False), (1000, True), (0, False), (0, True)])
def test_flat_equals_exploded_sequential(spark, val_size, drop):
    df = make_events(spark)
    q75 = int(df.approxQuantile("timestamp", [0.75], 0.0)[0])
    flat = split_flat(df, q75, val_size=val_size, gap=1000, drop_unseen_items=drop)
    seq = to_sequences(df, "columns", order_cols=["timestamp", "seq"])
    sq = split_sequences(seq, q75, val_size=val_size, gap=1000, drop_unseen_items=drop)
    cols = df.columns
    assert same_multiset(flat.train.select(cols), explode_sequences(sq.train).select(cols))
    assert same_multiset(flat.test.select(cols), explode_sequences(sq.test).select(cols))
    if val_size:
        assert same_multiset(flat.val.select(cols), explode_sequences(sq.val).select(cols))
    else:
        assert flat.val is None and sq.val is None


def test_segments_and_seen_rules(spark):
    df = make_events(spark, 4000, seed=3)
    s = split_flat(df, 80_000, val_size=5000, gap=1000, drop_unseen_items=True)
    b = boundaries(80_000, 5000, 1000)
    assert b == {"train_end": 73_000, "val_start": 74_000, "val_end": 79_000, "test_start": 80_000}
    assert s.train.agg(F.max("timestamp")).first()[0] < 73_000
    v = s.val.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert v[0] >= 74_000 and v[1] < 79_000
    assert s.test.agg(F.min("timestamp")).first()[0] >= 80_000
    tu = s.train.select("uid").distinct()
    ti = s.train.select("item_id").distinct()
    assert s.test.join(tu, "uid", "left_anti").count() == 0
    assert s.test.join(ti, "item_id", "left_anti").count() == 0


def test_unseen_items_are_dropped(spark):
    rows = [(1, 10, 1), (1, 11, 2), (2, 10, 3), (1, 99, 100), (2, 10, 101), (3, 10, 102)]
    df = spark.createDataFrame(rows, "uid long, item_id long, timestamp long")
    s = split_flat(df, 100, val_size=0, gap=10, drop_unseen_items=True)
    assert sorted(tuple(r) for r in s.test.collect()) == [(2, 10, 101)]
    seq = to_sequences(df, "columns")
    sq = split_sequences(seq, 100, 0, 10, drop_unseen_items=True)
    assert [(r.uid, r.item_id) for r in sq.test.collect()] == [(2, [10])]


def test_argument_checks():
    with pytest.raises(ValueError):
        boundaries(100, -1, 10)
    with pytest.raises(ValueError):
        boundaries(100, 0, -1)
    with pytest.raises(ValueError):
        boundaries(10, 5, 10)


def test_chunked_fold_keeps_everything(spark):
    df = make_events(spark, 3000, seed=9)
    chunked = to_sequences(df, "columns", order_cols=["timestamp", "seq"], max_events_per_row=7)
    assert chunked.select(F.max(F.size("item_id"))).first()[0] <= 7
    cols = df.columns
    assert same_multiset(explode_sequences(chunked).select(cols), df.select(cols))
    # chunks are consecutive, in time order, per user
    rows = chunked.filter("uid = 5").orderBy("chunk").collect()
    ts = [t for r in rows for t in r.timestamp]
    assert ts == sorted(ts) and [r.chunk for r in rows] == list(range(len(rows)))
    q75 = int(df.approxQuantile("timestamp", [0.75], 0.0)[0])
    flat = split_flat(df, q75, 1000, 1000, drop_unseen_items=True)
    sq = split_sequences(chunked, q75, 1000, 1000, drop_unseen_items=True)
    assert same_multiset(flat.test.select(cols), explode_sequences(sq.test).select(cols))
    assert same_multiset(flat.val.select(cols), explode_sequences(sq.val).select(cols))
