"""Histories in bounded rows, lists from files, item models by their equations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import sequences
from rankfold.operators.indexing import dense_index, map_ids_in_lists
from rankfold.operators.reshape import fold_chunks, to_sequences
from rankfold.operators.split import split_sequences
from rankfold.plans import jobs
from rankfold.recommenders import bpr, sparse_inverse
from rankfold.recommenders.sparse_linear import count_matrix, gramian


@pytest.fixture
def many_tasks(spark):
    """Plain shuffles into 32 partitions, none merged; joins split partitions of this test's size."""
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    keep = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in keep.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_log(spark, n=60_000):
    """A third of the events are one user's, and a third one item's."""
    return spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).cast("long").alias("uid"), F.col("id").alias("timestamp"),
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id") * 7919 % 997).cast("long").alias("item_id"))


def largest_share(df, size):
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(size).alias("n")).collect()
    return max(r.n for r in parts) / sum(r.n for r in parts)


def test_no_task_holds_a_hot_user_or_item(spark, many_tasks):
    log = hot_log(spark)
    seq = to_sequences(log, "columns", order_cols=["timestamp"], max_events_per_row=64)
    assert largest_share(seq, F.size("item_id")) < 1 / 8
    index = dense_index(log, "item_id", 1, "item_idx")
    mapped = map_ids_in_lists(seq, "item_id", index, "item_idx", max_rows_per_key=1000)
    assert largest_share(mapped, F.size("item_id")) < 1 / 8
    test = split_sequences(seq, 40_000, 0, 10).test
    assert largest_share(test, F.size("item_id")) < 1 / 8
    assert largest_share(to_sequences(log, "columns", order_cols=["timestamp"]), F.size("item_id")) > 1 / 3  # what the cut avoids
    # and the same lists come out
    whole = map_ids_in_lists(to_sequences(log, "columns", order_cols=["timestamp"]), "item_id", index, "item_idx")
    assert sorted(map(str, fold_chunks(mapped).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("n", [1, 5, 8, 40])
def test_last_events_of_cut_histories(spark, n):
    log = hot_log(spark, 900)
    whole = to_sequences(log, "columns", order_cols=["timestamp"])
    cut = to_sequences(log, "columns", order_cols=["timestamp"], max_events_per_row=8)
    thin = cut.withColumns({c: F.when(F.col("chunk") % 3 == 1, F.slice(c, 1, 2)).otherwise(F.col(c)) for c in ("timestamp", "item_id")})
    for a, b in ((sequences.last_events(cut, n), sequences.last_events(whole, n)),
                 (sequences.last_events(thin, n), sequences.last_events(fold_chunks(thin), n))):
        assert sorted(map(str, a.select("uid", "item_id", "timestamp").collect())) == sorted(map(str, b.select("uid", "item_id", "timestamp").collect()))


def test_lists_from_files(spark, tmp_path):
    lists = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 11), (2, 2, 12)], "uid long, rank int, item_id long")
    targets = spark.createDataFrame([(1, 11), (2, 11)], "uid long, item_id long")
    at = {k: str(tmp_path / k) for k in ("ranked", "targets", "more", "out")}
    lists.write.parquet(at["ranked"])
    targets.write.parquet(at["targets"])
    rep = {(r.metric, r.k): r.value for r in jobs.evaluate_lists(spark, at["ranked"], at["targets"], ["recall@1", "mrr@2", "coverage@2"], out_path=at["out"]).collect()}
    assert rep == {("recall", 1): 0.5, ("mrr", 2): 0.75, ("coverage", 2): 1.0}
    with pytest.raises(ValueError, match="k outside"):
        jobs.evaluate_lists(spark, at["ranked"], at["targets"], ["recall@3"])
    targets.unionByName(spark.createDataFrame([(3, 1)], targets.schema)).write.parquet(at["more"])
    with pytest.raises(ValueError, match="lacks target users"):
        jobs.evaluate_lists(spark, at["ranked"], at["more"], ["recall@1"])


def counts(rng, users=30, items=18):
    rows = [(int(u), int(i) * 3, 0) for u in range(users) for i in rng.choice(items, rng.integers(2, 8), replace=False) for _ in range(rng.integers(1, 3))]
    return rows


@pytest.mark.parametrize("n, steps", [(2, 3), (5, 4), (18, 40)])
def test_sparse_inverse_equals_numpy(spark, n, steps):
    rows = counts(np.random.default_rng(n))
    train = spark.createDataFrame(rows, "uid long, item_id long, timestamp long")
    ids = sorted({i for _, i, _ in rows})
    X = np.zeros((30, len(ids)))
    for u, i, _ in rows:
        X[u, ids.index(i)] += 1
    A = X.T @ X + 10 * np.eye(len(ids))
    P, R = np.zeros_like(A), np.eye(len(ids))
    for _ in range(steps):
        Z = R / np.diag(A)[:, None]
        for j in range(len(ids)):
            drop = sorted(range(len(ids)), key=lambda i: (-round(abs(Z[i, j]), 9), i))[n:]
            Z[drop, j] = 0
        Q = A @ Z
        alpha = (R * Q).sum(0) / np.maximum((Q * Q).sum(0), 1e-300)
        P, R = P + alpha * Z, R - alpha * Q
        R[np.abs(R) < 1e-4] = 0
    for j in range(len(ids)):
        off = [i for i in range(len(ids)) if i != j]
        P[sorted(off, key=lambda i: (-round(abs(P[i, j]), 9), i))[n:], j] = 0
    model = sparse_inverse.SparseInverse(train, neighbours=n, steps=steps)
    got = np.zeros_like(P)
    for r in model.columns.collect():
        got[ids.index(r.i), ids.index(r.j)] = r.p
    assert np.allclose(got, P, atol=1e-10)
    res = {r.item_id: r.residual for r in model.residuals().collect()}
    assert np.allclose([res[i] for i in ids], ((np.eye(len(ids)) - A @ P) ** 2).sum(0))
    if n == len(ids):  # nothing dropped for lack of room: the inverse itself, up to the dropped residuals
        assert np.allclose(got, np.linalg.inv(A), atol=1e-3)
        W = -np.linalg.inv(A) / np.diag(np.linalg.inv(A))
        np.fill_diagonal(W, 0)
        S = {(r.uid, r.item_id): r.score for r in model.scores().collect()}
        assert all(math.isclose(S[u, ids[i]], (X @ W)[u, i], abs_tol=0.05) for u in range(30) for i in range(len(ids)) if (u, ids[i]) in S)


def test_sparse_inverse_over_split_keys(spark):
    train = spark.createDataFrame(counts(np.random.default_rng(1)), "uid long, item_id long, timestamp long")
    x = count_matrix(train)
    a = sparse_inverse.regularised(gramian(x), 10.0)
    one, two = (sorted((r.i, r.j, round(r.p, 9)) for r in sparse_inverse.approximate_inverse(a, 3, 3, max_pairs_per_task=m).collect()) for m in (10**9, 20))
    assert one == two


def test_padded_lists_have_their_length(spark):
    train = spark.createDataFrame(counts(np.random.default_rng(2)), "uid long, item_id long, timestamp long")
    users = spark.createDataFrame([(u,) for u in (1, 2, 2, 999)], "uid long")
    rows = sparse_inverse.SparseInverse(train, neighbours=2).ranked(users, 25, pad=True).collect()
    by = {u: sorted((r.rank, r.item_id, r.score) for r in rows if r.uid == u) for u in (1, 2, 999)}
    assert all([r[0] for r in by[u]] == list(range(1, 26)) for u in by)
    assert {(i, s) for _, i, s in by[999]} == {(0, -1.0)} and {s for _, _, s in by[1]} != {-1.0}


def test_bpr_passes_equal_plain_steps(spark):
    """One block, by the formula; several blocks and a spread user keep all pairs and stay finite."""
    rng = np.random.default_rng(3)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 12, 90), rng.integers(0, 15, 90))})
    train = spark.createDataFrame([(u, i, 0) for u, i in pairs], "uid long, item_id long, timestamp long")
    setting = [{"trial": 0, "learning_rate": 0.1, "regularization": 0.01, "iterations": 3}, {"trial": 1, "learning_rate": 0.01, "regularization": 0.1, "iterations": 2}]
    fit = bpr.BprTrials(train, setting, rank=3, batch=7, blocks=1, merge_every=2)
    start = {(r.trial, r.kind, r.idx): np.array(r.embedding) for r in fit.factors.collect()}
    draws = {p: {(r.uid_idx, r.item_idx): r.draws[0] for r in fit._drawn(1).collect()} for p in range(3) for _ in [setattr(fit, "done", p)]}
    fit.done = 0
    fit.advance(3)
    end = {(r.trial, r.kind, r.idx): np.array(r.embedding) for r in fit.factors.collect()}
    users, items = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    have = {(users.index(u), items.index(i)) for u, i in pairs}
    for t in setting:
        f = {k[1:]: v.copy() for k, v in start.items() if k[0] == t["trial"]}
        for p in range(t["iterations"]):
            order = sorted(have, key=lambda k: draws[p][k])
            for a in range(0, len(order), 7):
                delta = {k: np.zeros(3) for k in f}
                for u, i in order[a:a + 7]:
                    j = draws[p][u, i] % len(items)
                    if (u, j) in have:
                        continue
                    x, y, z = f[0, u], f[1, i], f[1, j]
                    g = 1 / (1 + math.exp(x @ (y - z)))
                    delta[0, u] += g * (y - z) - t["regularization"] * x
                    delta[1, i] += g * x - t["regularization"] * y
                    delta[1, j] += -g * x - t["regularization"] * z
                for k in f:
                    f[k] = f[k] + t["learning_rate"] * delta[k]
        assert all(np.allclose(f[k], end[t["trial"], *k], atol=1e-12) for k in f)
    spread = bpr.BprTrials(train, setting[:1], rank=3, batch=7, blocks=3, merge_every=2, pairs_per_block=5)
    assert spread.any_spread and spread.pairs.count() == len(pairs)
    barred = {(r.uid_idx, r.item_idx): r.barred for r in spread._drawn(2).collect()}
    for (u, i), bits in barred.items():
        for t in range(2):
            drawn = draws[t][u, i] % len(items)
            big = sum(x == u for x, _ in have) > 5
            assert bool(bits >> t & 1) == (big and (u, drawn) in have)
    spread.advance(3)
    assert all(np.isfinite(r.embedding).all() for r in spread.factors.collect())


def test_bpr_blocks_read_in_order_equal_held_ones(spark):
    """A block of more pairs than a task should hold is stepped as it is read, all trials through the
    same rows, to the same factors as a held one; hashes of a pair are those of ``hashed_int``."""
    rng = np.random.default_rng(8)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 12, 100), rng.integers(0, 14, 100))})
    train = spark.createDataFrame([(u, i, 0) for u, i in pairs], "uid long, item_id long, timestamp long")
    setting = [{"trial": t, "learning_rate": 0.1, "regularization": 0.01 * t, "iterations": n} for t, n in ((0, 3), (1, 3), (2, 1))]
    ends = []
    for most in (15, 200_000):
        fit = bpr.BprTrials(train, setting, rank=3, batch=7, blocks=2, merge_every=2, pairs_per_block=most)
        assert fit.in_order == (most == 15) and not fit.any_spread
        fit.advance(3)
        ends.append({(r.trial, r.kind, r.idx): np.array(r.embedding) for r in fit.factors.collect()})
    assert ends[0].keys() == ends[1].keys() and all(np.allclose(ends[0][k], ends[1][k], atol=1e-12) for k in ends[0])
    fit = bpr.BprTrials(train, setting, rank=3, blocks=1)
    fit.n_pairs = 10 ** 9
    groups, parts = fit._dealt(1, [2, 1, 0])  # a row of pairs for all trials, not one a trial
    assert groups == [([0, 1, 2], 1)] and parts == 1
    rows = fit._drawn(2).collect()
    u, i = (np.array([r[c] for r in rows]) for c in ("uid_idx", "item_idx"))
    hashes = bpr.pair_hashes()(u, i)
    assert all((hashes(42, t) == [r.draws[t] for r in rows]).all() for t in (0, 1))
