"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the adapters and runs over the
whole tables.  Double outputs are rounded to ``OUT_DIGITS`` so results can be
compared with an independent engine whose summation order differs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.plans import params as P
from rankfold.plans import benchmarks as B
from rankfold.operators import indexing, reshape, sequences, stats
from rankfold.operators.indexing import staged
from rankfold.session import checkpoint_dir, delete_at_exit
from rankfold.streaming.shards import numbered, shard_rows, write_slices
from rankfold.operators.split import split_flat, split_read, split_sequences
from rankfold.operators.metrics import evaluate, ranked_from_lists
from rankfold.operators.ranking import dot_product_top_k, global_top_k, pad_with_zero_scores
from rankfold.recommenders.random import random_draws, random_ranked
from rankfold.recommenders import bpr, embedding
from rankfold.recommenders import factorization as mf
from rankfold.recommenders import itemknn
from rankfold.recommenders import popularity as pop
from rankfold.recommenders import sparse_inverse
from rankfold.recommenders import sparse_linear as sl
from rankfold.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def round_doubles(df: DataFrame, digits: int = P.OUT_DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(cols)


def register(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))
        QUERIES[name].__name__ = name
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ---------------------------------------------------------------- inputs

def inter_split(spark, sf_dir, val_size=P.INTER_VAL_SIZE, drop_unseen_items=False):
    return split_read(inter_events(spark, sf_dir), P.INTER_TEST_TS, val_size, P.INTER_GAP,
                      drop_unseen_items=drop_unseen_items)


def inter_events(spark, sf_dir):
    """Reader of a range of time of the interactions log."""
    return lambda **span: adapters.interactions(spark, sf_dir, **span)


def me_split(spark, sf_dir, val_size=0, drop_unseen_items=False, releases=False):
    return split_read(lambda **span: adapters.multi_event(spark, sf_dir, releases=releases, **span), P.ME_TEST_TS, val_size,
                      P.ME_GAP, drop_unseen_items=drop_unseen_items)


def knn_split(spark, sf_dir):
    """Refit split of the one event kind that item models learn from."""
    return split_read(knn_events(spark, sf_dir), P.ME_TEST_TS, 0, P.ME_GAP)


def knn_events(spark, sf_dir):
    return lambda **span: adapters.multi_event(spark, sf_dir, **span).filter(F.col("event_type") == P.KNN_KIND)


# ---------------------------------------------------------------- split

@register("split_train")
def q_split_train(spark, sf_dir):
    """T1 train segment of the interactions log (with validation window)."""
    return inter_split(spark, sf_dir).train


@register("split_val")
def q_split_val(spark, sf_dir):
    """T1 validation segment, train users only."""
    return inter_split(spark, sf_dir).val


@register("split_test")
def q_split_test(spark, sf_dir):
    """T1 test segment, train users only."""
    return inter_split(spark, sf_dir).test


@register("split_test_seen_items")
def q_split_test_seen_items(spark, sf_dir):
    """T1 + T3 on the multi-event log with releases: test events of train users on train items."""
    return me_split(spark, sf_dir, val_size=P.ME_VAL_SIZE, drop_unseen_items=True, releases=True).test


# ---------------------------------------------------------------- popularity

@register("popularity_count")
def q_popularity_count(spark, sf_dir):
    """A1: events per item in the refit train segment."""
    return pop.item_counts(inter_split(spark, sf_dir, val_size=0).train)


@register("popularity_decayed")
def q_popularity_decayed(spark, sf_dir):
    """A2/A3: decayed item score, hour = 720."""
    return pop.item_scores(inter_split(spark, sf_dir, val_size=0).train, P.INTER_TOPK_HOUR)


@register("popularity_topk")
def q_popularity_topk(spark, sf_dir):
    """O2: global top 100 by decayed score."""
    scores = pop.item_scores(inter_split(spark, sf_dir, val_size=0).train, P.INTER_TOPK_HOUR)
    return global_top_k(scores, 100, round_digits=P.SCORE_DIGITS)


@register("popularity_grid")
def q_popularity_grid(spark, sf_dir):
    """H1: every hour of the grid evaluated on validation in one job."""
    ev = inter_events(spark, sf_dir)
    return B.popularity_grid(ev, P.INTER_TEST_TS, P.INTER_VAL_SIZE, P.INTER_GAP, P.INTER_HOURS,
                             P.REPORT_METRICS, P.SCORE_DIGITS)


@register("popularity_eval")
def q_popularity_eval(spark, sf_dir):
    """R2 protocol: best hour on validation by ndcg@100, refit, report on test."""
    ev = inter_events(spark, sf_dir)
    return B.popularity_benchmark(ev, interaction="likes", test_ts=P.INTER_TEST_TS, val_size=P.INTER_VAL_SIZE,
                                  gap=P.INTER_GAP, hours=P.INTER_HOURS, validation_metric=P.VALIDATION_METRIC,
                                  report_metrics=P.REPORT_METRICS, round_digits=P.SCORE_DIGITS)


# ---------------------------------------------------------------- reshape and sequences

ME_ORDER = ["timestamp", "event_ord", "event_id"]


def me_sequences(spark, sf_dir, layout="columns", releases=False, max_events_per_row=None):
    me = adapters.multi_event(spark, sf_dir, releases=releases)
    return reshape.to_sequences(me, layout, order_cols=ME_ORDER, max_events_per_row=max_events_per_row)


@register("multi_event")
def q_multi_event(spark, sf_dir):
    """U1 + O1: union of the five single-kind tables in total (uid, time, kind) order."""
    tables = adapters.event_kind_tables(spark, sf_dir)
    ordered = reshape.sort_events(reshape.union_event_kinds(tables), tie_cols=["event_id"])
    # the position in the written order, so that the order itself is compared
    return numbered(ordered, "position")


@register("seq_columns")
def q_seq_columns(spark, sf_dir):
    """A4: one row per user, every other column an aligned, time-ordered list."""
    return me_sequences(spark, sf_dir, "columns")


@register("seq_structs")
def q_seq_structs(spark, sf_dir):
    """A5: one row per user with a time-ordered list of event structs."""
    return me_sequences(spark, sf_dir, "structs")


@register("seq_split_val")
def q_seq_split_val(spark, sf_dir):
    """Validation lists of the sequential split."""
    return split_sequences(me_sequences(spark, sf_dir), P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP).val


@register("seq_split_test")
def q_seq_split_test(spark, sf_dir):
    """Test lists of the sequential split."""
    return split_sequences(me_sequences(spark, sf_dir), P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP).test


@register("seq_split_test_seen_items")
def q_seq_split_test_seen_items(spark, sf_dir):
    """T4: test lists with items unseen in train removed inside the lists."""
    return split_sequences(me_sequences(spark, sf_dir, releases=True), P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP,
                           drop_unseen_items=True).test


@register("split_equivalence")
def q_split_equivalence(spark, sf_dir):
    """T5: rows of each segment of the flat split, and how many only one of the flat
    and the sequential split has (unseen items dropped in both)."""
    flat = me_split(spark, sf_dir, P.ME_VAL_SIZE, True, True)
    lists = split_sequences(me_sequences(spark, sf_dir, releases=True), P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP, drop_unseen_items=True)
    out = None
    for name, a, b in zip(("train", "val", "test"), flat, lists):
        b = reshape.explode_sequences(b).select(a.columns)
        # rows that are not equally often in both: one aggregation over their union
        rows = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
        left = rows.groupBy(*a.columns).agg(F.sum("_n").alias("d"), F.count(F.when(F.col("_n") > 0, 1)).alias("flat"))
        zero = F.lit(0)
        part = left.agg(F.sum("flat").alias("rows"), F.sum(F.greatest("d", zero)).cast("int").alias("only_flat"),
                        F.sum(F.greatest(-F.col("d"), zero)).cast("int").alias("only_lists")).select(F.lit(name).alias("segment"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- statistics

@register("recom_ratio")
def q_recom_ratio(spark, sf_dir):
    """Recommended share of events per kind."""
    return stats.recom_ratio(adapters.multi_event(spark, sf_dir))


@register("history_quantiles")
def q_history_quantiles(spark, sf_dir):
    """Nearest-rank q50/q90/q95 of events per user, per kind."""
    return stats.history_len_stats(adapters.multi_event(spark, sf_dir))


@register("dataset_stats")
def q_dataset_stats(spark, sf_dir):
    """Distinct users and items, events per kind."""
    return stats.dataset_stats(adapters.multi_event(spark, sf_dir))


@register("history_histogram")
def q_history_histogram(spark, sf_dir):
    """100-bin histogram of user history lengths (sequential log)."""
    return stats.user_history_histogram(me_sequences(spark, sf_dir))


@register("history_log_histogram")
def q_history_log_histogram(spark, sf_dir):
    """40-bin histogram of log10 history lengths."""
    return stats.user_history_histogram(me_sequences(spark, sf_dir), log10=True)


@register("history_markers")
def q_history_markers(spark, sf_dir):
    """Max, q50, q90, q95 of user history lengths."""
    return stats.histogram_markers(stats.history_lengths(me_sequences(spark, sf_dir)), "value")


@register("item_log_counts")
def q_item_log_counts(spark, sf_dir):
    """Events per item and log10."""
    return stats.item_interactions(adapters.multi_event(spark, sf_dir))


@register("item_log_histogram")
def q_item_log_histogram(spark, sf_dir):
    """30-bin histogram of log10 events per item (interactions log)."""
    return stats.item_interactions_histogram(adapters.interactions(spark, sf_dir))


# ---------------------------------------------------------------- indexing

@register("dense_index")
def q_dense_index(spark, sf_dir):
    """Users numbered 0.. in id order, without a global window."""
    return indexing.dense_index(adapters.interactions(spark, sf_dir), "uid")


# ---------------------------------------------------------------- random recommender and metrics

def random_lists(spark, sf_dir, seed=P.RANDOM_SEED):
    """The split, the random lists (folded, as indices), and the dictionary of these."""
    s = split_flat(B.written_log(inter_events(spark, sf_dir), "likes"), P.INTER_TEST_TS, 0, P.INTER_GAP)
    items = indexing.dense_index(s.train, "item_id", 0, "item_idx")
    return s, random_draws(s.train, items, 100, seed), items


def indices(items):
    """The items of a dictionary as ``evaluate`` counts them for lists of indices."""
    return items.select(F.col("item_idx").alias("item_id"))


@register("random_topk")
def q_random_topk(spark, sf_dir):
    """100 hashed uniform draws per train user."""
    return random_ranked(inter_split(spark, sf_dir, val_size=0).train, 100, P.RANDOM_SEED)


@register("metrics_all")
def q_metrics_all(spark, sf_dir):
    """M1-M6 at 10/50/100 for the random lists against the test events."""
    s, draws, items = random_lists(spark, sf_dir)
    return evaluate(draws, s.test, P.ALL_METRICS, indices(items), item_dict=items)


@register("mrr_compat")
def q_mrr_compat(spark, sf_dir):
    """MRR where a user without a hit scores 1 (all-zero argmax)."""
    s, draws, items = random_lists(spark, sf_dir)
    return evaluate(draws, s.test, ["mrr@10", "mrr@50", "mrr@100"], mrr_compat=True, item_dict=items)


@register("recall_distinct_targets")
def q_recall_distinct_targets(spark, sf_dir):
    """Recall and NDCG where repeated target events count once."""
    s, draws, items = random_lists(spark, sf_dir)
    return evaluate(draws, s.test, ["recall@10", "recall@100", "ndcg@10", "ndcg@100"], dedup_targets=True, item_dict=items)


@register("ndcg_per_user")
def q_ndcg_per_user(spark, sf_dir):
    """D3: NDCG as the mean of per-user ratios."""
    s, draws, items = random_lists(spark, sf_dir)
    return evaluate(draws, s.test, ["ndcg@10", "ndcg@50", "ndcg@100"], ndcg_per_user=True, item_dict=items)


@register("coverage_target_users")
def q_coverage_target_users(spark, sf_dir):
    """M7: coverage over the lists of target users only."""
    s, draws, items = random_lists(spark, sf_dir)
    return evaluate(draws, s.test, ["coverage@10", "coverage@50", "coverage@100"],
                    indices(items), coverage_target_users=True, item_dict=items)


@register("random_eval")
def q_random_eval(spark, sf_dir):
    """R1 protocol: report metrics averaged over two seeded runs."""
    return B.random_benchmark(inter_events(spark, sf_dir), test_ts=P.INTER_TEST_TS, gap=P.INTER_GAP,
                              num_repeats=P.RANDOM_REPEATS, seed=P.RANDOM_SEED, k=100)


# ---------------------------------------------------------------- embeddings

@register("embedding_topk")
def q_embedding_topk(spark, sf_dir):
    """Top 100 items per user by dot product (users = every tenth vector)."""
    users, items = adapters.embedding_tables(spark, sf_dir)
    top = dot_product_top_k(users, items, 100, round_digits=P.SCORE_DIGITS)
    # scores are cut to 9 digits for ranking; as whole numbers they are not rounded twice
    return top.select("uid", "rank", "item_id", F.round(F.col("score") * 10 ** P.SCORE_DIGITS).cast("long").alias("score_e9"))


# ---------------------------------------------------------------- ItemKNN (multi-event adapter)

@register("user_item_weights")
def q_user_item_weights(spark, sf_dir):
    """Decayed (user, item) weights, hour = 24, zeros eliminated."""
    from rankfold.functions.exprs import decay_tau
    return itemknn.user_item_weights(knn_split(spark, sf_dir).train, decay_tau(P.ME_KNN_HOUR))


@register("item_cooccurrence")
def q_item_cooccurrence(spark, sf_dir):
    """Item x item sums S (user-normalised) and G over shared users."""
    return itemknn.cooccurrence(itemknn.user_item_counts(knn_split(spark, sf_dir).train), "user")


@register("itemknn_topk")
def q_itemknn_topk(spark, sf_dir):
    """ItemKNN top 20 per train user (norm as in the reference code)."""
    return itemknn.itemknn_ranked(knn_split(spark, sf_dir).train, P.ME_KNN_HOUR, P.KNN_TOP_K, "user",
                                  round_digits=P.SCORE_DIGITS)


@register("itemknn_topk_cosine")
def q_itemknn_topk_cosine(spark, sf_dir):
    """ItemKNN top 20 with item-normalised (cosine) item vectors."""
    return itemknn.itemknn_ranked(knn_split(spark, sf_dir).train, P.ME_KNN_HOUR, P.KNN_TOP_K, "item",
                                  round_digits=P.SCORE_DIGITS)


@register("itemknn_topk_last")
def q_itemknn_topk_last(spark, sf_dir):
    """hour = 0, only each user's last-timestamp events weigh."""
    return itemknn.itemknn_ranked(knn_split(spark, sf_dir).train, 0.0, P.KNN_TOP_K, "user", round_digits=P.SCORE_DIGITS)


@register("itemknn_topk_100")
def q_itemknn_topk_100(spark, sf_dir):
    """ItemKNN top 100 on the interactions log, whose catalogue is many times that."""
    lists = itemknn.itemknn_ranked(inter_split(spark, sf_dir, val_size=0).train, P.INTER_KNN_HOUR, 100, "user",
                                   round_digits=P.SCORE_DIGITS)
    # the nine digits that rank, as whole numbers, cut to six: not rounded twice
    millionths = F.floor(F.round(F.col("score") * 10 ** P.SCORE_DIGITS).cast("long") / F.lit(1000)).cast("long")
    return lists.select("uid", "rank", "item_id", millionths.alias("score_e6"))


@register("scoreless_lists")
def q_scoreless_lists(spark, sf_dir):
    """M9: lists of items without scores get default ones from the longest list's length down."""
    lists = itemknn.itemknn_ranked(knn_split(spark, sf_dir).train, 1.0, P.KNN_TOP_K, "user", round_digits=P.SCORE_DIGITS)
    folded = lists.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return ranked_from_lists(folded.select("uid", F.col("l.item_id").alias("item_ids")))


@register("itemknn_eval")
def q_itemknn_eval(spark, sf_dir):
    """R3 + H1 protocol on the listens of the multi-event log: hour chosen on validation, report on test."""
    return B.itemknn_benchmark(knn_events(spark, sf_dir), test_ts=P.ME_TEST_TS, val_size=P.ME_VAL_SIZE,
                               gap=P.ME_GAP, hours=P.ME_KNN_HOURS, validation_metric=P.VALIDATION_METRIC,
                               report_metrics=P.REPORT_METRICS, round_digits=P.SCORE_DIGITS)


# ---------------------------------------------------------------- factorisation (interactions log)

@register("als_topk")
def q_als_topk(spark, sf_dir):
    """Implicit ALS factors (rank 64, 100 iterations), top 100 by dot product."""
    s = inter_split(spark, sf_dir, val_size=0)
    uf, itf = mf.als_factors(s.train, rank=64, reg=0.01, iterations=100, seed=42)
    return dot_product_top_k(uf, itf, 100)


@register("als_eval")
def q_als_eval(spark, sf_dir):
    """R4 + H2 + H3: ten sampled trials on validation, best refit with seeds 41/42/43, mean test report."""
    return B.factorization_benchmark(inter_events(spark, sf_dir), model="als", test_ts=P.INTER_TEST_TS,
                                     val_size=P.INTER_VAL_SIZE, gap=P.INTER_GAP, rank=64)


@register("als_residual")
def q_als_residual(spark, sf_dir):
    """Each user's relative residual of the last half-step's normal equations (three
    digits: zero for solved ones)."""
    train = inter_split(spark, sf_dir, val_size=0).train
    indexed = mf.indexed_pairs(train)
    uf, itf = mf.als_factors(train, rank=16, reg=0.05, iterations=5, seed=42, indexed=indexed)
    return mf.als_residuals(train, uf, itf, 0.05, indexed=indexed).select("uid", "n_items", (F.round("residual", 3) + F.lit(0.0)).alias("residual"))


@register("als_lists")
def q_als_lists(spark, sf_dir):
    """Per user, the length of its ALS list, distinct items, whether scores descend
    (ties by item), items of the catalogue that beat the list's last without being in it,
    and the largest difference between a score and the product of the factors (six digits)."""
    train = inter_split(spark, sf_dir, val_size=0).train
    uf, itf = (staged(f, "als-factors") for f in mf.als_factors(train, rank=16, reg=0.05, iterations=5, seed=42))
    lists = staged(dot_product_top_k(uf, itf, 100, round_digits=P.SCORE_DIGITS), "als-lists")
    return embedding.list_facts(uf, itf, lists)


@register("bpr_triples")
def q_bpr_triples(spark, sf_dir):
    """One verified negative per distinct positive pair (hashed draws)."""
    return mf.bpr_triples(inter_split(spark, sf_dir, val_size=0).train, seed=P.RANDOM_SEED, attempts=16)


@register("bpr_topk")
def q_bpr_topk(spark, sf_dir):
    """BPR factors by distributed mini-batch steps (100 passes), top 100 by dot product."""
    s = inter_split(spark, sf_dir, val_size=0)
    uf, itf = bpr.bpr_fit(s.train, rank=64, learning_rate=0.05, reg=0.01, iterations=P.BPR_PASSES, seed=42)
    return dot_product_top_k(uf, itf, 100)


@register("bpr_trials")
def q_bpr_trials(spark, sf_dir):
    """Ten trials of a small BPR (rank 2, two blocks, large mini-batches) carried
    through the same jobs, the worse half stopped after the first pass, and the choice."""
    s = inter_split(spark, sf_dir)
    rows = B.bpr_trials(s.train, s.val, P.bpr_small_trials(), P.VALIDATION_METRIC, compare_at=[1, 2], round_digits=P.SCORE_DIGITS,
                        rank=2, seed=P.RANDOM_SEED, batch=P.BPR_SMALL_BATCH, blocks=2, merge_every=1)
    names = ["trial", "learning_rate", "regularization", "passes", "value", "chosen"]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows],
                                 "trial int, learning_rate double, regularization double, passes int, value double, chosen boolean")


@register("bpr_factors")
def q_bpr_factors(spark, sf_dir):
    """The factors of that small BPR after two passes, one setting."""
    fit = bpr.BprTrials(inter_split(spark, sf_dir).train, P.bpr_small_trials()[:1], rank=2, seed=P.RANDOM_SEED,
                        batch=P.BPR_SMALL_BATCH, blocks=2, merge_every=1)
    fit.advance(2)
    users, items = fit.tables(0)
    both = users.select(F.lit("user").alias("side"), "id", "embedding").unionByName(items.select(F.lit("item").alias("side"), "id", "embedding"))
    return both.select("side", "id", F.col("embedding")[0].alias("v0"), F.col("embedding")[1].alias("v1"))


# ---------------------------------------------------------------- sequence-model data, shards

def seq_data(spark, sf_dir, max_seq_len=P.SEQ_MAX_LEN):
    return sequences.prepare_sequences(me_sequences(spark, sf_dir), "listens", test_ts=P.ME_TEST_TS, val_size=0,
                                       gap=P.ME_GAP, max_seq_len=max_seq_len)


@register("seq_prepare_train")
def q_seq_prepare_train(spark, sf_dir):
    """Listen lists, item index from 1, last 50 train events as indices."""
    return seq_data(spark, sf_dir, P.SEQ_LIST_LEN).train


@register("seq_prepare_test")
def q_seq_prepare_test(spark, sf_dir):
    """Held-out lists of train users as item indices."""
    return seq_data(spark, sf_dir).test


@register("next_item_rows")
def q_next_item_rows(spark, sf_dir):
    """Shifted input/positive lists and hashed negatives."""
    d = seq_data(spark, sf_dir, P.SEQ_LIST_LEN)
    return sequences.next_item_rows(d.train, d.num_items(), P.SEQ_LIST_LEN, P.RANDOM_SEED)


@register("eval_rows")
def q_eval_rows(spark, sf_dir):
    """Last train items and held-out items of users present in both."""
    d = seq_data(spark, sf_dir, P.SEQ_LIST_LEN)
    return sequences.eval_rows(d.train, d.test, P.SEQ_LIST_LEN)


@register("seq_batches")
def q_seq_batches(spark, sf_dir):
    """Evaluation rows collated into batches of 16 (flat ids + lengths)."""
    d = seq_data(spark, sf_dir, P.SEQ_LIST_LEN)
    rows = sequences.eval_rows(d.train, d.test, P.SEQ_LIST_LEN)
    return sequences.flatten_batches(rows, ["item_id_train", "item_id_valid"], 16)


@register("train_batches")
def q_train_batches(spark, sf_dir):
    """Training rows (inputs, positives, negatives) collated into batches of 16."""
    d = seq_data(spark, sf_dir, P.SEQ_LIST_LEN)
    rows = sequences.next_item_rows(d.train, d.num_items(), P.SEQ_LIST_LEN, P.RANDOM_SEED)
    return sequences.flatten_batches(rows, ["item_ids", "positive_ids", "negative_ids"], 16)


@register("seq_positions")
def q_seq_positions(spark, sf_dir):
    """Train items with position and reverse position (newest = 0)."""
    return sequences.position_table(seq_data(spark, sf_dir, P.SEQ_LIST_LEN).train)


@register("seq_split_chunked")
def q_seq_split_chunked(spark, sf_dir):
    """T2/T4 on histories cut into bounded rows: test rows with unseen items removed."""
    seq = me_sequences(spark, sf_dir, releases=True, max_events_per_row=P.SEQ_CHUNK)
    return split_sequences(seq, P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP, drop_unseen_items=True).test


@register("seq_prepare_chunked")
def q_seq_prepare_chunked(spark, sf_dir):
    """R9/J6/O8 on histories cut into bounded rows: the same train lists as from whole rows."""
    seq = me_sequences(spark, sf_dir, max_events_per_row=P.SEQ_CHUNK)
    return sequences.prepare_sequences(seq, "listens", test_ts=P.ME_TEST_TS, val_size=0, gap=P.ME_GAP,
                                       max_seq_len=P.SEQ_MAX_LEN).train


SHARD_ORDER = ["uid", "timestamp", "l_orderkey", "l_linenumber", "item_id", "is_organic", "played_ratio_pct"]


@register("shards")
def q_shards(spark, sf_dir):
    """Global row positions under (uid, time, order line) and 8 contiguous shards."""
    # every column takes part in the order: (order, line) is not unique in the
    # test data, and rows equal in all columns are interchangeable
    return shard_rows(adapters.interactions(spark, sf_dir), SHARD_ORDER, P.SHARDS)


@register("slices")
def q_slices(spark, sf_dir):
    """Consecutive slices under the same order, dealt to folders in one pass and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/slices-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return write_slices(adapters.interactions(spark, sf_dir), SHARD_ORDER, P.SLICE_ROWS, path)


# ---------------------------------------------------------------- sparse linear model

@register("unknown_item_bucket")
def q_unknown_item_bucket(spark, sf_dir):
    """Test counts over train dictionaries, unseen items in a spare bucket."""
    s = me_split(spark, sf_dir, val_size=P.ME_VAL_SIZE, releases=True)
    return sl.unknown_item_counts(s.train, s.test)


@register("sparse_linear_topk")
def q_sparse_linear_topk(spark, sf_dir):
    """Sparse inverse on the interactions log, lists of 150 for the test users, padded."""
    s = inter_split(spark, sf_dir, val_size=0)
    lists = sparse_inverse.SparseInverse(s.train, density=P.SPARSE_LOG_DENSITY).ranked(s.test.select("uid"), 150, P.SCORE_DIGITS, pad=True)
    # the nine digits that rank, as whole numbers, cut to four: not rounded twice
    cut = F.floor(F.round(F.col("score") * 10 ** P.SCORE_DIGITS).cast("long") / F.lit(100_000)).cast("long")
    return lists.select("uid", "rank", "item_id", cut.alias("score_e4"))


@register("sparse_inverse_residual")
def q_sparse_inverse_residual(spark, sf_dir):
    """Entries of every item's column of the sparse inverse, and its squared residual."""
    return sparse_inverse.SparseInverse(inter_split(spark, sf_dir, val_size=0).train, density=P.SPARSE_LOG_DENSITY).residuals()


@register("sparse_linear_eval")
def q_sparse_linear_eval(spark, sf_dir):
    """R6 protocol on the multi-event log: report metrics for the test users."""
    return B.sparse_linear_benchmark(knn_events(spark, sf_dir), test_ts=P.ME_TEST_TS, gap=P.ME_GAP,
                                     density=P.SPARSE_DENSITY, round_digits=P.SCORE_DIGITS)


# ---------------------------------------------------------------- smaller building blocks

@register("listens_threshold")
def q_listens_threshold(spark, sf_dir):
    """Interactions with played_ratio_pct >= 50."""
    from rankfold.sources.events import listen_threshold
    return listen_threshold(adapters.interactions(spark, sf_dir), "listens")


@register("targets")
def q_targets(spark, sf_dir):
    """Long-form test targets (uid, item_id, multiplicity)."""
    from rankfold.operators.metrics import targets_from_events
    return targets_from_events(inter_split(spark, sf_dir, val_size=0).test)


@register("binary_pairs")
def q_binary_pairs(spark, sf_dir):
    """Distinct (user, item) train pairs with rating 1."""
    return mf.binary_pairs(inter_split(spark, sf_dir, val_size=0).train)


@register("binary_pairs_listens")
def q_binary_pairs_listens(spark, sf_dir):
    """Pairs of the listens past the threshold, pruned to user, item and time."""
    from rankfold.sources.events import listen_threshold

    def read(**span):
        return listen_threshold(adapters.interactions(spark, sf_dir, **span), "listens").select("uid", "item_id", "timestamp")
    return mf.binary_pairs(split_read(read, P.INTER_TEST_TS, 0, P.INTER_GAP).train)


@register("item_index_from_one")
def q_item_index_from_one(spark, sf_dir):
    """Items of the multi-event log numbered from 1 (0 = padding)."""
    return indexing.dense_index(adapters.multi_event(spark, sf_dir), "item_id", 1, "item_idx")


@register("seq_listen_lists")
def q_seq_listen_lists(spark, sf_dir):
    """Item and time lists kept where played_ratio_pct >= 50; empty users dropped."""
    return sequences.listen_lists(me_sequences(spark, sf_dir))


@register("user_history_lengths")
def q_user_history_lengths(spark, sf_dir):
    """Events per user from the sequential layout, and log10."""
    lengths = stats.history_lengths(me_sequences(spark, sf_dir))
    return lengths.select("uid", F.col("value").alias("n"), F.log10("value").alias("log_n"))


@register("itemknn_topk_padded")
def q_itemknn_topk_padded(spark, sf_dir):
    """ItemKNN lists (hour = 1) filled to 100 with zero-score items, lowest ids first."""
    tr = knn_split(spark, sf_dir).train
    ranked = itemknn.itemknn_ranked(tr, 1.0, 100, "user", round_digits=P.SCORE_DIGITS)
    return pad_with_zero_scores(ranked, tr.select("item_id"), 100, users=tr.select("uid"))


@register("popularity_eval_listens")
def q_popularity_eval_listens(spark, sf_dir):
    """R2 protocol on listens: threshold played_ratio_pct >= 50 first."""
    ev = inter_events(spark, sf_dir)
    return B.popularity_benchmark(ev, interaction="listens", test_ts=P.INTER_TEST_TS, val_size=P.INTER_VAL_SIZE,
                                  gap=P.INTER_GAP, hours=P.INTER_HOURS, validation_metric=P.VALIDATION_METRIC,
                                  report_metrics=P.REPORT_METRICS, round_digits=P.SCORE_DIGITS)


@register("seq_columns_chunked")
def q_seq_columns_chunked(spark, sf_dir):
    """A4, bounded rows: histories cut into consecutive chunks of at most 16 events."""
    me = adapters.multi_event(spark, sf_dir)
    return reshape.to_sequences(me, "columns", order_cols=ME_ORDER, max_events_per_row=P.SEQ_CHUNK)
