"""What protocols and list metrics read again and again is written once, and gives the same."""

import re

import pytest

from rankfold.operators.indexing import dense_index
from rankfold.operators.metrics import evaluate
from rankfold.plans import benchmarks as B
from rankfold.plans import params as P
from rankfold.plans import queries as Q
from rankfold.recommenders.random import random_draws, random_ranked
from small_tables import SF_SMALL

METRICS = ["recall@3", "precision@5", "mrr@5", "dcg@5", "ndcg@3"]


@pytest.fixture()
def events(spark):
    """Items repeat, one is null, targets hold items that train has not."""
    train = spark.createDataFrame([(u, (u * 7 + j * j) % 23 if j else None, 0) for u in range(40) for j in range(4)], "uid long, item_id long, timestamp long")
    test = spark.createDataFrame([(u, (u * 5 + j) % 30 if j < 9 else None) for u in range(0, 40, 2) for j in range(10)] * 2, "uid long, item_id long")
    return train, test


@pytest.mark.parametrize("kw", [{}, {"mrr_compat": True}, {"dedup_targets": True}, {"ndcg_per_user": True}, {"strict": True, "width": 8}])
def test_folded_lists_of_indices_score_like_their_rows(spark, events, kw):
    train, test = events
    items = dense_index(train, "item_id", 0, "item_idx")
    names = METRICS + ["coverage@4", "coverage@8"]
    rows = evaluate(random_ranked(train, 8, 3, item_dict=items), test, names, train.select("item_id"), **kw)
    lists = evaluate(random_draws(train, items, 8, 3), test, names, items.selectExpr("item_idx AS item_id"), item_dict=items, **kw)
    values = lambda df: {(r.metric, r.k): round(r.value, 9) for r in df.collect()}
    assert values(rows) == values(lists) and len(values(rows)) == 7


def test_an_item_may_be_in_a_list_twice(spark):
    lists = spark.createDataFrame([(1, [7, 5, 7]), (2, [5, 5, 5])], "uid long, item_ids array<long>")
    targets = spark.createDataFrame([(1, 7), (2, 9)], "uid long, item_id long")
    got = {r.k: r.value for r in evaluate(lists, targets, ["precision@2", "precision@3"]).collect()}
    assert got == {2: 0.25, 3: pytest.approx(1 / 3)}


def test_folded_lists_beyond_their_width_fail(spark):
    lists = spark.createDataFrame([(1, [7, 5, 9])], "uid long, item_ids array<long>")
    targets = spark.createDataFrame([(1, 7)], "uid long, item_id long")
    with pytest.raises(Exception, match="beyond the lists' width of 2 for user 1"):
        evaluate(lists, targets, ["recall@2"], strict=True, width=2).collect()
    with pytest.raises(ValueError):
        evaluate(lists, targets, ["recall@5"], strict=True, width=3)


def scans(df, table: str) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[[^\]]*" + table, plan))


def test_random_lists_meet_targets_before_they_are_unfolded(spark):
    """k rows a user are never joined with the dictionary, nor dealt out."""
    s, draws, items = Q.random_lists(spark, SF_SMALL)
    report = evaluate(draws, s.test, ["mrr@10"], item_dict=items)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and scans(report, "l_orderkey") == 0


def test_protocols_join_the_log_once(spark):
    log = B.written_log(Q.inter_events(spark, SF_SMALL), "likes")
    report = B.popularity_report(log, P.INTER_TEST_TS, P.INTER_GAP, 720.0, P.REPORT_METRICS)
    assert scans(report, "l_orderkey") == 0 and report.count() == len(P.REPORT_METRICS)
