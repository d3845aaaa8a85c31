"""File jobs end to end on a scratch layout: dataset discovery, statistics
export, JSON reports, embedding tables, padding, null checks, protocols."""

import json
import os
import tempfile

import pytest

from small_tables import SF_SMALL
from rankfold.operators.ranking import pad_with_zero_scores
from rankfold.operators.reshape import to_sequences
from rankfold.operators.sequences import prepare_sequences
from rankfold.plans import jobs
from rankfold.sources import adapters, events, sinks


def scratch():
    return tempfile.mkdtemp(prefix="rankfold-test-")


@pytest.fixture(scope="module")
def layout(spark):
    root = scratch()
    me = adapters.multi_event(spark, SF_SMALL)
    me.write.parquet(f"{root}/flat/50m/multi_event.parquet")
    me.write.parquet(f"{root}/flat/50m/likes.parquet")
    to_sequences(me, "columns", ["timestamp", "event_ord", "event_id"]).write.parquet(
        f"{root}/sequential/50m/multi_event.parquet")
    return root


def test_discover_and_stats_export(spark, layout):
    assert events.discover_sizes(spark, layout) == ["50m"]
    out = jobs.generate_dataset_stats(spark, layout, f"{layout}/stats")
    names = {os.path.basename(p) for p in out}
    assert {"recom_event_count.csv", "event_history_len.csv", "dataset_event_stats.csv"} <= names
    ds = spark.read.option("header", True).csv(f"{layout}/stats/50m/dataset_event_stats.csv").first()
    assert int(ds["users"]) == adapters.multi_event(spark, SF_SMALL).select("uid").distinct().count()
    with pytest.raises(ValueError):
        events.discover_sizes(spark, scratch())


def test_benchmark_report_json(spark, layout):
    out = f"{scratch()}/report"
    rep = jobs.run_benchmark(spark, "popularity", f"{layout}/flat", "50m", "likes", out_path=out,
                             test_ts=28 * 86400, val_size=2 * 86400, gap=1800, hours=[0, 24])
    assert rep.count() == 12
    text = spark.read.text(out).first()[0]
    report = json.loads(text)
    assert set(report) == {"ndcg", "dcg", "recall", "coverage"}
    assert set(report["ndcg"]) == {"10", "50", "100"}


def test_embeddings_roundtrip(spark):
    users, _ = adapters.embedding_tables(spark, SF_SMALL)
    p = f"{scratch()}/emb.parquet"
    sinks.save_embeddings(users, p)
    back = sinks.load_embeddings(spark, p)
    assert back.count() == users.count()
    assert back.schema["embedding"].dataType.simpleString() == "array<double>"


def test_pad_with_zero_scores(spark):
    ranked = spark.createDataFrame([(1, 1, 7, 2.0), (1, 2, 3, 1.0), (2, 1, 9, 1.0)],
                                   "uid long, rank int, item_id long, score double")
    items = spark.createDataFrame([(i,) for i in range(1, 11)], "item_id long")
    got = sorted(tuple(r) for r in pad_with_zero_scores(ranked, items, 4).collect())
    assert got == [(1, 1, 7, 2.0), (1, 2, 3, 1.0), (1, 3, 1, 0.0), (1, 4, 2, 0.0),
                   (2, 1, 9, 1.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0), (2, 4, 3, 0.0)]


def test_null_ids_fail(spark):
    df = spark.createDataFrame([(1, None, 5)], "uid long, item_id long, timestamp long")
    assert events.null_id_rows(df).count() == 1
    with pytest.raises(Exception):
        events.require_non_null_ids(df).collect()


def test_sequence_index_fit_on_train(spark):
    seq = spark.createDataFrame([(1, [10, 11, 12], [1, 2, 100]), (2, [13, 10], [3, 101])],
                                "uid long, item_id array<long>, timestamp array<long>")
    d = prepare_sequences(seq, test_ts=100, val_size=0, gap=10, max_seq_len=5, fit_on="train")
    idx = {r.item_id: r.item_idx for r in d.item_index.collect()}
    assert idx == {10: 1, 11: 2, 13: 3}
    test = {r.uid: r.item_id for r in d.test.collect()}
    assert test == {2: [1]}   # item 12 (unseen in train) dropped for user 1, who is left empty
    d_all = prepare_sequences(seq, test_ts=100, val_size=0, gap=10, max_seq_len=5)
    assert d_all.num_items().__class__.__name__ == "Column"
    assert {r.item_id for r in d_all.item_index.collect()} == {10, 11, 12, 13}


def test_cli_benchmark(spark, layout, capsys):
    from rankfold.__main__ import main
    main(["benchmark", "--model", "random", "--data_dir", f"{layout}/flat", "--size", "50m",
          "--interaction", "likes", "--report_metrics", "recall@10", "coverage@10",
          "--test_timestamp", str(28 * 86400), "--gap_size", "1800"])
    out = capsys.readouterr().out
    report = json.loads(out)
    assert set(report["metrics"]) == {"recall", "coverage"} and report["metrics"]["recall"]["10"] is not None
