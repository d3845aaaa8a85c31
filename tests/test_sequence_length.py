"""The sequence queries keep fifty train events of a user, in the job and in its SQL."""

import pytest

from rankfold.operators.sequences import prepare_sequences
from rankfold.plans import oracle
from rankfold.plans import params as P
from rankfold.plans import queries as Q
from small_tables import SF_SMALL

NAMES = ["seq_prepare_train", "next_item_rows", "eval_rows", "seq_batches", "train_batches", "seq_positions"]


@pytest.fixture()
def long_history(spark, tmp_path):
    """One user with 60 train listens and one held out."""
    rows = [(i, 1, "2024-01-01 00:00:00", i * 600, "view", 90.0, '{"k": %d}' % i) for i in range(60)]
    rows.append((60, 1, "2024-01-01 00:00:00", 28 * 86400 + 60, "view", 90.0, '{"k": 3}'))
    events = spark.createDataFrame(rows, "event_id long, user_id long, base string, s long, event_type string, value double, props string")
    events = events.selectExpr("event_id", "user_id", "CAST(timestampadd(SECOND, s, CAST(base AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ) AS ts",
                               "event_type", "value", "props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_fifty_train_events_are_kept(spark, long_history):
    got = {n: Q.QUERIES[n](spark, long_history).collect() for n in NAMES}
    # items are numbered from 1 in id order: the last fifty of sixty
    assert got["seq_prepare_train"][0]["item_id"] == list(range(11, 61))
    assert got["next_item_rows"][0]["item_ids"] == list(range(11, 60)) and got["next_item_rows"][0]["positive_ids"] == list(range(12, 61))
    assert got["eval_rows"][0]["item_id_train"] == list(range(11, 61))
    assert got["seq_batches"][0]["item_id_train_lengths"] == [50]
    assert got["train_batches"][0]["item_ids_lengths"] == [49]
    assert sorted(r["pos"] for r in got["seq_positions"]) == list(range(50))


def test_sql_keeps_as_many():
    assert P.SEQ_LIST_LEN == 50
    sql = oracle.oracle_sql()
    assert all("rn <= 50" in sql[n] for n in NAMES) and "rn <= 6" in sql["seq_prepare_chunked"]


def test_the_log_is_folded_once(spark):
    """The item index, train and test read the written lists, not the log."""
    d = prepare_sequences(Q.me_sequences(spark, SF_SMALL), "listens", test_ts=P.ME_TEST_TS, val_size=0, gap=P.ME_GAP, max_seq_len=9)
    for df in (d.train, d.test, d.item_index):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation [" in plan or "LogicalRDD" in plan
        assert "event_type" not in plan
