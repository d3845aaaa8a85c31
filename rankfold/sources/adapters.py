"""Adapters from the driver's test tables to the event-log schema.

``interactions``  orders join lineitem: one event per order line.
``multi_event``   the ``events`` table recast as a five-kind multi-event log.
``embedding_tables`` user and item vectors from the ``embeddings`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.functions.exprs import seconds_since, within_seconds

# FIXED VALUES: mapping of the test table's event types onto event kinds.
EVENT_TYPE_MAP = {"view": "listen", "error": "dislike", "click": "like", "purchase": "undislike", "signup": "unlike"}
# track length given to every listen of the adapter, seconds
ADAPTER_TRACK_LENGTH = 180
# where the tables' seconds begin
ORDER_EPOCH, EVENT_EPOCH = "1970-01-01 00:00:00", "2024-01-01 00:00:00"
# one in so many items is released anew every so many days, its ids so far apart
RELEASE_STEP, RELEASE_DAYS, RELEASE_IDS = 4, 3, 1000
# every tenth vector of the embedding table is a user, the others are items
EMBEDDING_USER_STEP = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """uid, item_id, timestamp, is_organic, played_ratio_pct, l_orderkey, l_linenumber.

    ``since`` and ``until`` (seconds, half-open) are tested on the order date as it is
    stored, below the join and in the scan.

    The join key is the order key on both sides; the order side is pruned to
    three columns before the shuffle.  Lines of one order share a timestamp,
    so (l_orderkey, l_linenumber) is carried as the tie-break order.
    """
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.where(within_seconds("o_orderdate", ORDER_EPOCH, since, until))
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "inner")
    return joined.select(
        F.col("o_custkey").cast("long").alias("uid"),
        F.col("l_partkey").cast("long").alias("item_id"),
        seconds_since(F.col("o_orderdate"), ORDER_EPOCH).alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.lit(1)).cast("short").alias("is_organic"),
        (F.col("l_quantity") * 2).cast("long").alias("played_ratio_pct"),
        F.col("l_orderkey").cast("long").alias("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
    )


def event_kind_order(kind: str) -> int:
    return C.EVENT_KINDS.index(kind)


def multi_event(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None,
                releases: bool = False) -> DataFrame:
    """uid, timestamp, item_id, is_organic, played_ratio_pct, track_length_seconds,
    event_type, event_ord, event_id -- the flat multi-event log of the adapter.

    ``since`` and ``until`` (seconds, half-open) are tested on the stored time.  With
    ``releases`` every ``RELEASE_STEP``-th item comes out anew every ``RELEASE_DAYS``
    days under an id of its own, so later segments hold items that train never saw."""
    ev = _table(spark, sf_dir, "events").where(within_seconds("ts", EVENT_EPOCH, since, until))
    seconds = seconds_since(F.col("ts"), EVENT_EPOCH)
    item = F.get_json_object("props", "$.k").cast("long")
    if releases:
        release = F.floor(seconds / F.lit(RELEASE_DAYS * C.DAY_SECONDS)).cast("long")
        item = F.when(item % RELEASE_STEP == 0, item + RELEASE_IDS * (release + 1)).otherwise(item)
    # an unknown type fails the query rather than losing its events
    unknown = F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null"))))
    kind = unknown.cast("string")
    order = unknown.cast("int")
    for src, dst in EVENT_TYPE_MAP.items():
        kind = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(kind)
        order = F.when(F.col("event_type") == src, F.lit(event_kind_order(dst))).otherwise(order)
    is_listen = F.col("event_type") == "view"
    return ev.select(
        F.col("user_id").cast("long").alias("uid"),
        seconds.alias("timestamp"),
        item.alias("item_id"),
        F.pmod(F.col("event_id"), F.lit(2)).cast("short").alias("is_organic"),
        F.when(is_listen, F.least(F.floor("value"), F.lit(100))).cast("long").alias("played_ratio_pct"),
        F.when(is_listen, F.lit(ADAPTER_TRACK_LENGTH)).cast("long").alias("track_length_seconds"),
        kind.alias("event_type"),
        order.alias("event_ord"),
        F.col("event_id").cast("long").alias("event_id"),
    )


def event_kind_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five single-kind tables as filters of the multi-event adapter.

    Non-listen kinds carry only the four base columns (plus the event id as a
    stable tie-break), as the reference's like/dislike files do.
    """
    me = multi_event(spark, sf_dir)
    out = {}
    for kind in C.EVENT_KINDS:
        part = me.filter(F.col("event_type") == kind)
        cols = ["uid", "timestamp", "item_id", "is_organic"]
        if kind == "listen":
            cols += ["played_ratio_pct", "track_length_seconds"]
        out[kind] = part.select(*cols, "event_id")
    return out


def embedding_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(users, items) as ``id LONG, embedding ARRAY<DOUBLE>``."""
    emb = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    is_user = F.col("id") % EMBEDDING_USER_STEP == 0
    users = emb.filter(is_user)
    items = emb.filter(~is_user)
    return users, items
