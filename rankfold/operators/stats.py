"""Dataset statistics: recommended-event ratios, history-length quantiles,
one-row dataset summary, histograms with quantile markers.

Exact nearest-rank quantiles without a global sort: per-user counts are
first folded into a histogram ``(group, value, users)`` -- its size is the
number of distinct history lengths, not the number of users -- and the
quantile index is located with a running sum over that small histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recom_ratio(df: DataFrame) -> DataFrame:
    """(event_type, total, recom, ratio); kinds without recommended events drop out."""
    g = df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("is_organic") == 0, F.lit(1))).alias("recom"))
    return g.filter(F.col("recom") > 0).select(
        "event_type", "total", "recom", (F.col("recom") / F.col("total")).alias("ratio"))


def nearest_quantiles(values: DataFrame, value_col: str, qs: dict[str, float], by: list[str] | None = None,
                      weight_col: str | None = None) -> DataFrame:
    """Exact "nearest" quantiles of ``value_col`` per ``by`` group.

    The element at 0-based sorted position ``round((n - 1) * q)`` (half up).
    ``values`` may already be a histogram (``weight_col`` = multiplicity).
    """
    by = list(by or [])
    w = F.col(weight_col) if weight_col else F.lit(1)
    hist = values.groupBy(*by, value_col).agg(F.sum(w).cast("long").alias("_m"))
    win = Window.partitionBy(*by).orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy(*by)
    hist = hist.select(*by, value_col, F.sum("_m").over(win).alias("_cum"), F.sum("_m").over(tot).alias("_n"))
    aggs = []
    for name, q in qs.items():
        idx = F.round((F.col("_n") - 1).cast("double") * F.lit(float(q)))
        aggs.append(F.min(F.when(F.col("_cum") > idx, F.col(value_col))).alias(name))
    return hist.groupBy(*by).agg(*aggs) if by else hist.agg(*aggs)


def history_len_stats(df: DataFrame) -> DataFrame:
    """(event_type, median, q90, q95): per-kind quantiles of events per user."""
    per_user = df.groupBy("event_type", "uid").agg(F.count(F.lit(1)).alias("len"))
    q = nearest_quantiles(per_user, "len", {"median": 0.5, "q90": 0.9, "q95": 0.95}, by=["event_type"])
    return q.select("event_type", *[F.col(c).cast("int").alias(c) for c in ("median", "q90", "q95")])


def dataset_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: users, items, listens, likes, dislikes, unlikes, undislikes.

    ``approximate=True`` swaps the exact distinct counts for HyperLogLog++
    sketches (``approx_count_distinct``) -- the option for the largest logs.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    kinds = [("listens", "listen"), ("likes", "like"), ("dislikes", "dislike"),
             ("unlikes", "unlike"), ("undislikes", "undislike")]
    return df.agg(
        distinct("uid").cast("long").alias("users"),
        distinct("item_id").cast("long").alias("items"),
        *[F.count(F.when(F.col("event_type") == k, F.lit(1))).alias(name) for name, k in kinds])


def history_lengths(seq: DataFrame, log10: bool = False) -> DataFrame:
    """(uid, value): list length per user, or its log10."""
    v = F.size("item_id").cast("double")
    return seq.select("uid", (F.log10(v) if log10 else v).alias("value"))


def item_interactions(df: DataFrame) -> DataFrame:
    """(item_id, n, log_n): events per item and log10 of it."""
    return df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10(F.col("n")))


def histogram(values: DataFrame, value_col: str, bins: int) -> DataFrame:
    """Equal-width histogram (bin, bin_lo, bin_hi, n) over [min, max] with every bin
    listed, the last bin closed (A16).  min/max are scalar subqueries."""
    v = F.col(value_col).cast("double")
    mm = values.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("m")).scalar()
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1))).cast("int")
    counts = values.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spark = values.sparkSession
    # all bins, including empty ones; the frame has exactly ``bins`` rows
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = allb.join(counts, "bin", "left")
    return out.select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                      (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def histogram_markers(values: DataFrame, value_col: str, qs: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """(marker, value): max and nearest quantiles, the lines drawn on the plots."""
    names = {f"q{round(q * 100)}": q for q in qs}
    q = nearest_quantiles(values, value_col, names)
    mx = values.agg(F.max(F.col(value_col).cast("double"))).scalar()
    entries = [F.struct(F.lit("max").alias("marker"), mx.alias("value"))]
    entries += [F.struct(F.lit(n).alias("marker"), F.col(n).cast("double").alias("value")) for n in names]
    return q.select(F.inline(F.array(*entries)))


def user_history_histogram(seq: DataFrame, log10: bool = False) -> DataFrame:
    bins = 40 if log10 else 100
    return histogram(history_lengths(seq, log10), "value", bins)


def item_interactions_histogram(df: DataFrame) -> DataFrame:
    return histogram(item_interactions(df).select(F.col("log_n").alias("value")), "value", 30)

