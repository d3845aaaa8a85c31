"""File-level jobs: build the multi-event log, transform flat logs to the
sequential layout, export dataset statistics, run a benchmark protocol and
write its report.

All paths go through Spark's Hadoop FileSystem, so the jobs work on any
shared store; outputs are Parquet (lz4), CSV for statistic tables and JSON for
metric reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import constants as C
from rankfold.operators import reshape, stats
from rankfold.sources import events as ev
from rankfold.sources import sinks


FILE_POSITION = ["_file", "_file_row"]


def with_file_position(scan: DataFrame) -> DataFrame:
    """Place of each row in its source: part file (by name) and row number in it.

    Taken from the Parquet reader; partition numbers would follow Spark's
    packing of splits (largest first) instead."""
    return scan.withColumns({"_file": F.col("_metadata.file_path"), "_file_row": F.col("_metadata.row_index")})


def make_multievent(spark: SparkSession, src_dir: str, dst_dir: str | None = None,
                    file_name: str = "multi_event", tie_cols: list[str] | None = None) -> str:
    """Union of the five kind tables in ``src_dir``, sorted by (uid, timestamp,
    kind order, tie_cols, position in the source file) -- the reference's
    stable sort keeps union order, then file order -- written as
    ``<dst_dir>/<file_name>.parquet``."""
    dst_dir = dst_dir or src_dir
    kinds = {k: with_file_position(t) for k, t in ev.read_event_kinds(spark, src_dir).items()}
    out = reshape.sort_events(reshape.union_event_kinds(kinds), list(tie_cols or []) + FILE_POSITION)
    out = out.drop(*FILE_POSITION)
    path = f"{dst_dir.rstrip('/')}/{file_name}.parquet"
    sinks.write_parquet(out, path, mode="overwrite")
    return path


def list_parquet_files(spark: SparkSession, src_dir: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(src_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().endswith(".parquet"))


def transform_to_sequential(spark: SparkSession, src_dir: str, dst_dir: str, aggregation: str,
                            files: list[str] | None = None, order_cols: list[str] | None = None,
                            file_order: bool = False) -> list[str]:
    """Fold every listed file (default: every Parquet file in ``src_dir``, as
    the reference's help text promises) to one row per user.  Lists are in
    time order with ties in file order, or with ``file_order`` wholly in the
    order of the file, as the reference leaves them.  An existing
    target gets the ``<aggregation>_`` prefix; if that exists too, fail."""
    files = list(files) if files else list_parquet_files(spark, src_dir)
    written = []
    for f in files:
        scan = spark.read.parquet(f"{src_dir.rstrip('/')}/{f}")
        value_cols = [c for c in ev.conform_flat(scan).columns if c != "uid"]
        df = ev.conform_flat(with_file_position(scan))
        keys = [] if file_order else order_cols or [c for c in ("timestamp", "event_ord") if c in df.columns]
        keys = keys + FILE_POSITION
        seq = reshape.to_sequences(df, aggregation, order_cols=keys, value_cols=value_cols)
        path = sinks.resolve_output_path(spark, dst_dir, f, aggregation)
        sinks.write_parquet(seq, path)
        written.append(path)
    return written


def dataset_statistics(flat: DataFrame, seq: DataFrame) -> dict[str, DataFrame]:
    """Every statistic table of the stats script, as DataFrames."""
    return {
        "recom_event_count": stats.recom_ratio(flat),
        "event_history_len": stats.history_len_stats(flat),
        "dataset_event_stats": stats.dataset_stats(flat),
        "user_history_len": stats.user_history_histogram(seq),
        "user_history_len_markers": stats.histogram_markers(stats.history_lengths(seq), "value"),
        "user_history_log_len": stats.user_history_histogram(seq, log10=True),
        "item_interactions": stats.item_interactions_histogram(flat),
        "item_interactions_markers": stats.histogram_markers(
            stats.item_interactions(flat).select("log_n"), "log_n"),
    }


def generate_dataset_stats(spark: SparkSession, src_dir: str, dst_dir: str | None = None,
                           file_name: str = "multi_event") -> list[str]:
    """For every size folder (name order): statistic tables as CSV under
    ``<dst_dir>/<size>/``."""
    dst_dir = dst_dir or f"{src_dir.rstrip('/')}/stats"
    written = []
    for size in ev.discover_sizes(spark, src_dir, file_name):
        flat = ev.read_events(spark, f"{src_dir.rstrip('/')}/flat", size, file_name)
        seq = ev.read_sequences(spark, src_dir, size, file_name)
        for name, df in dataset_statistics(flat, seq).items():
            path = f"{dst_dir.rstrip('/')}/{size}/{name}.csv"
            sinks.write_csv(df, path)
            written.append(path)
    return written


def evaluate_lists(spark: SparkSession, ranked_path: str, targets_path: str, metrics: list[str],
                   items_path: str | None = None, out_path: str | None = None) -> DataFrame:
    """Score lists from elsewhere: ranked rows (uid, rank, item_id[, score]) and target
    events (uid, item_id) from Parquet; the item universe for coverage from
    ``items_path``, the lists' own items otherwise.  Preconditions (M8, J9) are looked
    at first and named in the error."""
    from rankfold.operators import metrics as M
    from rankfold.operators.validate import require_valid

    ranked, targets = spark.read.parquet(ranked_path), spark.read.parquet(targets_path)
    if "score" not in ranked.columns:
        ranked = M.default_scores(ranked)
    groups = M.parse_metrics(metrics)
    require_valid(ranked, targets, sorted({k for ks in groups.values() for k in ks}))
    universe = spark.read.parquet(items_path) if items_path else ranked
    rep = M.evaluate(ranked, targets, metrics, universe.select("item_id"))
    if out_path:
        sinks.write_metrics_json(rep, out_path)
    return rep


def run_benchmark(spark: SparkSession, model: str, data_dir: str, size: str, interaction: str,
                  out_path: str | None = None, **kw) -> DataFrame:
    """Scan ``<data_dir>/<size>/<interaction>.parquet``, run one protocol,
    optionally write the report as JSON ``{metric: {k: value}}``."""
    from rankfold.plans import benchmarks as B

    events = ev.read_events(spark, data_dir, size, interaction)
    if model == "popularity":
        rep = B.popularity_benchmark(events, interaction=interaction, **kw)
    elif model == "itemknn":
        kw.setdefault("hours", C.ITEMKNN_GRIDS.get(size, C.ITEMKNN_GRIDS["50m"])[interaction])
        rep = B.itemknn_benchmark(events, interaction=interaction, **kw)
    elif model in ("als", "bpr"):
        kw.setdefault("n_trials", C.TRIALS_PER_SIZE.get(size, 2))
        rep = B.factorization_benchmark(events, model=model, interaction=interaction, **kw)
    elif model == "sparse_linear":
        rep = B.sparse_linear_benchmark(events, interaction=interaction, **kw)
    elif model == "random":
        rep = B.random_benchmark(events, interaction=interaction, **kw)
    else:
        raise ValueError(f"unknown model {model!r}")
    if out_path:
        sinks.write_metrics_json(rep, out_path)
    return rep
