"""Command line: ``python -m rankfold <command> ...``

  benchmark   run a protocol (popularity, itemknn, als, bpr, sparse_linear,
              random) on <data_dir>/<size>/<interaction>.parquet, print the
              JSON report and optionally write it
  multievent  build the multi-event log from the five kind tables
  sequential  fold flat files into the per-user sequential layout
  stats       export the dataset statistic tables for every size folder

The session comes from ``spark-submit``/the environment; only unset
settings get defaults (see ``rankfold.session``).
"""

from __future__ import annotations

import argparse
import json

from rankfold import constants as C


def _report_dict(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["metric"], {})[int(r["k"])] = r["value"]
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rankfold")
    sub = p.add_subparsers(dest="cmd", required=True)

    b = sub.add_parser("benchmark")
    b.add_argument("--model", required=True,
                   choices=["popularity", "itemknn", "als", "bpr", "sparse_linear", "random"])
    b.add_argument("--data_dir", required=True)
    b.add_argument("--size", nargs="+", default=["50m"])
    b.add_argument("--interaction", nargs="+", default=["likes"], choices=["likes", "listens"])
    b.add_argument("--hours", type=float, nargs="*", default=None)
    b.add_argument("--validation_metric", default="ndcg@100")
    b.add_argument("--report_metrics", nargs="+", default=C.METRICS)
    b.add_argument("--out", default=None, help="folder for JSON reports (one per size/interaction)")
    b.add_argument("--test_timestamp", type=int, default=None, help=f"default {C.TEST_TIMESTAMP}")
    b.add_argument("--val_size", type=int, default=None, help=f"default {C.VAL_SIZE}")
    b.add_argument("--gap_size", type=int, default=None, help=f"default {C.GAP_SIZE}")

    m = sub.add_parser("multievent")
    m.add_argument("--src_dir", required=True)
    m.add_argument("--dst_dir", default=None)
    m.add_argument("--file_name", default="multi_event")

    s = sub.add_parser("sequential")
    s.add_argument("--src_dir", required=True)
    s.add_argument("--dst_dir", required=True)
    s.add_argument("--files", nargs="*", default=None, help="default: every Parquet file in src_dir")
    s.add_argument("--aggregation", required=True, choices=["structs", "columns"])

    t = sub.add_parser("stats")
    t.add_argument("--src_dir", required=True)
    t.add_argument("--dst_dir", default=None)
    t.add_argument("--file_name", default="multi_event")

    e = sub.add_parser("evaluate")
    e.add_argument("--ranked", required=True, help="Parquet of uid, rank, item_id and, if at hand, score")
    e.add_argument("--targets", required=True, help="Parquet of uid, item_id: the held-out events")
    e.add_argument("--items", default=None, help="Parquet of item_id: all items, for coverage")
    e.add_argument("--metrics", nargs="+", default=C.METRICS)
    e.add_argument("--out", default=None)

    a = p.parse_args(argv)
    from rankfold.plans import jobs
    from rankfold.session import get_session

    spark = get_session()
    if a.cmd == "benchmark":
        for size in a.size:
            for inter in a.interaction:
                kw = {"report_metrics": a.report_metrics}
                if a.test_timestamp is not None:
                    kw["test_ts"] = a.test_timestamp
                if a.gap_size is not None:
                    kw["gap"] = a.gap_size
                if a.val_size is not None and a.model not in ("random", "sparse_linear"):
                    kw["val_size"] = a.val_size
                if a.model in ("popularity", "itemknn", "als", "bpr"):
                    kw["validation_metric"] = a.validation_metric
                if a.hours and a.model in ("popularity", "itemknn"):
                    kw["hours"] = a.hours
                out = f"{a.out.rstrip('/')}/{a.model}_{size}_{inter}" if a.out else None
                rep = jobs.run_benchmark(spark, a.model, a.data_dir, size, inter, out_path=out, **kw)
                print(json.dumps({"size": size, "interaction": inter, "metrics": _report_dict(rep)}, indent=2))
    elif a.cmd == "evaluate":
        rep = jobs.evaluate_lists(spark, a.ranked, a.targets, a.metrics, a.items, a.out)
        print(json.dumps(_report_dict(rep), indent=2))
    elif a.cmd == "multievent":
        print(jobs.make_multievent(spark, a.src_dir, a.dst_dir, a.file_name))
    elif a.cmd == "sequential":
        for path in jobs.transform_to_sequential(spark, a.src_dir, a.dst_dir, a.aggregation, a.files):
            print(path)
    elif a.cmd == "stats":
        for path in jobs.generate_dataset_stats(spark, a.src_dir, a.dst_dir, a.file_name):
            print(path)


if __name__ == "__main__":
    main()
