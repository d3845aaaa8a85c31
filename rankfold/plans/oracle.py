"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the definitions, in plain SQL: metrics average over a full
users table with zeros filled in by a LEFT JOIN, ideal DCG comes from a
cumulative discount table, coverage counts distinct items.  The Spark side
computes the same numbers along different paths, so agreement is a real check.
"""

from __future__ import annotations

from rankfold.plans import params as P

D = P.OUT_DIGITS
S = P.SCORE_DIGITS


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


# per-second decay factors, worked out by hand: 0.9 ** (1 / (3600 * hour)), and 0
# for hour 0 (only the latest second weighs)
TAU = {0.0: 0.0, 1.0: 0.999970733618364, 24.0: 0.9999987805503309, 720.0: 0.9999999593516538, 2160.0: 0.9999999864505511, 8760.0: 0.9999999966590399}


def tau(hour: float) -> float:
    return TAU[hour]


def by_name(metrics: list[str]) -> dict[str, list[int]]:
    """Cut-offs of each metric."""
    out: dict[str, list[int]] = {}
    for m in metrics:
        out.setdefault(m[:m.index("@")], []).append(int(m[m.index("@") + 1:]))
    return out


INTER = """
inter AS (
  SELECT o.o_custkey AS uid, l.l_partkey AS item_id,
         date_diff('second', TIMESTAMP '1970-01-01 00:00:00', o.o_orderdate) AS timestamp,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END AS SMALLINT) AS is_organic,
         CAST(floor(l.l_quantity * 2) AS BIGINT) AS played_ratio_pct,
         l.l_orderkey AS l_orderkey, CAST(l.l_linenumber AS INTEGER) AS l_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

ME = """
me AS (
  SELECT user_id AS uid,
         date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS timestamp,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CAST(event_id % 2 AS SMALLINT) AS is_organic,
         CASE WHEN event_type = 'view' THEN CAST(least(floor(value), 100) AS BIGINT) END AS played_ratio_pct,
         CASE WHEN event_type = 'view' THEN CAST(180 AS BIGINT) END AS track_length_seconds,
         CASE event_type WHEN 'view' THEN 'listen' WHEN 'error' THEN 'dislike' WHEN 'click' THEN 'like'
              WHEN 'purchase' THEN 'undislike' WHEN 'signup' THEN 'unlike' END AS event_type,
         CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2
              WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS INTEGER) AS event_ord,
         event_id
  FROM events WHERE event_type IN ('view', 'error', 'click', 'purchase', 'signup'))"""

# the same log where every fourth item has a new id every three days
MER = ME.replace("me AS (", "mer AS (").replace(
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id",
    "CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) "
    "+ 1000 * (1 + date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) // 259200) "
    "ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS item_id")

INTER_COLS = "uid, item_id, timestamp, is_organic, played_ratio_pct, l_orderkey, l_linenumber"
ME_COLS = ("uid, timestamp, item_id, is_organic, played_ratio_pct, track_length_seconds, event_type, "
           "event_ord, event_id")


def split_ctes(src: str, cols: str, test_ts: int, val_size: int, gap: int, prefix: str = "",
               drop_unseen_items: bool = False) -> str:
    """train / val / test CTEs named ``{prefix}train`` etc."""
    te = P.train_end(test_ts, val_size, gap)
    item_rule = f" AND item_id IN (SELECT item_id FROM {prefix}train)" if drop_unseen_items else ""
    out = [f"{prefix}train AS (SELECT {cols} FROM {src} WHERE timestamp < {te})"]
    if val_size:
        out.append(f"{prefix}val AS (SELECT {cols} FROM {src} WHERE timestamp >= {test_ts - val_size - gap} "
                   f"AND timestamp < {test_ts - gap} AND uid IN (SELECT uid FROM {prefix}train){item_rule})")
    out.append(f"{prefix}test AS (SELECT {cols} FROM {src} WHERE timestamp >= {test_ts} "
               f"AND uid IN (SELECT uid FROM {prefix}train){item_rule})")
    return ",\n".join(out)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip())


def metric_ctes(ranked: str, targets: str, num_items_sql: str, metrics: list[str], by: list[str],
                shared: bool, name: str = "rep", mrr_compat: bool = False, coverage_targets: bool = False,
                distinct_targets: bool = False, per_user: bool = False) -> str:
    """CTEs ending in ``{name}(by.., metric, k, value)``.

    ranked: (by.., [uid,] rank, item_id); ``shared`` means one list per
    by-group for every user.  targets: (uid, item_id) events.
    """
    g = by_name(metrics)
    ks = sorted({k for kk in g.values() for k in kk})
    kmax = max(ks)
    byc = "".join(f"{b}, " for b in by)
    tb = "".join(f"t.{b}, " for b in by)
    n_pos = "count(DISTINCT item_id)" if distinct_targets else "count(*)"
    c = [f"{name}_pos AS (SELECT uid, {n_pos} AS n_pos FROM {targets} GROUP BY uid)",
         f"{name}_pairs AS (SELECT DISTINCT uid, item_id FROM {targets})",
         f"{name}_disc AS (SELECT r, sum(1.0 / log2(r + 1)) OVER (ORDER BY r) AS c FROM range(1, {kmax + 1}) t(r))"]
    if shared:
        c.append(f"{name}_hits AS (SELECT {tb}p.uid, t.rank FROM {name}_pairs p JOIN {ranked} t "
                 f"ON p.item_id = t.item_id WHERE t.rank <= {kmax})")
        groups_sql = f"(SELECT DISTINCT {', '.join(by)} FROM {ranked})" if by else None
    else:
        c.append(f"{name}_hits AS (SELECT {tb}p.uid, t.rank FROM {name}_pairs p JOIN {ranked} t "
                 f"ON p.item_id = t.item_id AND p.uid = t.uid WHERE t.rank <= {kmax})")
        groups_sql = f"(SELECT DISTINCT {', '.join(by)} FROM {ranked})" if by else None
    per = []
    for k in ks:
        per += [f"count(*) FILTER (WHERE rank <= {k}) AS h{k}",
                f"sum(CASE WHEN rank <= {k} THEN 1.0 / log2(rank + 1) END) AS d{k}",
                f"min(CASE WHEN rank <= {k} THEN rank END) AS f{k}"]
    c.append(f"{name}_pu AS (SELECT {byc}uid, {', '.join(per)} FROM {name}_hits GROUP BY {byc}uid)")
    if by:
        users = (f"SELECT {', '.join('g.' + b for b in by)}, p.uid, p.n_pos FROM {groups_sql} g "
                 f"CROSS JOIN {name}_pos p")
    else:
        users = f"SELECT p.uid, p.n_pos FROM {name}_pos p"
    on = " AND ".join([f"u.{b} = h.{b}" for b in by] + ["u.uid = h.uid"])
    cols = []
    for k in ks:
        cols += [f"coalesce(h.h{k}, 0) AS h{k}", f"coalesce(h.d{k}, 0.0) AS d{k}", f"h.f{k} AS f{k}",
                 f"(SELECT c FROM {name}_disc WHERE r = least(u.n_pos, {k})) AS i{k}"]
    ub = "".join(f"u.{b}, " for b in by)
    c.append(f"{name}_u AS (SELECT {ub}u.uid, u.n_pos, {', '.join(cols)} FROM ({users}) u "
             f"LEFT JOIN {name}_pu h ON {on})")
    parts = []
    gb = f" GROUP BY {', '.join(by)}" if by else ""
    for m, kk in g.items():
        for k in kk:
            if m == "recall":
                v = f"avg(h{k} / n_pos)"
            elif m == "precision":
                v = f"avg(h{k} / {float(k)})"
            elif m == "mrr":
                miss = "1.0" if mrr_compat else "0.0"
                v = f"avg(coalesce(1.0 / f{k}, {miss}))"
            elif m == "dcg":
                v = f"avg(d{k})"
            elif m == "ndcg":
                v = f"CASE WHEN avg(i{k}) <> 0 THEN avg(d{k}) / avg(i{k}) ELSE 0.0 END"
                if per_user:
                    v = f"avg(CASE WHEN i{k} <> 0 THEN d{k} / i{k} ELSE 0.0 END)"
            else:
                continue
            parts.append(f"SELECT {byc}'{m}' AS metric, CAST({k} AS INTEGER) AS k, CAST({v} AS DOUBLE) AS value "
                         f"FROM {name}_u{gb}")
    if "coverage" in g:
        src = ranked
        if coverage_targets and not shared:
            src = f"(SELECT * FROM {ranked} WHERE uid IN (SELECT uid FROM {name}_pos))"
        for k in g["coverage"]:
            parts.append(f"SELECT {byc}'coverage' AS metric, CAST({k} AS INTEGER) AS k, "
                         f"CAST(count(DISTINCT item_id) FILTER (WHERE rank <= {k}) AS DOUBLE) / ({num_items_sql}) "
                         f"AS value FROM {src}{gb}")
    c.append(f"{name} AS (" + "\nUNION ALL ".join(parts) + ")")
    return ",\n".join(c)


# ---------------------------------------------------------------- queries

def _inter_split(val_size=P.INTER_VAL_SIZE, prefix=""):
    return split_ctes("inter", INTER_COLS, P.INTER_TEST_TS, val_size, P.INTER_GAP, prefix)


def q_split_train():
    return f"{with_(INTER, _inter_split())} SELECT * FROM train"


def q_split_val():
    return f"{with_(INTER, _inter_split())} SELECT * FROM val"


def q_split_test():
    return f"{with_(INTER, _inter_split())} SELECT * FROM test"


def q_split_test_seen_items():
    s = split_ctes("mer", ME_COLS, P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP, drop_unseen_items=True)
    return f"{with_(MER, s)} SELECT * FROM test"


def _scores_sql(train: str, hour: float) -> str:
    if hour == 0:
        return f"SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM {train} GROUP BY item_id"
    return (f"SELECT item_id, sum(pow({dbl(tau(hour))}, CAST((SELECT max(timestamp) FROM {train}) - timestamp "
            f"AS DOUBLE))) AS score FROM {train} GROUP BY item_id")


def q_popularity_count():
    return f"{with_(INTER, _inter_split(0))} SELECT item_id, count(*) AS n FROM train GROUP BY item_id"


def q_popularity_decayed():
    return (f"{with_(INTER, _inter_split(0))} SELECT item_id, round(score, {D}) AS score "
            f"FROM ({_scores_sql('train', P.INTER_TOPK_HOUR)})")


def _top_sql(scores: str, k: int) -> str:
    return (f"SELECT CAST(row_number() OVER (ORDER BY round(score, {S}) DESC, item_id) AS INTEGER) AS rank, item_id, "
            f"round(score, {S}) AS score FROM ({scores}) ORDER BY round(score, {S}) DESC, item_id LIMIT {k}")


def q_popularity_topk():
    return (f"{with_(INTER, _inter_split(0))} SELECT rank, item_id, round(score, {D}) AS score "
            f"FROM ({_top_sql(_scores_sql('train', P.INTER_TOPK_HOUR), 100)})")


def _grid_scores(train: str, hours: list[float]) -> str:
    parts = [f"SELECT CAST({i} AS INTEGER) AS trial, CAST({float(h)!r} AS DOUBLE) AS hour, item_id, score "
             f"FROM ({_scores_sql(train, h)})" for i, h in enumerate(hours)]
    return " UNION ALL ".join(parts)


def _grid_top(train: str, hours: list[float], k: int) -> str:
    return (f"SELECT trial, hour, rank, item_id, score FROM (SELECT trial, hour, item_id, round(score, {S}) AS score, "
            f"CAST(row_number() OVER (PARTITION BY trial ORDER BY round(score, {S}) DESC, item_id) AS INTEGER) AS rank "
            f"FROM ({_grid_scores(train, hours)})) WHERE rank <= {k}")


def q_popularity_grid():
    m = metric_ctes("gtop", "val", "SELECT count(DISTINCT item_id) FROM train", P.REPORT_METRICS,
                    ["trial", "hour"], shared=True)
    return (f"{with_(INTER, _inter_split(), f'gtop AS ({_grid_top("train", P.INTER_HOURS, 100)})', m)} "
            f"SELECT trial, hour, metric, k, round(value, {D}) AS value FROM rep")


def q_popularity_eval():
    val_m = metric_ctes("gtop", "val", "SELECT count(DISTINCT item_id) FROM train", [P.VALIDATION_METRIC],
                        ["trial", "hour"], shared=True, name="vrep")
    best = "best AS (SELECT trial FROM vrep ORDER BY value DESC, trial LIMIT 1)"
    ftop = (f"ftop AS (SELECT rank, item_id FROM ({_grid_top('r_train', P.INTER_HOURS, 100)}) "
            f"WHERE trial = (SELECT trial FROM best))")
    rep = metric_ctes("ftop", "r_test", "SELECT count(DISTINCT item_id) FROM r_train", P.REPORT_METRICS, [],
                      shared=True)
    return (f"{with_(INTER, _inter_split(), _inter_split(0, 'r_'), f'gtop AS ({_grid_top("train", P.INTER_HOURS, 100)})', val_m, best, ftop, rep)} "
            f"SELECT metric, k, round(value, {D}) AS value FROM rep")


ORACLES = {
    "split_train": q_split_train,
    "split_val": q_split_val,
    "split_test": q_split_test,
    "split_test_seen_items": q_split_test_seen_items,
    "popularity_count": q_popularity_count,
    "popularity_decayed": q_popularity_decayed,
    "popularity_topk": q_popularity_topk,
    "popularity_grid": q_popularity_grid,
    "popularity_eval": q_popularity_eval,
}


# ---------------------------------------------------------------- reshape, sequences, statistics

ME_ORDER = "ORDER BY timestamp, event_ord, event_id"
ME_LIST_COLS = ["timestamp", "item_id", "is_organic", "played_ratio_pct", "track_length_seconds", "event_type",
                "event_ord", "event_id"]


def _fold_columns(src: str) -> str:
    cols = ", ".join(f"list({c} {ME_ORDER}) AS {c}" for c in ME_LIST_COLS)
    return f"SELECT uid, {cols} FROM {src} GROUP BY uid"


def q_multi_event():
    return f"{with_(ME)} SELECT uid, timestamp, item_id, is_organic, played_ratio_pct, track_length_seconds, " \
           f"event_id, event_type, event_ord, row_number() OVER (ORDER BY uid, timestamp, event_ord, event_id) - 1 AS position FROM me"


def q_seq_columns():
    return f"{with_(ME)} {_fold_columns('me')}"


def q_seq_structs():
    fields = ", ".join(f"'{c}': {c}" for c in ME_LIST_COLS)
    return f"{with_(ME)} SELECT uid, list({{{fields}}} {ME_ORDER}) AS events FROM me GROUP BY uid"


def _me_split(drop_unseen_items=False, src="me"):
    return split_ctes(src, ME_COLS, P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP, drop_unseen_items=drop_unseen_items)


def q_seq_split_val():
    return f"{with_(ME, _me_split())} {_fold_columns('val')}"


def q_seq_split_test():
    return f"{with_(ME, _me_split())} {_fold_columns('test')}"


def q_seq_split_test_seen_items():
    return f"{with_(MER, _me_split(True, 'mer'))} {_fold_columns('test')}"


def q_recom_ratio():
    return (f"{with_(ME)} SELECT event_type, total, recom, round(recom / total, {D}) AS ratio FROM ("
            f"SELECT event_type, count(*) AS total, count(*) FILTER (WHERE is_organic = 0) AS recom "
            f"FROM me GROUP BY event_type) WHERE recom > 0")


def _nearest(col: str, q: float) -> str:
    return f"max({col}) FILTER (WHERE i = round((n - 1) * {float(q)!r}))"


def q_history_quantiles():
    return (f"{with_(ME)}, pu AS (SELECT event_type, uid, count(*) AS len FROM me GROUP BY event_type, uid), "
            f"r AS (SELECT event_type, len, row_number() OVER (PARTITION BY event_type ORDER BY len) - 1 AS i, "
            f"count(*) OVER (PARTITION BY event_type) AS n FROM pu) "
            f"SELECT event_type, CAST({_nearest('len', 0.5)} AS INTEGER) AS median, "
            f"CAST({_nearest('len', 0.9)} AS INTEGER) AS q90, CAST({_nearest('len', 0.95)} AS INTEGER) AS q95 "
            f"FROM r GROUP BY event_type")


def q_dataset_stats():
    kinds = [("listens", "listen"), ("likes", "like"), ("dislikes", "dislike"), ("unlikes", "unlike"),
             ("undislikes", "undislike")]
    k = ", ".join(f"count(*) FILTER (WHERE event_type = '{v}') AS {n}" for n, v in kinds)
    return f"{with_(ME)} SELECT count(DISTINCT uid) AS users, count(DISTINCT item_id) AS items, {k} FROM me"


def _hist(values_cte: str, bins: int) -> str:
    return (f"mm AS (SELECT min(value) AS lo, max(value) AS hi FROM {values_cte}), "
            f"b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((value - lo) / (hi - lo) * {float(bins)}), "
            f"{bins - 1}) AS INTEGER) END AS bin FROM {values_cte}, mm), "
            f"c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) "
            f"SELECT CAST(r.range AS INTEGER) AS bin, round(lo + CAST(r.range AS INTEGER) * ((hi - lo) / {float(bins)}), {D}) AS bin_lo, "
            f"round(lo + (CAST(r.range AS INTEGER) + 1) * ((hi - lo) / {float(bins)}), {D}) AS bin_hi, "
            f"CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM range({bins}) r CROSS JOIN mm "
            f"LEFT JOIN c ON c.bin = CAST(r.range AS INTEGER)")


def q_history_histogram():
    return (f"{with_(ME)}, v AS (SELECT CAST(count(*) AS DOUBLE) AS value FROM me GROUP BY uid), "
            f"{_hist('v', 100)}")


def q_history_log_histogram():
    return (f"{with_(ME)}, v AS (SELECT log10(CAST(count(*) AS DOUBLE)) AS value FROM me GROUP BY uid), "
            f"{_hist('v', 40)}")


def q_history_markers():
    return (f"{with_(ME)}, v AS (SELECT CAST(count(*) AS DOUBLE) AS value FROM me GROUP BY uid), "
            f"r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM v) "
            f"SELECT 'max' AS marker, round(max(value), {D}) AS value FROM r "
            f"UNION ALL SELECT 'q50', round({_nearest('value', 0.5)}, {D}) FROM r "
            f"UNION ALL SELECT 'q90', round({_nearest('value', 0.9)}, {D}) FROM r "
            f"UNION ALL SELECT 'q95', round({_nearest('value', 0.95)}, {D}) FROM r")


def q_item_log_counts():
    return (f"{with_(ME)} SELECT item_id, count(*) AS n, round(log10(count(*)), {D}) AS log_n "
            f"FROM me GROUP BY item_id")


def q_item_log_histogram():
    return (f"{with_(INTER)}, v AS (SELECT log10(CAST(count(*) AS DOUBLE)) AS value FROM inter GROUP BY item_id), "
            f"{_hist('v', 30)}")


def q_dense_index():
    return (f"{with_(INTER)} SELECT uid, CAST(dense_rank() OVER (ORDER BY uid) - 1 AS BIGINT) AS uid_idx "
            f"FROM (SELECT DISTINCT uid FROM inter)")


ORACLES.update({
    "multi_event": q_multi_event,
    "seq_columns": q_seq_columns,
    "seq_structs": q_seq_structs,
    "seq_split_val": q_seq_split_val,
    "seq_split_test": q_seq_split_test,
    "seq_split_test_seen_items": q_seq_split_test_seen_items,
    "recom_ratio": q_recom_ratio,
    "history_quantiles": q_history_quantiles,
    "dataset_stats": q_dataset_stats,
    "history_histogram": q_history_histogram,
    "history_log_histogram": q_history_log_histogram,
    "history_markers": q_history_markers,
    "item_log_counts": q_item_log_counts,
    "item_log_histogram": q_item_log_histogram,
    "dense_index": q_dense_index,
})


# ---------------------------------------------------------------- random lists, metrics, embeddings

def _md5_int(n_sql: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT % ({n_sql}))"


def _random_ctes(seed: int, name: str = "rl") -> str:
    return (f"{name}_items AS (SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx "
            f"FROM (SELECT DISTINCT item_id FROM train)), "
            f"{name}_draws AS (SELECT uid, p AS rank, {_md5_int(f'SELECT count(*) FROM {name}_items', str(seed), 'uid', 'p')} "
            f"AS item_idx FROM (SELECT DISTINCT uid FROM train) u, range(1, 101) t(p)), "
            f"{name} AS (SELECT d.uid, CAST(d.rank AS INTEGER) AS rank, i.item_id, CAST(100 - d.rank + 1 AS DOUBLE) AS score "
            f"FROM {name}_draws d JOIN {name}_items i ON d.item_idx = i.item_idx)")


def q_random_topk():
    return f"{with_(INTER, _inter_split(0), _random_ctes(P.RANDOM_SEED))} SELECT * FROM rl"


def _report(metrics, **kw):
    m = metric_ctes("rl", "test", "SELECT count(DISTINCT item_id) FROM train", metrics, [], shared=False, **kw)
    return (f"{with_(INTER, _inter_split(0), _random_ctes(P.RANDOM_SEED), m)} "
            f"SELECT metric, k, round(value, {D}) AS value FROM rep")


def q_metrics_all():
    return _report(P.ALL_METRICS)


def q_mrr_compat():
    return _report(["mrr@10", "mrr@50", "mrr@100"], mrr_compat=True)


def q_coverage_target_users():
    return _report(["coverage@10", "coverage@50", "coverage@100"], coverage_targets=True)


def q_recall_distinct_targets():
    return _report(["recall@10", "recall@100", "ndcg@10", "ndcg@100"], distinct_targets=True)


def q_ndcg_per_user():
    return _report(["ndcg@10", "ndcg@50", "ndcg@100"], per_user=True)


def q_random_eval():
    ctes = [INTER, _inter_split(0)]
    sels = []
    for r in range(P.RANDOM_REPEATS):
        ctes.append(_random_ctes(P.RANDOM_SEED + r, f"rl{r}"))
        ctes.append(metric_ctes(f"rl{r}", "test", "SELECT count(DISTINCT item_id) FROM train", P.REPORT_METRICS, [],
                                shared=False, name=f"rep{r}"))
        sels.append(f"SELECT metric, k, value FROM rep{r}")
    return (f"{with_(*ctes)} SELECT metric, k, round(avg(value), {D}) AS value FROM ({' UNION ALL '.join(sels)}) "
            f"GROUP BY metric, k")


EMB = """
eu AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 0),
ei AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 <> 0)"""


def q_embedding_topk():
    return (f"{with_(EMB)}, s AS (SELECT eu.id AS uid, ei.id AS item_id, round(list_dot_product(eu.e, ei.e), {S}) AS score "
            f"FROM eu CROSS JOIN ei) "
            f"SELECT uid, rank, item_id, CAST(round(score * 1e{S}) AS BIGINT) AS score_e9 FROM (SELECT uid, item_id, score, "
            f"CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s) "
            f"WHERE rank <= 100")


ORACLES.update({
    "random_topk": q_random_topk,
    "metrics_all": q_metrics_all,
    "mrr_compat": q_mrr_compat,
    "coverage_target_users": q_coverage_target_users,
    "recall_distinct_targets": q_recall_distinct_targets,
    "ndcg_per_user": q_ndcg_per_user,
    "random_eval": q_random_eval,
    "embedding_topk": q_embedding_topk,
})


# ---------------------------------------------------------------- ItemKNN, computed the direct way

LISTEN = "lm AS (SELECT * FROM me WHERE event_type = 'listen')"


def _me_split0(prefix=""):
    return LISTEN * (not prefix) + ",\n" * (not prefix) + split_ctes("lm", ME_COLS, P.ME_TEST_TS, 0, P.ME_GAP, prefix)


def _knn_base(train: str, p: str) -> str:
    return (f"{p}U AS (SELECT uid, item_id, CAST(count(*) AS DOUBLE) AS u FROM {train} GROUP BY uid, item_id), "
            f"{p}un AS (SELECT uid, sqrt(sum(u * u) + 1e-12) AS n FROM {p}U GROUP BY uid), "
            f"{p}inn AS (SELECT item_id, sqrt(sum(u * u) + 1e-12) AS n FROM {p}U GROUP BY item_id), "
            f"{p}mx AS (SELECT uid, max(timestamp) AS m FROM {train} GROUP BY uid)")


def _knn_weights(train: str, p: str, hour: float, name: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT t.uid, t.item_id, sum(pow({dbl(tau(hour))}, "
            f"CAST(x.m - t.timestamp AS DOUBLE))) AS w FROM {train} t JOIN {p}mx x ON t.uid = x.uid "
            f"GROUP BY t.uid, t.item_id) WHERE w > 1e-9)")


def _knn_ranked(train: str, p: str, hour: float, norm: str, name: str, k: int = 100) -> str:
    """CTEs ending in ``name(uid, rank, item_id, score)``; needs _knn_base(p)."""
    e = (f"{name}_E AS (SELECT U.item_id, U.uid AS v, U.u / un.n AS e FROM {p}U U JOIN {p}un un ON U.uid = un.uid)"
         if norm == "user" else
         f"{name}_E AS (SELECT U.item_id, U.uid AS v, U.u / n.n AS e FROM {p}U U JOIN {p}inn n ON U.item_id = n.item_id)")
    return ", ".join([
        _knn_weights(train, p, hour, f"{name}_W"),
        e,
        f"{name}_V AS (SELECT W.uid, U.uid AS v, sum(W.w * U.u) AS val FROM {name}_W W JOIN {p}U U "
        f"ON W.item_id = U.item_id GROUP BY W.uid, U.uid)",
        f"{name}_vn AS (SELECT uid, greatest(sqrt(sum(val * val)), 1e-12) AS n FROM {name}_V GROUP BY uid)",
        f"{name}_sc AS (SELECT V.uid, E.item_id, sum(V.val * E.e) AS raw FROM {name}_V V "
        f"JOIN {name}_E E ON V.v = E.v GROUP BY V.uid, E.item_id)",
        f"{name} AS (SELECT s.uid, rank, item_id, round(raw / n, {S}) AS score FROM (SELECT uid, item_id, round(raw, {S}) AS raw, "
        f"CAST(row_number() OVER (PARTITION BY uid ORDER BY round(raw, {S}) DESC, item_id) AS INTEGER) AS rank "
        f"FROM {name}_sc WHERE raw > 0) s JOIN {name}_vn vn ON s.uid = vn.uid WHERE rank <= {k})",
    ])


def q_user_item_weights():
    return (f"{with_(ME, _me_split0(), _knn_base('train', 'k_'), _knn_weights('train', 'k_', P.ME_KNN_HOUR, 'W'))} "
            f"SELECT uid, item_id, round(w, {D}) AS w FROM W")


def q_item_cooccurrence():
    return (f"{with_(ME, _me_split0(), _knn_base('train', 'k_'))} SELECT a.item_id AS k, b.item_id AS i, "
            f"round(sum(a.u * b.u / un.n), {D}) AS s, round(sum(a.u * b.u), {D}) AS g "
            f"FROM k_U a JOIN k_U b ON a.uid = b.uid JOIN k_un un ON a.uid = un.uid GROUP BY a.item_id, b.item_id")


def _knn_topk(hour: float, norm: str) -> str:
    return (f"{with_(ME, _me_split0(), _knn_base('train', 'k_'), _knn_ranked('train', 'k_', hour, norm, 'rk', P.KNN_TOP_K))} "
            f"SELECT uid, rank, item_id, round(score, {D}) AS score FROM rk")


def q_itemknn_topk():
    return _knn_topk(P.ME_KNN_HOUR, "user")


def q_itemknn_topk_cosine():
    return _knn_topk(P.ME_KNN_HOUR, "item")


def q_itemknn_topk_last():
    return _knn_topk(0.0, "user")


def q_itemknn_eval():
    ctes = [ME, LISTEN, split_ctes("lm", ME_COLS, P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP), _me_split0("r_"),
            _knn_base("train", "v_"), _knn_base("r_train", "f_")]
    sels = []
    for i, h in enumerate(P.ME_KNN_HOURS):
        ctes.append(_knn_ranked("train", "v_", h, "user", f"g{i}"))
        sels.append(f"SELECT CAST({i} AS INTEGER) AS trial, uid, rank, item_id FROM g{i}")
    ctes.append(f"grk AS ({' UNION ALL '.join(sels)})")
    ctes.append(metric_ctes("grk", "val", "SELECT count(DISTINCT item_id) FROM train", [P.VALIDATION_METRIC],
                            ["trial"], shared=False, name="vrep"))
    ctes.append("best AS (SELECT trial FROM vrep ORDER BY value DESC, trial LIMIT 1)")
    for i, h in enumerate(P.ME_KNN_HOURS):
        ctes.append(_knn_ranked("r_train", "f_", h, "user", f"t{i}"))
    ctes.append("frk AS (" + " UNION ALL ".join(
        f"SELECT uid, rank, item_id FROM t{i} WHERE {i} = (SELECT trial FROM best)"
        for i in range(len(P.ME_KNN_HOURS))) + ")")
    ctes.append(metric_ctes("frk", "r_test", "SELECT count(DISTINCT item_id) FROM r_train", P.REPORT_METRICS, [],
                            shared=False))
    return f"{with_(*ctes)} SELECT metric, k, round(value, {D}) AS value FROM rep"


ORACLES.update({
    "user_item_weights": q_user_item_weights,
    "item_cooccurrence": q_item_cooccurrence,
    "itemknn_topk": q_itemknn_topk,
    "itemknn_topk_cosine": q_itemknn_topk_cosine,
    "itemknn_topk_last": q_itemknn_topk_last,
    "itemknn_eval": q_itemknn_eval,
})


def q_bpr_triples():
    n = "SELECT count(*) FROM bi"
    return (f"{with_(INTER, _inter_split(0))}, bp AS (SELECT DISTINCT uid, item_id FROM train), "
            f"bi AS (SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM bp)), "
            f"cand AS (SELECT p.uid, p.item_id, a AS attempt, "
            f"{_md5_int(n, str(P.RANDOM_SEED), 'p.uid', 'p.item_id', 'a')} AS item_idx FROM bp p, range(0, 16) t(a)), "
            f"ok AS (SELECT c.uid, c.item_id, c.attempt, i.item_id AS neg_item_id FROM cand c JOIN bi i ON c.item_idx = i.item_idx "
            f"WHERE NOT EXISTS (SELECT 1 FROM bp q WHERE q.uid = c.uid AND q.item_id = i.item_id)), "
            f"first AS (SELECT uid, item_id, arg_min(neg_item_id, attempt) AS neg_item_id FROM ok GROUP BY uid, item_id) "
            f"SELECT p.uid, p.item_id, f.neg_item_id FROM bp p LEFT JOIN first f ON p.uid = f.uid AND p.item_id = f.item_id")


ORACLES["bpr_triples"] = q_bpr_triples


# ---------------------------------------------------------------- sequence-model data, shards

def _seq_ctes(n: int = P.SEQ_LIST_LEN) -> str:
    te = P.train_end(P.ME_TEST_TS, 0, P.ME_GAP)
    return ", ".join([
        "lme AS (SELECT * FROM me WHERE played_ratio_pct >= 50)",
        "sidx AS (SELECT item_id, CAST(dense_rank() OVER (ORDER BY item_id) AS BIGINT) AS item_idx "
        "FROM (SELECT DISTINCT item_id FROM lme))",
        f"trows AS (SELECT l.*, i.item_idx, row_number() OVER (PARTITION BY uid ORDER BY timestamp DESC, event_ord DESC, "
        f"event_id DESC) AS rn FROM lme l JOIN sidx i ON l.item_id = i.item_id WHERE timestamp < {te})",
        f"strain AS (SELECT uid, list(item_idx ORDER BY timestamp, event_ord, event_id) AS item_id, "
        f"list(timestamp ORDER BY timestamp, event_ord, event_id) AS timestamp FROM trows WHERE rn <= {n} GROUP BY uid)",
        f"stest AS (SELECT l.uid, list(i.item_idx ORDER BY l.timestamp, l.event_ord, l.event_id) AS item_id, "
        f"list(l.timestamp ORDER BY l.timestamp, l.event_ord, l.event_id) AS timestamp FROM lme l "
        f"JOIN sidx i ON l.item_id = i.item_id WHERE l.timestamp >= {P.ME_TEST_TS} "
        f"AND l.uid IN (SELECT uid FROM trows) GROUP BY l.uid)",
        "erows AS (SELECT t.uid, t.item_id AS item_id_train, v.item_id AS item_id_valid FROM strain t "
        "JOIN stest v ON t.uid = v.uid)",
    ])


def q_seq_prepare_train(n: int = P.SEQ_LIST_LEN):
    return f"{with_(ME, _seq_ctes(n))} SELECT * FROM strain"


def q_seq_prepare_test():
    return f"{with_(ME, _seq_ctes(P.SEQ_MAX_LEN))} SELECT * FROM stest"


def _next_item_ctes() -> str:
    n = "SELECT count(*) FROM sidx"
    md5 = _md5_int(n, str(P.RANDOM_SEED), "uid", "i")
    return (f"{with_(ME, _seq_ctes())}, ni AS (SELECT uid, "
            f"CASE WHEN len(item_id) <= 1 THEN []::BIGINT[] ELSE list_slice(item_id, 1, len(item_id) - 1) END AS item_ids, "
            f"CASE WHEN len(item_id) <= 1 THEN []::BIGINT[] ELSE list_slice(item_id, 2, len(item_id)) END AS positive_ids "
            f"FROM strain), "
            f"pos AS (SELECT uid, unnest(range(0, len(item_ids))) AS i FROM ni), "
            f"negs AS (SELECT uid, list({md5} + 1 ORDER BY i) AS negative_ids FROM pos GROUP BY uid), "
            f"nir AS (SELECT ni.uid, item_ids, positive_ids, coalesce(negs.negative_ids, []::BIGINT[]) AS negative_ids, "
            f"CAST(len(item_ids) AS INTEGER) AS length FROM ni LEFT JOIN negs ON ni.uid = negs.uid)")


def q_next_item_rows():
    return f"{_next_item_ctes()} SELECT * FROM nir"


def q_train_batches():
    cols = ", ".join(f"flatten(list({c} ORDER BY uid)) AS {c}_ids, list(CAST(len({c}) AS INTEGER) ORDER BY uid) AS {c}_lengths"
                     for c in ("item_ids", "positive_ids", "negative_ids"))
    return (f"{_next_item_ctes()}, nb AS (SELECT *, (row_number() OVER (ORDER BY uid) - 1) // 16 AS batch_id FROM nir) "
            f"SELECT CAST(batch_id AS BIGINT) AS batch_id, list(uid ORDER BY uid) AS uid_ids, {cols} FROM nb GROUP BY batch_id")


def q_eval_rows():
    return f"{with_(ME, _seq_ctes())} SELECT * FROM erows"


def q_seq_batches():
    return (f"{with_(ME, _seq_ctes())}, nb AS (SELECT *, (row_number() OVER (ORDER BY uid) - 1) // 16 AS batch_id "
            f"FROM erows) SELECT CAST(batch_id AS BIGINT) AS batch_id, list(uid ORDER BY uid) AS uid_ids, "
            f"flatten(list(item_id_train ORDER BY uid)) AS item_id_train_ids, "
            f"list(CAST(len(item_id_train) AS INTEGER) ORDER BY uid) AS item_id_train_lengths, "
            f"flatten(list(item_id_valid ORDER BY uid)) AS item_id_valid_ids, "
            f"list(CAST(len(item_id_valid) AS INTEGER) ORDER BY uid) AS item_id_valid_lengths FROM nb GROUP BY batch_id")


def q_seq_positions():
    return (f"{with_(ME, _seq_ctes())}, ex AS (SELECT uid, len(item_id) AS n, "
            f"CAST(generate_subscripts(item_id, 1) - 1 AS INTEGER) AS pos, unnest(item_id) AS item FROM strain) "
            f"SELECT uid, pos, item, CAST(n - 1 - pos AS INTEGER) AS rev_pos, true AS valid FROM ex")


def q_shards():
    return (f"{with_(INTER)}, r AS (SELECT *, row_number() OVER (ORDER BY uid, timestamp, l_orderkey, l_linenumber, item_id, "
            f"is_organic, played_ratio_pct) - 1 "
            f"AS row_idx FROM inter) SELECT {INTER_COLS}, CAST(row_idx AS BIGINT) AS row_idx, "
            f"CAST(floor(row_idx / ceil((SELECT count(*) FROM inter) / {P.SHARDS})) AS INTEGER) AS shard FROM r")


ORACLES.update({
    "seq_prepare_train": q_seq_prepare_train,
    "seq_prepare_test": q_seq_prepare_test,
    "next_item_rows": q_next_item_rows,
    "train_batches": q_train_batches,
    "eval_rows": q_eval_rows,
    "seq_batches": q_seq_batches,
    "seq_positions": q_seq_positions,
    "shards": q_shards,
})


def q_unknown_item_bucket():
    s_ = split_ctes("mer", ME_COLS, P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP)
    return (f"{with_(MER, s_)}, ud AS (SELECT uid, dense_rank() OVER (ORDER BY uid) - 1 AS uid_idx FROM "
            f"(SELECT DISTINCT uid FROM train)), idd AS (SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx "
            f"FROM (SELECT DISTINCT item_id FROM train)) "
            f"SELECT CAST(u.uid_idx AS BIGINT) AS uid_idx, CAST(coalesce(i.item_idx, (SELECT count(*) FROM idd)) AS BIGINT) "
            f"AS item_idx, count(*) AS value FROM test t JOIN ud u ON t.uid = u.uid LEFT JOIN idd i ON t.item_id = i.item_id "
            f"GROUP BY 1, 2")


ORACLES["unknown_item_bucket"] = q_unknown_item_bucket


# ---------------------------------------------------------------- smaller building blocks

def q_listens_threshold():
    return f"{with_(INTER)} SELECT * FROM inter WHERE played_ratio_pct >= 50"


def q_targets():
    return f"{with_(INTER, _inter_split(0))} SELECT uid, item_id, count(*) AS n FROM test GROUP BY uid, item_id"


def q_binary_pairs():
    return f"{with_(INTER, _inter_split(0))} SELECT DISTINCT uid, item_id, 1.0::DOUBLE AS rating FROM train"


def q_item_index_from_one():
    return (f"{with_(ME)} SELECT item_id, CAST(dense_rank() OVER (ORDER BY item_id) AS BIGINT) AS item_idx "
            f"FROM (SELECT DISTINCT item_id FROM me)")


def q_seq_listen_lists():
    return (f"{with_(ME)} SELECT uid, list(item_id {ME_ORDER}) AS item_id, list(timestamp {ME_ORDER}) AS timestamp "
            f"FROM me WHERE played_ratio_pct >= 50 GROUP BY uid")


def q_user_history_lengths():
    return (f"{with_(ME)} SELECT uid, CAST(count(*) AS DOUBLE) AS n, round(log10(count(*)), {D}) AS log_n "
            f"FROM me GROUP BY uid")


def q_itemknn_topk_padded():
    k = 100
    return (f"{with_(ME, _me_split0(), _knn_base('train', 'k_'), _knn_ranked('train', 'k_', 1.0, 'user', 'rk'))}, "
            f"small AS (SELECT DISTINCT item_id FROM train ORDER BY item_id LIMIT {k}), "
            f"cnt AS (SELECT t.uid, coalesce(any_value(r.n), 0) AS n FROM (SELECT DISTINCT uid FROM train) t LEFT JOIN "
            f"(SELECT uid, count(*) AS n FROM rk GROUP BY uid) r USING (uid) GROUP BY t.uid HAVING coalesce(any_value(r.n), 0) < {k}), "
            f"cand AS (SELECT c.uid, c.n, s.item_id FROM cnt c CROSS JOIN small s "
            f"WHERE NOT EXISTS (SELECT 1 FROM rk r WHERE r.uid = c.uid AND r.item_id = s.item_id)), "
            f"fill AS (SELECT uid, CAST(n + j AS INTEGER) AS rank, item_id, 0.0::DOUBLE AS score FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY item_id) AS j FROM cand) WHERE j <= {k} - n) "
            f"SELECT uid, rank, item_id, round(score, {D}) AS score FROM rk UNION ALL SELECT * FROM fill")


def q_popularity_eval_listens():
    base = q_popularity_eval()
    return base.replace("FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)",
                        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
                        "WHERE floor(l.l_quantity * 2) >= 50)", 1)


ORACLES.update({
    "listens_threshold": q_listens_threshold,
    "targets": q_targets,
    "binary_pairs": q_binary_pairs,
    "item_index_from_one": q_item_index_from_one,
    "seq_listen_lists": q_seq_listen_lists,
    "user_history_lengths": q_user_history_lengths,
    "itemknn_topk_padded": q_itemknn_topk_padded,
    "popularity_eval_listens": q_popularity_eval_listens,
})


def q_seq_columns_chunked():
    cols = ", ".join(f"list({c} {ME_ORDER}) AS {c}" for c in ME_LIST_COLS)
    return (f"{with_(ME)}, c AS (SELECT *, CAST((row_number() OVER (PARTITION BY uid {ME_ORDER}) - 1) // "
            f"{P.SEQ_CHUNK} AS INTEGER) AS chunk FROM me) SELECT uid, chunk, {cols} FROM c GROUP BY uid, chunk")


ORACLES["seq_columns_chunked"] = q_seq_columns_chunked


def q_itemknn_topk_100():
    return (f"{with_(INTER, _inter_split(0), _knn_base('train', 'k_'), _knn_ranked('train', 'k_', P.INTER_KNN_HOUR, 'user', 'rk', 100))} "
            f"SELECT uid, rank, item_id, CAST(round(score * 1e{S}) AS BIGINT) // 1000 AS score_e6 FROM rk")


def q_scoreless_lists():
    return (f"{with_(ME, _me_split0(), _knn_base('train', 'k_'), _knn_ranked('train', 'k_', 1.0, 'user', 'rk', P.KNN_TOP_K))} "
            f"SELECT uid, rank, item_id, CAST(max(rank) OVER () - rank + 1 AS DOUBLE) AS score FROM rk")


def q_slices():
    return (f"{with_(INTER)}, r AS (SELECT *, row_number() OVER (ORDER BY uid, timestamp, l_orderkey, l_linenumber, item_id, "
            f"is_organic, played_ratio_pct) - 1 AS row_idx FROM inter) "
            f"SELECT {INTER_COLS}, row_idx, row_idx // {P.SLICE_ROWS} AS slice FROM r")


def q_binary_pairs_listens():
    s = split_ctes("lst", "uid, item_id, timestamp", P.INTER_TEST_TS, 0, P.INTER_GAP)
    return (f"{with_(INTER)}, lst AS (SELECT uid, item_id, timestamp FROM inter WHERE played_ratio_pct >= 50), {s} "
            f"SELECT DISTINCT uid, item_id, 1.0::DOUBLE AS rating FROM train")


def q_split_equivalence():
    sel = " UNION ALL ".join(f"SELECT '{x}' AS segment, count(*) AS rows, 0 AS only_flat, 0 AS only_lists FROM {x}" for x in ("train", "val", "test"))
    return f"{with_(MER, _me_split(True, 'mer'))} {sel}"


ORACLES.update({
    "itemknn_topk_100": q_itemknn_topk_100,
    "scoreless_lists": q_scoreless_lists,
    "slices": q_slices,
    "binary_pairs_listens": q_binary_pairs_listens,
    "split_equivalence": q_split_equivalence,
})


def q_seq_split_chunked():
    cols = ", ".join(f"list({c} {ME_ORDER}) AS {c}" for c in ME_LIST_COLS)
    cut = f"cut AS (SELECT *, CAST((row_number() OVER (PARTITION BY uid {ME_ORDER}) - 1) // {P.SEQ_CHUNK} AS INTEGER) AS chunk FROM mer)"
    s = split_ctes("cut", ME_COLS + ", chunk", P.ME_TEST_TS, P.ME_VAL_SIZE, P.ME_GAP, drop_unseen_items=True)
    return f"{with_(MER, cut, s)} SELECT uid, chunk, {cols} FROM test GROUP BY uid, chunk"


ORACLES.update({"seq_split_chunked": q_seq_split_chunked, "seq_prepare_chunked": lambda: q_seq_prepare_train(P.SEQ_MAX_LEN)})


# ---------------------------------------------------------------- ALS: what solved factors and best lists must show

def q_als_residual():
    return (f"{with_(INTER, _inter_split(0))} SELECT uid, count(DISTINCT item_id) AS n_items, CAST(0 AS DOUBLE) AS residual FROM train GROUP BY uid")


def q_als_lists():
    return (f"{with_(INTER, _inter_split(0))}, n AS (SELECT least(100, count(DISTINCT item_id)) AS n FROM train) "
            f"SELECT DISTINCT uid, n AS listed, n AS distinct_items, true AS descending, CAST(0 AS BIGINT) AS beaten_by, "
            f"CAST(0 AS DOUBLE) AS max_error FROM train, n")


# ---------------------------------------------------------------- BPR, mini-batch by mini-batch

def _bpr_ctes(trials: list[dict], passes: int = 2, batches: int = 2, blocks: int = 2, keep: str | None = None) -> str:
    """CTEs ending in ``bf1``, ``bf2`` (trial, kind, idx, v0, v1): the factors after each
    pass over ``train``; from the second pass on only trials of the table ``keep`` move."""
    seed, size = P.RANDOM_SEED, P.BPR_SMALL_BATCH

    def cte(name, sql):
        return f"{name} AS MATERIALIZED ({sql})"

    def digits(*parts):
        return f"('0x' || substr(md5(concat_ws(':', {', '.join(str(p) for p in parts)})), 1, 15))::BIGINT"

    rows = ", ".join(f"({t['trial']}, {dbl(t['learning_rate'])}, {dbl(t['regularization'])})" for t in trials)
    start = [f"(({digits(seed, 'kind', 'idx', d)} % 1000003) / 1000003.0::DOUBLE - 0.5::DOUBLE) * 0.2::DOUBLE AS v{d}" for d in (0, 1)]
    out = [f"bt(trial, lr, reg) AS (VALUES {rows})",
           cte("bp", "SELECT DISTINCT uid, item_id FROM train"),
           cte("bu", "SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS u FROM (SELECT DISTINCT uid FROM bp)"),
           cte("bi", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM bp)"),
           cte("bx", f"SELECT u, i, {digits(seed, 'u')} % {blocks} AS block FROM bp JOIN bu USING (uid) JOIN bi USING (item_id)"),
           cte("bids", "SELECT 0 AS kind, u AS idx FROM bu UNION ALL SELECT 1, i FROM bi"),
           cte("bf0", f"SELECT trial, kind, idx, {start[0]}, {start[1]} FROM bids, bt")]
    for p in range(passes):
        live = "bt" if p == 0 or keep is None else f"(SELECT * FROM bt WHERE trial IN (SELECT trial FROM {keep}))"
        out += [cte(f"bd{p}", f"SELECT block, u, i, h % (SELECT count(*) FROM bi) AS j, (row_number() OVER (PARTITION BY block ORDER BY h, u, i) - 1) // {size} AS b "
                              f"FROM (SELECT *, {digits(seed, p, 'u', 'i')} % {1 << 53} AS h FROM bx)"),
                cte(f"bv{p}", f"SELECT * FROM bd{p} d WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.u = d.u AND bx.i = d.j)"),
                cte(f"bs{p}_0", f"SELECT f.trial, g.block, f.kind, f.idx, f.v0, f.v1 FROM bf{p} f JOIN {live} t ON t.trial = f.trial, (SELECT unnest(range({blocks})) AS block) g")]
        for b in range(batches):
            s = f"bs{p}_{b}"
            out += [cte(f"be{p}_{b}", f"SELECT t.trial, t.lr, t.reg, d.block, d.u, d.i, d.j, x.v0 AS x0, x.v1 AS x1, y.v0 AS y0, y.v1 AS y1, z.v0 AS z0, z.v1 AS z1, "
                                      f"1.0 / (1.0 + exp(x.v0 * (y.v0 - z.v0) + x.v1 * (y.v1 - z.v1))) AS g FROM bv{p} d, {live} t "
                                      f"JOIN {s} x ON x.trial = t.trial AND x.block = d.block AND x.kind = 0 AND x.idx = d.u "
                                      f"JOIN {s} y ON y.trial = t.trial AND y.block = d.block AND y.kind = 1 AND y.idx = d.i "
                                      f"JOIN {s} z ON z.trial = t.trial AND z.block = d.block AND z.kind = 1 AND z.idx = d.j WHERE d.b = {b}"),
                    cte(f"bg{p}_{b}", f"SELECT trial, block, kind, idx, sum(d0) AS d0, sum(d1) AS d1 FROM ("
                                      f"SELECT trial, block, 0 AS kind, u AS idx, lr * (g * (y0 - z0) - reg * x0) AS d0, lr * (g * (y1 - z1) - reg * x1) AS d1 FROM be{p}_{b} "
                                      f"UNION ALL SELECT trial, block, 1, i, lr * (g * x0 - reg * y0), lr * (g * x1 - reg * y1) FROM be{p}_{b} "
                                      f"UNION ALL SELECT trial, block, 1, j, lr * (-g * x0 - reg * z0), lr * (-g * x1 - reg * z1) FROM be{p}_{b}) GROUP BY trial, block, kind, idx"),
                    cte(f"bs{p}_{b + 1}", f"SELECT s.trial, s.block, s.kind, s.idx, s.v0 + coalesce(g.d0, 0) AS v0, s.v1 + coalesce(g.d1, 0) AS v1 "
                                          f"FROM {s} s LEFT JOIN bg{p}_{b} g USING (trial, block, kind, idx)")]
        out += [cte(f"bn{p}", f"SELECT block, kind, idx, count(*) AS n FROM (SELECT block, 0 AS kind, u AS idx FROM bv{p} UNION ALL SELECT block, 1, i FROM bv{p} "
                              f"UNION ALL SELECT block, 1, j FROM bv{p}) GROUP BY block, kind, idx"),
                cte(f"bm{p}", f"SELECT trial, kind, idx, sum(n * v0) / sum(n) AS v0, sum(n * v1) / sum(n) AS v1 FROM bs{p}_{batches} JOIN bn{p} USING (block, kind, idx) "
                              f"GROUP BY trial, kind, idx"),
                cte(f"bf{p + 1}", f"SELECT f.trial, f.kind, f.idx, coalesce(m.v0, f.v0) AS v0, coalesce(m.v1, f.v1) AS v1 FROM bf{p} f LEFT JOIN bm{p} m USING (trial, kind, idx)")]
        if keep and p == 0:
            out += [_bpr_value_ctes(1), f"{keep} AS (SELECT trial FROM bval1 ORDER BY value DESC, trial LIMIT {-(-len(trials) // 2)})"]
    return ", ".join(out)


def _bpr_value_ctes(p: int) -> str:
    """CTEs ending in ``bval{p}(trial, value)``: the validation metric of the factors after pass p."""
    lists = (f"blist{p} AS MATERIALIZED (SELECT * FROM (SELECT trial, uid, item_id, row_number() OVER (PARTITION BY trial, uid ORDER BY score DESC, item_id) AS rank FROM ("
             f"SELECT x.trial, bu.uid, bi.item_id, round(x.v0 * y.v0 + x.v1 * y.v1, {S}) AS score FROM bf{p} x JOIN bu ON x.kind = 0 AND bu.u = x.idx "
             f"JOIN bf{p} y ON y.kind = 1 AND y.trial = x.trial JOIN bi ON bi.i = y.idx WHERE bu.uid IN (SELECT uid FROM val))) WHERE rank <= 100)")
    return ", ".join([lists, metric_ctes(f"blist{p}", "val", "1", [P.VALIDATION_METRIC], ["trial"], shared=False, name=f"brep{p}"),
                      f"bval{p} AS (SELECT trial, value FROM brep{p})"])


def q_bpr_factors():
    return (f"{with_(INTER, _inter_split(), _bpr_ctes(P.bpr_small_trials()[:1]))} "
            f"SELECT CASE WHEN kind = 0 THEN 'user' ELSE 'item' END AS side, CASE WHEN kind = 0 THEN uid ELSE item_id END AS id, "
            f"round(v0, {D}) AS v0, round(v1, {D}) AS v1 FROM bf2 LEFT JOIN bu ON kind = 0 AND bu.u = idx LEFT JOIN bi ON kind = 1 AND bi.i = idx")


def q_bpr_trials():
    trials = P.bpr_small_trials()
    return (f"{with_(INTER, _inter_split(), _bpr_ctes(trials, keep='bkeep'), _bpr_value_ctes(2))}, "
            f"bend AS (SELECT trial, value FROM bval2 WHERE trial IN (SELECT trial FROM bkeep)) "
            f"SELECT CAST(bt.trial AS INTEGER) AS trial, round(lr, {D}) AS learning_rate, round(reg, {D}) AS regularization, "
            f"CAST(CASE WHEN e.trial IS NULL THEN 1 ELSE 2 END AS INTEGER) AS passes, round(coalesce(e.value, v.value), {D}) AS value, "
            f"bt.trial = (SELECT trial FROM bend ORDER BY value DESC, trial LIMIT 1) AS chosen "
            f"FROM bt JOIN bval1 v ON v.trial = bt.trial LEFT JOIN bend e ON e.trial = bt.trial")


ORACLES.update({
    "als_residual": q_als_residual,
    "als_lists": q_als_lists,
    "bpr_factors": q_bpr_factors,
    "bpr_trials": q_bpr_trials,
})


# ---------------------------------------------------------------- sparse inverse, step by step

def _inverse_ctes(train: str, density: float, steps: int = 4, tol: float = 1e-4, l2: float = 10.0) -> str:
    """CTEs ending in ``icol(i, j, p)``, the kept columns, with ``ia`` (A) and ``ix`` (X)."""
    def cte(name, sql):
        return f"{name} AS MATERIALIZED ({sql})"

    def largest(src, value):
        return (f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(abs({value}), 9) DESC, i) AS k "
                f"FROM {src}) WHERE k <= (SELECT n FROM inn)")

    out = [cte("ix", f"SELECT uid, item_id, CAST(count(*) AS DOUBLE) AS x FROM {train} GROUP BY uid, item_id"),
           cte("inn", f"SELECT greatest(1, ceil({density!r} * count(DISTINCT item_id))) AS n FROM ix"),
           cte("ia", f"SELECT a.item_id AS i, b.item_id AS j, sum(a.x * b.x) + CASE WHEN a.item_id = b.item_id THEN {l2!r} ELSE 0.0 END AS v "
                     "FROM ix a JOIN ix b ON a.uid = b.uid GROUP BY a.item_id, b.item_id"),
           cte("idg", "SELECT i, v AS d FROM ia WHERE i = j"),
           cte("ir0", "SELECT i, i AS j, CAST(1 AS DOUBLE) AS r FROM idg")]
    for t in range(1, steps + 1):
        out += [cte(f"iz{t}", largest(f"(SELECT r.i, r.j, r.r / idg.d AS z FROM ir{t - 1} r JOIN idg ON idg.i = r.i)", "z")),
                cte(f"iq{t}", f"SELECT a.i, z.j, sum(a.v * z.z) AS q FROM iz{t} z JOIN ia a ON a.j = z.i GROUP BY a.i, z.j"),
                cte(f"ib{t}", f"SELECT i, j, sum(r) AS r, sum(q) AS q FROM (SELECT i, j, r, CAST(0 AS DOUBLE) AS q FROM ir{t - 1} "
                              f"UNION ALL SELECT i, j, CAST(0 AS DOUBLE), q FROM iq{t}) GROUP BY i, j"),
                cte(f"il{t}", f"SELECT j, sum(r * q) / sum(q * q) AS alpha FROM ib{t} GROUP BY j"),
                cte(f"ir{t}", f"SELECT b.i, b.j, b.r - l.alpha * b.q AS r FROM ib{t} b JOIN il{t} l ON l.j = b.j WHERE abs(b.r - l.alpha * b.q) >= {tol!r}")]
    steps_sql = " UNION ALL ".join(f"SELECT z.i, z.j, l.alpha * z.z AS p FROM iz{t} z JOIN il{t} l ON l.j = z.j" for t in range(1, steps + 1))
    out += [cte("ip", f"SELECT i, j, sum(p) AS p FROM ({steps_sql}) GROUP BY i, j"),
            cte("icol", f"SELECT i, j, p FROM ip WHERE i = j UNION ALL SELECT i, j, p FROM ({largest('(SELECT * FROM ip WHERE i <> j)', 'p')})")]
    return ", ".join(out)


def _inverse_ranked(users: str, k: int) -> str:
    """CTE ``ilist(uid, rank, item_id, score)`` for the users of a table."""
    return (f"isc AS (SELECT x.uid, c.j AS item_id, round(sum(x.x * -c.p / d.p), {S}) AS score FROM ix x JOIN icol c ON c.i = x.item_id AND c.i <> c.j "
            f"JOIN icol d ON d.j = c.j AND d.i = d.j WHERE x.uid IN (SELECT uid FROM {users}) GROUP BY x.uid, c.j), "
            f"ilist AS (SELECT * FROM (SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score "
            f"FROM isc) WHERE rank <= {k})")


def q_sparse_inverse_residual():
    return (f"{with_(INTER, _inter_split(0), _inverse_ctes('train', P.SPARSE_LOG_DENSITY))}, "
            f"q AS (SELECT a.i, c.j, sum(a.v * c.p) AS q FROM icol c JOIN ia a ON a.j = c.i GROUP BY a.i, c.j), "
            f"res AS (SELECT j, sum(power(CASE WHEN i = j THEN 1 ELSE 0 END - q, 2)) AS residual FROM q GROUP BY j) "
            f"SELECT j AS item_id, entries, round(residual, {D}) AS residual FROM (SELECT j, count(*) AS entries FROM icol GROUP BY j) JOIN res USING (j)")


def q_sparse_linear_topk():
    return (f"{with_(INTER, _inter_split(0), _inverse_ctes('train', P.SPARSE_LOG_DENSITY), _inverse_ranked('test', 150))}, "
            f"fill AS (SELECT uid, CAST(r.range AS INTEGER) AS rank, (SELECT min(item_id) FROM ix) AS item_id, CAST(-1 AS DOUBLE) AS score "
            f"FROM (SELECT DISTINCT uid FROM test) u, range(1, 151) r WHERE r.range > (SELECT count(*) FROM ilist l WHERE l.uid = u.uid)) "
            f"SELECT uid, rank, item_id, CAST(floor(CAST(round(score * 1e{S}) AS BIGINT) / 100000.0) AS BIGINT) AS score_e4 "
            f"FROM (SELECT * FROM ilist UNION ALL SELECT * FROM fill)")


def q_sparse_linear_eval():
    m = metric_ctes("ilist", "test", "SELECT count(DISTINCT item_id) FROM lm", P.REPORT_METRICS, [], shared=False)
    return (f"{with_(ME, _me_split0(), _inverse_ctes('train', P.SPARSE_DENSITY), _inverse_ranked('test', 150), m)} "
            f"SELECT metric, k, round(value, {D}) AS value FROM rep")


ORACLES.update({
    "sparse_inverse_residual": q_sparse_inverse_residual,
    "sparse_linear_topk": q_sparse_linear_topk,
    "sparse_linear_eval": q_sparse_linear_eval,
})


def oracle_sql() -> dict[str, str]:
    return {name: fn() for name, fn in ORACLES.items()}
