"""Parameters of the registered queries (shared by the Spark side and the SQL
oracle so both compute the same thing)."""

from rankfold import constants as C

# interactions adapter (orders x lineitem), timestamps in seconds since 1970
INTER_TEST_TS = 975628800
INTER_VAL_SIZE = 180 * C.DAY_SECONDS
INTER_GAP = 10 * C.DAY_SECONDS
# hours: 0 (counts), one month, one quarter, one year
INTER_HOURS = [0.0, 720.0, 2160.0, 8760.0]
INTER_TOPK_HOUR = 720.0

# multi-event adapter (events), timestamps in seconds since 2024-01-01
ME_TEST_TS = 28 * C.DAY_SECONDS
ME_GAP = 1800
ME_VAL_SIZE = 2 * C.DAY_SECONDS
ME_KNN_HOUR = 24.0
ME_KNN_HOURS = [0.0, 1.0, 24.0]

VALIDATION_METRIC = "ndcg@100"
REPORT_METRICS = C.METRICS
ALL_METRICS = [f"{m}@{k}" for m in ("recall", "precision", "mrr", "dcg", "ndcg", "coverage") for k in (10, 50, 100)]

SCORE_DIGITS = 9   # scores are rounded to this many digits before ranking
OUT_DIGITS = 6     # doubles in registered outputs are rounded to this many digits

RANDOM_SEED = 42
RANDOM_REPEATS = 2
# train events that the sequence queries keep of each user
SEQ_LIST_LEN = 50
# shorter than the test table's histories, so that the cut acts: histories in bounded rows, and tests
SEQ_MAX_LEN = 6
SEQ_CHUNK = 16
SHARDS = 8
SLICE_ROWS = 10_000

# item models are fitted on one kind of event of the multi-event log, and their
# registered lists are shorter than its catalogue
KNN_KIND = "listen"
KNN_TOP_K = 20
# the interactions log has some hundred thousand items at any size: lists of 100 are a cut
INTER_KNN_HOUR = 8760.0
# passes of the registered BPR fit (the protocol's default)
BPR_PASSES = 100
# mini-batch of the small BPR fits that SQL repeats step by step: two a block at sf0.01
BPR_SMALL_BATCH = 1 << 14
# weight density of the registered sparse linear queries (the reference's value
# is meant for millions of items; here it would leave one weight an item)
SPARSE_DENSITY = 0.1
# on the interactions log (thousands of items at sf0.01)
SPARSE_LOG_DENSITY = 0.004


def bpr_small_trials() -> list[dict]:
    """Ten sampled settings for two passes each."""
    from rankfold.operators.tuning import sample_trials
    space = {"learning_rate": (1e-3, 0.1, "float"), "regularization": (1e-5, 1.0, "float")}
    return [t | {"iterations": 2} for t in sample_trials(10, 0, space)]


def train_end(test_ts: int, val_size: int, gap: int) -> int:
    return test_ts - gap - val_size - (gap if val_size else 0)
