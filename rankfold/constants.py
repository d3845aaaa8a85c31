"""Fixed values that must equal the reference's for matching results.

FIXED VALUES (do not change; they define the benchmark protocol):
  seconds per hour 3600, seconds per day 86400
  gap between segments: 1800 seconds (half an hour)
  validation window: 86400 seconds (one day); test window: 86400 seconds
  last timestamp of the dataset: 26000000; test starts at 26000000 - 86400
  listen threshold: played_ratio_pct >= 50
  number of ranked items: 100
  default report metrics, in order:
    ndcg@10 ndcg@50 ndcg@100 dcg@10 dcg@50 dcg@100
    recall@10 recall@50 recall@100 coverage@10 coverage@50 coverage@100
  event kinds of the multi-event log, in enum order:
    listen dislike like undislike unlike
  decay per hyperparameter period: 0.9
  zero-elimination threshold: 1e-9; norm epsilon: 1e-12
  popularity hour grid: 0.5 1 2 3 6 12 24
  ItemKNN hour grids:
    50m likes:   0 0.001 0.25 0.5 1 2 3 4 6
    50m listens: 0 0.001 0.002 0.004 0.008 0.016 0.032 0.064 0.128 0.256 0.5 1.0 2
    500m likes:  0 0.002 0.004 0.008 0.016 0.032 0.064 0.128 0.256 0.5 1.0
    500m listens: 0 0.001 0.002 0.004 0.008
  trials per size (ALS/BPR): 50m 10, 500m 2, 5b 2; refit seeds 41 42 43
  random recommender repeats: 2
  sparse linear model: l2 10.0, weight density 5e-5, top 150 per user
  sequence model input: last 200 events, item index from 1 (0 = padding)
"""

HOUR_SECONDS = 3600
DAY_SECONDS = 86400

GAP_SIZE = 1800
VAL_SIZE = 86400
TEST_SIZE = 86400

LAST_TIMESTAMP = 26000000
TEST_TIMESTAMP = LAST_TIMESTAMP - TEST_SIZE

TRACK_LISTEN_THRESHOLD = 50

NUM_RANKED_ITEMS = 100

METRICS = [
    "ndcg@10", "ndcg@50", "ndcg@100",
    "dcg@10", "dcg@50", "dcg@100",
    "recall@10", "recall@50", "recall@100",
    "coverage@10", "coverage@50", "coverage@100",
]

EVENT_KINDS = ["listen", "dislike", "like", "undislike", "unlike"]
# file name of each kind's flat table
EVENT_FILES = {"listen": "listens", "dislike": "dislikes", "like": "likes",
               "undislike": "undislikes", "unlike": "unlikes"}

DECAY = 0.9
ZERO_THRESHOLD = 1e-9
NORM_EPS = 1e-12

POPULARITY_HOURS = [0.5, 1, 2, 3, 6, 12, 24]
ITEMKNN_GRIDS = {
    "50m": {
        "likes": [0, 0.001, 0.25, 0.5, 1, 2, 3, 4, 6],
        "listens": [0, 0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064, 0.128, 0.256, 0.5, 1.0, 2],
    },
    "500m": {
        "likes": [0, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064, 0.128, 0.256, 0.5, 1.0],
        "listens": [0, 0.001, 0.002, 0.004, 0.008],
    },
}
TRIALS_PER_SIZE = {"50m": 10, "500m": 2, "5b": 2}
REFIT_SEEDS = [41, 42, 43]
RANDOM_REPEATS = 2

SPARSE_L2 = 10.0
SPARSE_DENSITY = 5e-5
SPARSE_TOP_K = 150

MAX_SEQ_LEN = 200
