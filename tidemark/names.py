"""Column names and default settings shared by the operators."""

# Column names of the tables.
USER = "did"
ITEM = "subject_uri"
POST = "at_uri"
TS = "record_created_at"
HOUR = "like_hour_bucket"
NEG_HOUR = "negative_hour_bucket"
PRIOR = "prior_cumulative_likes"
EMB = "emb_idx"
AUTHOR = "author_did"
AUTHOR_IDX = "author_idx"

# Default settings.
MAX_LIKES_PER_USER = 100
MIN_LIKES_PER_USER = 2
NEGATIVES_PER_HOUR = 1000
NEGATIVE_ALPHA = 0.15
MIN_LIKES_PER_NEGATIVE = 50
NEGATIVE_SAMPLE_PCT = 0.1
SEED = 42
EMA_ALPHA = 0.1
MAX_HISTORY_LEN = 20
MIN_AUTHOR_SUPPORT = 20
EXTRA_NEGATIVES = 64
TIME_DELTA_HOURS = [1, 3, 6, 12, 24, 72, 168, 720, 2160]
TOP_KS = [30]
AUTHOR_PAD = 0
AUTHOR_UNK = 1
FIRST_AUTHOR = 2
ELIGIBLE_HOURS = 24
BIN_EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 50, 100, 500]
EMBED_DIMS = {
    "all_MiniLM_L6_v2": 384,
    "all_MiniLM_L12_v2": 384,
    "all-MiniLM-L6-v2": 384,
    "all-MiniLM-L12-v2": 384,
    "paraphrase-MiniLM-L6-v2": 384,
    "multi-qa-MiniLM-L6-cos-v1": 384,
}
