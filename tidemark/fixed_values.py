"""Results depend on these exact numbers, names and dates."""

# Recency edges in seconds; an age falls into the first bin whose edge is not below it.
RECENCY_EDGES = (
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000,
    11664000, 15552000,
    31536000,
)

# Hours at which a new part of the day starts, and the default zone.
DAY_PERIOD_EDGES = (6, 11, 14, 18, 22)
DEFAULT_TZ_HOURS = 8.0

# Public holidays of the default calendar, 2025 and 2026.
HOLIDAYS = (
    "2025-01-01",
    "2025-01-28", "2025-01-29", "2025-01-30", "2025-01-31",
    "2025-02-01", "2025-02-02", "2025-02-03", "2025-02-04",
    "2025-04-04", "2025-04-05", "2025-04-06",
    "2025-05-01", "2025-05-02", "2025-05-03", "2025-05-04", "2025-05-05",
    "2025-05-31", "2025-06-01", "2025-06-02",
    "2025-10-01", "2025-10-02", "2025-10-03", "2025-10-04",
    "2025-10-05", "2025-10-06", "2025-10-07", "2025-10-08",
    "2026-01-01", "2026-01-02", "2026-01-03",
    "2026-02-15", "2026-02-16", "2026-02-17", "2026-02-18",
    "2026-02-19", "2026-02-20", "2026-02-21",
    "2026-04-04", "2026-04-05", "2026-04-06",
    "2026-05-01", "2026-05-02", "2026-05-03", "2026-05-04", "2026-05-05",
    "2026-06-19", "2026-06-20", "2026-06-21",
    "2026-09-25", "2026-09-26", "2026-09-27",
    "2026-10-01", "2026-10-02", "2026-10-03", "2026-10-04",
    "2026-10-05", "2026-10-06", "2026-10-07", "2026-10-08",
)

# The twelve item-history features, in vector order, and the fids they take.
ITEM_HISTORY_NAMES = (
    "item_hist_cnt_all_log1p",
    "item_hist_active_hour_nuniq_log1p",
    "item_hist_active_day_nuniq",
    "item_hist_peak_hour_ratio",
    "item_hist_alive_hours_log1p",
    "item_hist_recency_hours_log1p",
    "item_hist_cnt_1h_log1p",
    "item_hist_cnt_6h_log1p",
    "item_hist_cnt_1d_log1p",
    "item_hist_trend_cnt_1h_1d",
    "item_hist_hour_entropy",
    "item_hist_day_entropy",
)
ITEM_HISTORY_FIDS = tuple(range(10001, 10013))
TRAILING_HOURS = (1, 6, 24)

# Vocabulary sizes of hour, weekday and day period; fids of the four cyclical values.
CALENDAR_VOCABS = (24, 7, 6)
CALENDAR_DENSE_FIDS = (990000, 990001, 990002, 990003)

# Blocks of the user_dense vector, half-open; embedding blocks are never rescaled.
USER_DENSE_BLOCKS = {
    "sum_embedding": (0, 256),
    "side_a": (256, 568),
    "ads_embedding": (568, 888),
    "side_b": (888, 918),
}
UNSCALED_RANGES = (USER_DENSE_BLOCKS["sum_embedding"], USER_DENSE_BLOCKS["ads_embedding"])
DENSE_STD_FLOOR = 1e-6

# Value-scale branches: name, fids, transform.
USER_DENSE_BRANCHES = (
    ("ud_fid61", (61,), "raw"),
    ("ud_fid87", (87,), "raw"),
    ("ud_emb_89_90_91", (89, 90, 91), "raw"),
    ("ud_fid120", (120,), "raw"),
    ("ud_heavy_count_62_66", (62, 63, 64, 65, 66), "log1p_nonneg"),
    ("ud_mid_count_118_121_123", (118, 121, 123), "log1p_nonneg"),
    ("ud_sparse_score_130_131", (130, 131), "signed_log1p"),
    ("ud_wide_score_132", (132,), "raw"),
)
ITEM_DENSE_BRANCHES = (
    ("id_emb_127_128", (127, 128), "raw"),
    ("id_score_124", (124,), "raw"),
    ("id_heavy_129", (129,), "signed_log1p"),
    ("id_hist_10001_10012", ITEM_HISTORY_FIDS, "raw"),
)
OTHER_BRANCH = "dense_other"

# Default sizes.
DEFAULT_SEQUENCE_LENGTH = 256
DEFAULT_HASH_THRESHOLD = 1_000_000
DEFAULT_HASH_BUCKETS = 500_000
ID_VOCAB_THRESHOLD = 10_000
