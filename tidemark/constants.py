"""Labels, thresholds and patterns that results depend on."""

LABELS = ("negative", "neutral", "positive")
SIGN = {"negative": -1, "neutral": 0, "positive": 1}
LABEL_THRESHOLD = 0.15
WINDOW_SESSIONS, BASELINE_SESSIONS = 5, 20
WATCH_Z, HIGH_Z = -1.5, -2.0
MIN_ARTICLES, MIN_BASELINE_DAYS = 2, 10
SIGMA_FLOOR = 0.10
LEVELS = ("high", "watch", "normal", "insufficient")
#: The market opens at 09:00 at UTC+8.
OPEN_UTC_HOUR = 1
SPLIT_RATIOS, SPLIT_SEED = (0.70, 0.15, 0.15), 42
CACHE_SECONDS = 3600
TICKER_PATTERN = r"^[A-Z]{1,5}(\.[A-Z])?\z"
PRICE_REPORT_PATTERNS = (r"跌\d+元", r"漲\d+元", r"收跌", r"收漲", r"跌停", r"漲停", r"開盤", r"盤中", r"成交量", r"三大法人", r"融資", r"融券", r"[跌漲挫](逾|近)?[\d,.]+點")
FORUM_MARKER = "股市爆料同學會"
TARGET_DELIMITER = " ||| "
EVENT_ABNORMAL, EVENT_RAW, EVENT_GAP = -0.07, -0.05, 20
KAPPA_ADOPT, KAPPA_DISCLOSE, MIN_COVERAGE, MIN_PAIRS = 0.60, 0.40, 0.95, 200
EXPORT_MIN_COVERAGE = 0.70
JUDGE_ALPHA, JUDGE_NEGATIVE_RECALL, JUDGE_AGREEMENT, JUDGE_KAPPA = 0.05, 0.60, 0.70, 0.50
MIN_EVENTS, LEAK_TOLERANCE = 5, 0.05
RECENT_LIMIT, STALE_HOURS, NEWS_LIMIT, NEWS_MOST = 6, 48, 20, 100
