"""Values that results depend on, kept together and in natural order."""

# ---------------------------------------------------------------------------
# Enumerations, field names and formats that must equal the ones
# used by producers and consumers of usage facts. Not derived from anything.
# ---------------------------------------------------------------------------

AGENTS = ("claude", "codex")

TOKEN_KINDS = (
    "input_nocache",
    "cache_read",
    "cache_write_5m",
    "cache_write_1h",
    "cache_write_unknown",
    "output",
)

MODES = ("fast", "normal", "unknown")

SOURCE_QUALITIES = ("ok", "first_event_delta")

# Worst first.
PRICING_STATUSES = ("unpriced", "lower_bound", "priced")

# Kinds a catalog can price directly.
RATE_FIELDS = ("input_nocache", "cache_read", "cache_write_5m", "cache_write_1h", "output")

UNKNOWN_MODEL = "(unknown)"

# Suffixes a model name may carry without being another model.
BRACKET_SUFFIX = r"\[[^\]]*\]$"
DATE_SUFFIX = r"@\d{6,8}$"
VARIANT_SUFFIXES = ("1m", "200k", "fast", "latest")

# Collaboration modes known to bill at the normal rate.
NORMAL_COLLABORATION_MODES = ("default", "standard", "normal")

CATALOG_SCHEMA_VERSION = "1"
CATALOG_CURRENCY = "USD"
CATALOG_UNIT = "per_mtok"
TOKENS_PER_RATE = 1_000_000

REPORT_DIMENSIONS = ("month", "agent", "model", "token-kind")

REPORT_COLUMNS = (
    "month",
    "agent",
    "model",
    "token_kind",
    "tokens",
    "priced_tokens",
    "unpriced_tokens",
    "estimated_cost_usd",
    "credits",
    "pricing_status",
)

FACT_COLUMNS = (
    "occurred_at_utc",
    "agent",
    "session_id",
    "model_raw",
    "model_key",
    "token_kind",
    "tokens",
    "mode",
    "source_quality",
)

REPORT_SCHEMA_VERSION = "1"
DIGEST_PROTOCOL_VERSION = "measure/v1"

# A thread's own total may be off by this much before it is reported.
RECONCILE_TOKENS = 100
RECONCILE_SHARE = "0.01"

# A file last written this long before a window cannot hold an event inside it.
FILE_AGE_SLACK = "INTERVAL 1 DAY"
