"""What every query should give, as SQL over the same tables.

Inputs share their derivation rules with :mod:`tokenledger.plans.inputs`. The answers do not go through
log lines, JSON or the operators: they are worked out from the columns of the tables.
"""

from __future__ import annotations

from tokenledger.fixed_values import RATE_FIELDS, REPORT_DIMENSIONS
from tokenledger.plans import inputs
from tokenledger.plans.queries import HISTORY_NAME, MODEL_NAME

MEASURES = "tokens, priced_tokens, unpriced_tokens, estimated_cost_usd, credits, pricing_status"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _columns(fields: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in fields.items())


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    def literal(value) -> str:
        return "NULL" if value is None else f"'{value}'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _text(moment: str) -> str:
    return f"strftime({moment}, '%Y-%m-%dT%H:%M:%S.%f')"


def _double(exact: str) -> str:
    # Through text: the nearest double to a decimal, whatever its size.
    return f"CAST(CAST({exact} AS VARCHAR) AS DOUBLE)"


def _key(n: str) -> str:
    return (
        f"CASE WHEN {n} % 8 IN (0, 1, 2) THEN 'model-a' WHEN {n} % 8 IN (3, 4) THEN 'claude-x-4-7' "
        f"WHEN {n} % 8 = 5 THEN 'model-b-alias' WHEN {n} % 8 = 6 THEN 'model-unlisted' ELSE '(unknown)' END"
    )


# --- facts and prices -------------------------------------------------------------------------------

FACTS = f"""facts AS (
  SELECT {_columns(inputs.FACT_FIELDS)}, {_key('l_suppkey')} AS model_key FROM lineitem)"""

NAMES = _values(
    "names",
    "name, resolved_key, multiplier",
    [
        (name, key, multiplier)
        for key, alias, multiplier, _ in inputs.TEST_MODELS
        for name in (key, alias)
        if name
    ],
)
PERIODS = _values(
    "periods",
    "period_model, rate_id, period_from, period_until",
    [(p[0], p[1], p[2][:10], (p[3] or "9999-12-31")[:10]) for p in inputs.TEST_PERIODS],
)
RATES = _values(
    "rates",
    "rate_model, rate_from, rate_until, rate_field, usd",
    [
        (p[0], p[2][:10], (p[3] or "9999-12-31")[:10], field, usd)
        for p in inputs.TEST_PERIODS
        for field, usd in zip(RATE_FIELDS, p[4:])
        if usd is not None
    ],
)
CREDITS = _values(
    "credit_rates",
    "credit_model, credit_field, credit",
    [
        (key, field, value)
        for key, _, _, credit in inputs.TEST_MODELS
        if credit
        for field, value in zip(("input_nocache", "cache_read", "output"), credit)
        if value
    ],
)


def _priced(facts: str = "facts") -> str:
    """Every fact with exact cost and credits."""
    factor = "CAST(CASE WHEN f.mode = 'fast' THEN n.multiplier ELSE '1' END AS DECIMAL(7,4))"
    scale = "CAST(f.tokens AS DECIMAL(6,0)) * CAST('0.000001' AS DECIMAL(6,6))"
    kind = "CASE f.token_kind WHEN 'cache_write_unknown' THEN 'cache_write_5m' ELSE f.token_kind END"
    return f"""priced AS (
  SELECT f.*, n.resolved_key,
    {scale} * (CAST(r.usd AS DECIMAL(19,9)) * {factor}) AS cost,
    {scale} * (CAST(CASE WHEN r.usd IS NOT NULL THEN c.credit END AS DECIMAL(19,9)) * {factor}) AS credit,
    CASE WHEN r.usd IS NULL THEN 'unpriced' WHEN f.token_kind = 'cache_write_unknown' THEN 'lower_bound'
      ELSE 'priced' END AS status
  FROM {facts} f
  LEFT JOIN names n ON n.name = f.model_key
  LEFT JOIN rates r ON r.rate_model = n.resolved_key AND r.rate_field = {kind}
    AND f.occurred_at_utc >= CAST(r.rate_from AS TIMESTAMP)
    AND f.occurred_at_utc < CAST(r.rate_until AS TIMESTAMP)
  LEFT JOIN credit_rates c ON c.credit_model = n.resolved_key AND c.credit_field = {kind})"""


PRICED = (FACTS, NAMES, RATES, CREDITS, _priced())
_MEASURES = f"""
  CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(coalesce(sum(tokens) FILTER (status <> 'unpriced'), 0) AS BIGINT) AS priced_tokens,
  CAST(coalesce(sum(tokens) FILTER (status = 'unpriced'), 0) AS BIGINT) AS unpriced_tokens,
  {_double('coalesce(sum(cost), 0)')} AS estimated_cost_usd,
  {_double('coalesce(sum(credit), 0)')} AS credits,
  CASE WHEN bool_or(status = 'unpriced') THEN 'unpriced'
    WHEN bool_or(status = 'lower_bound') THEN 'lower_bound' ELSE 'priced' END AS pricing_status"""
_NULL = "CAST(NULL AS VARCHAR)"


def _month(zone: str = "UTC", moment: str = "occurred_at_utc") -> str:
    local = moment if zone == "UTC" else f"({moment} AT TIME ZONE 'UTC') AT TIME ZONE '{zone}'"
    return f"strftime({local}, '%Y-%m')"


def _report(dims: tuple[str, ...], zone: str = "UTC", ctes: tuple[str, ...] = PRICED) -> str:
    columns = {
        "month": ("month", _month(zone)),
        "agent": ("agent", "agent"),
        "model": ("model", "model_key"),
        "token-kind": ("token_kind", "token_kind"),
    }
    shown = ", ".join(
        f"{expr if dim in dims else _NULL} AS {name}" for dim, (name, expr) in columns.items()
    )
    keys = ", ".join(columns[dim][1] for dim in dims)
    return _with(*ctes) + f"SELECT {shown}, {_MEASURES} FROM priced GROUP BY {keys}"


def _report_by(dim: str, name: str, zone: str = "UTC") -> str:
    return f"SELECT {name}, {MEASURES} FROM ({_report((dim,), zone)})"


REQUESTED = f"requested AS (SELECT DISTINCT {inputs.REQUESTED_SESSION} AS session_id FROM supplier)"
_DIGEST_DIMS = "session_id, agent, model_key, token_kind"
DIGEST = _with(*PRICED, REQUESTED) + f"""
, chosen AS (SELECT * FROM priced WHERE session_id IN (SELECT session_id FROM requested)),
lines AS (
  SELECT 'session_row' AS scope, session_id, agent, model_key AS model, token_kind, 1 AS matched, {_MEASURES}
  FROM chosen GROUP BY {_DIGEST_DIMS}
  UNION ALL
  SELECT 'total_row', NULL, agent, model_key, token_kind, 1, {_MEASURES}
  FROM chosen GROUP BY agent, model_key, token_kind
  UNION ALL
  SELECT 'session', session_id, NULL, NULL, NULL, 1, {_MEASURES} FROM chosen GROUP BY session_id
  UNION ALL
  SELECT 'session', session_id, NULL, NULL, NULL, 0, 0, 0, 0, 0.0, 0.0, 'priced'
  FROM requested WHERE session_id NOT IN (SELECT session_id FROM chosen)
  UNION ALL
  SELECT 'total', NULL, NULL, NULL, NULL, 1, {_MEASURES} FROM chosen)
SELECT scope, session_id, agent, model, token_kind, CAST(matched AS INT) AS matched, {MEASURES} FROM lines
"""

_FACT_RANGE = f"{_text('min(occurred_at_utc)')} AS first_at, {_text('max(occurred_at_utc)')} AS last_at"
_COUNTED = "count(*) AS facts, CAST(sum(tokens) AS BIGINT) AS tokens"


# --- session logs -----------------------------------------------------------------------------------

SESSIONS = (
    f"ev AS (SELECT *, {_columns(inputs.SESSION_FIELDS)} FROM events)",
    """live AS (
  SELECT *, first_value(own_id IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_id
  FROM ev WHERE NOT corrupt AND NOT blank_line)""",
    """usable AS (
  SELECT *, coalesce(own_id, first_id) AS session_id FROM live
  WHERE line_type = 'assistant' AND NOT no_usage)""",
    "timed AS (SELECT * FROM usable WHERE NOT bad_time)",
)


def _usage(kind: str, tokens: str, readable: str) -> str:
    return f"""
  SELECT ts AS occurred_at_utc, 'claude' AS agent, session_id,
    coalesce(model_name, '(unknown)') AS model_raw, {_key('event_id')} AS model_key,
    '{kind}' AS token_kind, {tokens} AS tokens,
    CASE speed WHEN 'fast' THEN 'fast' WHEN 'standard' THEN 'normal' ELSE 'unknown' END AS mode,
    'ok' AS source_quality
  FROM timed WHERE {readable} AND {tokens} > 0"""


_KNOWN = "(CASE WHEN ttl THEN n_write - n_5m - n_1h ELSE n_write END)"
SESSION_FACTS = "session_facts AS (" + " UNION ALL ".join(
    [
        _usage("input_nocache", "n_input", "NOT bad_input"),
        _usage("cache_read", "n_read", "NOT bad_input"),
        _usage("cache_write_5m", "n_5m", "NOT bad_input AND ttl"),
        _usage("cache_write_1h", "n_1h", "NOT bad_input AND ttl"),
        _usage("cache_write_unknown", _KNOWN, "NOT bad_input"),
        _usage("output", "n_output", "NOT bad_input AND NOT bad_output"),
    ]
) + ")"

# --- rollout logs -----------------------------------------------------------------------------------

_IN_FILE = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_IN_WEEK = "(PARTITION BY user_id, week ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
ROLLOUTS = (
    f"re AS (SELECT *, {_columns(inputs.ROLLOUT_FIELDS)} FROM events)",
    f"""counted AS (
  SELECT *,
    CAST(sum(a_input) OVER {_IN_WEEK} AS BIGINT) AS t_input,
    CAST(sum(a_cached) OVER {_IN_WEEK} AS BIGINT) AS t_cached,
    CAST(sum(a_output) OVER {_IN_WEEK} AS BIGINT) AS t_output,
    first_value(CASE WHEN started THEN started_mode END IGNORE NULLS) OVER {_IN_FILE} AS collaboration_mode
  FROM re)""",
    """snaps AS (SELECT * FROM counted WHERE NOT started AND NOT marker)""",
    """increments AS (
  SELECT *,
    t_input - lag(t_input, 1, 0) OVER w AS d_input,
    t_cached - lag(t_cached, 1, 0) OVER w AS d_cached,
    t_output - lag(t_output, 1, 0) OVER w AS d_output,
    CASE WHEN row_number() OVER w = 1 THEN 'first_event_delta' ELSE 'ok' END AS source_quality
  FROM snaps WHERE NOT bad_time WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
_NEGATIVE = "(CASE WHEN d_input < 0 OR d_cached < 0 THEN 1 ELSE 0 END + CASE WHEN d_output < 0 THEN 1 ELSE 0 END)"
THREADS = f"""threads AS (
  SELECT c_custkey, {_columns(inputs.THREAD_FIELDS)} FROM customer)"""
_MODE = """CASE WHEN model = 'gpt-y-fast' OR collaboration_mode = 'fast-turbo' THEN 'fast'
    WHEN collaboration_mode = 'default' THEN 'normal' ELSE 'unknown' END"""
THREAD_INCREMENTS = f"""thread_increments AS (
  SELECT i.*, t.id AS thread_id, t.model, {_MODE} AS mode
  FROM increments i JOIN threads t ON i.user_id = t.c_custkey AND t.c_custkey % 10 NOT IN (0, 1))"""


def _delta(kind: str, tokens: str, kept: str) -> str:
    return f"""
  SELECT ts AS occurred_at_utc, 'codex' AS agent, thread_id AS session_id, model AS model_raw,
    coalesce(CASE model WHEN 'gpt-y-fast' THEN 'gpt-y' ELSE model END, '(unknown)') AS model_key,
    '{kind}' AS token_kind, {tokens} AS tokens, mode, source_quality
  FROM thread_increments WHERE {kept} AND {tokens} > 0"""


_FORWARD = "d_input >= 0 AND d_cached >= 0"
ROLLOUT_FACTS = "rollout_facts AS (" + " UNION ALL ".join(
    [
        _delta("input_nocache", "(d_input - d_cached)", _FORWARD),
        _delta("cache_read", "d_cached", _FORWARD),
        _delta("output", "d_output", "true"),
    ]
) + ")"
THREAD_FACTS = (*ROLLOUTS, THREADS, THREAD_INCREMENTS, ROLLOUT_FACTS)
LOG_FACTS = (
    *SESSIONS,
    SESSION_FACTS,
    *THREAD_FACTS,
    "log_facts AS (SELECT * FROM session_facts UNION ALL SELECT * FROM rollout_facts)",
)
_FACT_KEYS = "agent, session_id, model_raw, model_key, token_kind, mode, source_quality"


def _fact_totals(facts: str) -> str:
    return f"SELECT {_FACT_KEYS}, {_COUNTED}, {_FACT_RANGE} FROM {facts} GROUP BY ALL"


# --- catalogs ---------------------------------------------------------------------------------------


def _moment(text: str) -> str:
    """The three ways periods write their bounds."""
    day = f"CAST(substr({text}, 1, 10) AS TIMESTAMP)"
    return (
        f"CASE WHEN {text} = 'soon' THEN NULL WHEN {text} LIKE '%+09:00' THEN {day} - INTERVAL 9 HOUR "
        f"ELSE {day} END"
    )


def _period_rows(number: int, fields: dict[str, str]) -> str:
    return f"SELECT e.*, {number} AS nth, {_columns(fields)} FROM entries e"


ENTRIES = f"entries AS (SELECT p_partkey, {_columns(inputs.ENTRY_FIELDS)} FROM part)"
CATALOG_PERIODS = f"""spans AS (
  SELECT *, {_moment('from_text')} AS starts, {_moment('until_text')} AS ends FROM (
    SELECT * EXCLUDE (effective_from, effective_until), effective_from AS from_text,
      nullif(effective_until, '') AS until_text
    FROM ({_period_rows(1, inputs.FIRST_PERIOD)} UNION ALL {_period_rows(2, inputs.SECOND_PERIOD)})))"""
ALIASES = """aliases AS (
  SELECT catalog_id, model_key, alias_1 AS alias FROM entries
  UNION ALL SELECT catalog_id, model_key, alias_2 FROM entries WHERE alias_2 IS NOT NULL)"""
HEADERS = f"headers AS (SELECT {_columns(inputs.HEADER_FIELDS)} FROM supplier)"


def _long_prices(columns: str, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, '{field}' AS field, {field} AS written FROM spans WHERE {where}"
        for field in RATE_FIELDS
    )


_HEADER_JSON = "concat('{', concat_ws(',', " + ", ".join(
    f"""'"{name}":"' || {name} || '"'""" for name in inputs.HEADER_FIELDS if name != "catalog_id"
) + "), '}')"
_BOUND_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_NEW_YORK = "AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'"
_PROJECT = "concat('p', CAST(user_id % 10 AS STRING))"


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources
    sql["scan_session_logs"] = f"""
SELECT {_PROJECT} AS project, count(*) AS n_lines, CAST(sum(event_id) AS BIGINT) AS sum_event_id
FROM events GROUP BY 1"""
    sql["read_named_files"] = f"""
SELECT {_PROJECT} AS project, count(*) AS n_lines, CAST(sum(event_id) AS BIGINT) AS sum_event_id
FROM events WHERE user_id % 2 = 0 GROUP BY 1"""
    sql["join_many_periods"] = f"""
WITH periods AS (SELECT p_partkey, {inputs.PART_PERIOD_SQL['begins']} AS begins, {inputs.PART_PERIOD_SQL['ends']} AS ends FROM part),
moments AS (SELECT o_orderkey, {inputs.ORDER_MOMENT_SQL} AS moment FROM orders)
SELECT o_orderkey, p_partkey FROM moments LEFT JOIN periods ON moment >= begins AND moment < ends"""
    sql["log_line_order"] = f"""
SELECT {_PROJECT} AS project, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_out_of_order
FROM events GROUP BY 1"""
    sql["prune_files_since"] = f"""
SELECT {_PROJECT} AS project, count(*) AS n_early, CAST(0 AS BIGINT) AS n_late FROM events GROUP BY 1"""
    sql["skipped_session_files"] = """
SELECT count(DISTINCT user_id) AS skipped_files FROM events WHERE user_id % 5 = 0 AND user_id % 2 = 1"""
    sql["parse_json_lines"] = _with(SESSIONS[0]) + """
SELECT concat('user-', CAST(user_id AS STRING)) AS file, count(*) AS n_lines,
  count(*) FILTER (blank_line) AS n_blank, count(*) FILTER (corrupt) AS n_malformed,
  count(*) FILTER (NOT corrupt AND NOT blank_line) AS n_events
FROM ev GROUP BY user_id"""
    sql["scan_threads"] = _with(THREADS) + """
SELECT id, model, archived, created_at_ms, rollout_path FROM threads
WHERE archived = 0 AND created_at_ms >= 5000 AND created_at_ms < 1000000"""
    sql["resolve_rollout_files"] = _with(THREADS) + f"""
SELECT id, concat('{inputs.HOME}/', CASE WHEN c_custkey % 10 = 1 THEN 'gone/' ELSE '' END,
    'u', CAST(c_custkey AS STRING), '.jsonl') AS path,
  c_custkey % 10 <> 1 AND c_custkey IN (SELECT user_id FROM events) AS present
FROM threads WHERE rollout_path IS NOT NULL"""
    sql["load_rate_catalog"] = _with(ENTRIES, CATALOG_PERIODS) + f"""
SELECT catalog_id, model_key, rate_id, {_text('starts')} AS effective_from, {_text('ends')} AS effective_until,
  field AS rate_field, TRY_CAST(written AS DOUBLE) AS usd_per_mtok
FROM ({_long_prices('catalog_id, model_key, rate_id, starts, ends')})"""
    sql["catalog_sha256"] = _with(HEADERS) + (
        f"SELECT catalog_id, sha256({_HEADER_JSON} || chr(10)) AS sha256 FROM headers"
    )

    # filters
    sql["filter_billable_events"] = _with(*SESSIONS) + """
SELECT concat('user-', CAST(user_id AS STRING)) AS file, event_id FROM usable"""
    sql["filter_snapshots"] = _with(*ROLLOUTS) + f"SELECT {inputs.ROLLOUT_FILE} AS file, event_id FROM snaps"
    sql["malformed_timestamps"] = _with(*SESSIONS, *ROLLOUTS) + """
SELECT 'session' AS source, event_id FROM usable WHERE bad_time
UNION ALL SELECT 'rollout', event_id FROM snaps WHERE bad_time"""
    sql["filter_window"] = _with(FACTS) + f"""
SELECT agent, token_kind, {_COUNTED}, {_FACT_RANGE} FROM facts
WHERE occurred_at_utc >= TIMESTAMP '1996-02-29 15:00:00' AND occurred_at_utc < TIMESTAMP '1998-07-01'
GROUP BY ALL"""
    sql["filter_agents"] = _with(FACTS) + f"""
SELECT agent, token_kind, {_COUNTED} FROM facts WHERE agent = 'codex' GROUP BY ALL"""
    sql["parse_window_bounds"] = f"""
WITH bounds AS (SELECT o_orderkey, o_orderdate, o_orderkey % 7 AS form, {_BOUND_DAY} AS day FROM orders)
SELECT o_orderkey,
  CASE form WHEN 0 THEN day WHEN 1 THEN day || 'T12:30:00' WHEN 2 THEN day || 'T12:30:00Z'
    WHEN 3 THEN day || 'T12:30:00+09:00' WHEN 4 THEN day || ' 12:30:15.25' WHEN 5 THEN '' ELSE 'soon'
  END AS bound,
  strftime(CASE form
    WHEN 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP {_NEW_YORK}
    WHEN 1 THEN (date_trunc('day', o_orderdate) + INTERVAL '12:30:00' HOUR TO SECOND)::TIMESTAMP {_NEW_YORK}
    WHEN 2 THEN (date_trunc('day', o_orderdate) + INTERVAL '12:30:00' HOUR TO SECOND)::TIMESTAMP
    WHEN 3 THEN (date_trunc('day', o_orderdate) + INTERVAL '03:30:00' HOUR TO SECOND)::TIMESTAMP
    WHEN 4 THEN (date_trunc('day', o_orderdate) + INTERVAL '12:30:15.25' HOUR TO SECOND)::TIMESTAMP {_NEW_YORK}
  END, '%Y-%m-%dT%H:%M:%S.%f') AS instant,
  CAST(form = 6 AS INT) AS invalid
FROM bounds""".replace("INTERVAL '12:30:00' HOUR TO SECOND", "INTERVAL '12 hours 30 minutes'").replace(
        "INTERVAL '03:30:00' HOUR TO SECOND", "INTERVAL '3 hours 30 minutes'"
    ).replace("INTERVAL '12:30:15.25' HOUR TO SECOND", "INTERVAL '12 hours 30 minutes 15 seconds 250 milliseconds'")
    sql["check_fact_domain"] = f"""
WITH broken AS (SELECT {_columns(inputs.BROKEN_FACT_FIELDS)} FROM lineitem)
SELECT reason, {_COUNTED} FROM (
  SELECT 'invalid agent' AS reason, tokens FROM broken WHERE agent = 'other'
  UNION ALL SELECT 'invalid token_kind', tokens FROM broken WHERE token_kind = 'reasoning'
  UNION ALL SELECT 'invalid mode', tokens FROM broken WHERE mode IS NULL
  UNION ALL SELECT 'invalid source_quality', tokens FROM broken WHERE source_quality = 'guess'
  UNION ALL SELECT 'negative tokens', tokens FROM broken WHERE tokens < 0) GROUP BY reason"""

    # derivation of facts
    sql["normalize_model_key"] = f"""
WITH names AS (SELECT p_partkey, {MODEL_NAME} AS model_raw FROM part),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(model_raw), '\\[[^\\]]*\\]$', ''), '@[0-9]{{6,8}}$', '') AS dated
  FROM names),
stripped AS (SELECT *, regexp_replace(dated, '(-(1m|200k|fast|latest))+$', '', 'i') AS k FROM bare),
dashed AS (SELECT *, CASE WHEN starts_with(k, 'claude-')
  THEN regexp_replace(regexp_replace(k, '([0-9])\\.([0-9])', '\\1-\\2', 'g'), '([0-9])\\.([0-9])', '\\1-\\2', 'g')
  ELSE k END AS key FROM stripped)
SELECT p_partkey, model_raw, CASE WHEN key = '' THEN '(unknown)' ELSE key END AS model_key FROM dashed"""
    sql["detect_mode_sessions"] = _with(*SESSIONS) + """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'normal' ELSE 'unknown' END AS mode
FROM usable"""
    sql["detect_mode_rollouts"] = _with(*THREAD_FACTS) + """
SELECT event_id, model, collaboration_mode, mode FROM thread_increments"""
    sql["fill_session_id"] = _with(*SESSIONS) + "SELECT event_id, session_id FROM timed"
    sql["sticky_collaboration_mode"] = _with(*ROLLOUTS) + "SELECT event_id, collaboration_mode FROM increments"
    sql["coerce_token_counts"] = _with(*SESSIONS) + """
SELECT event_id, CASE WHEN bad_input THEN 'malformed' ELSE CAST(n_input AS VARCHAR) END AS input,
  CAST(n_read AS VARCHAR) AS cache_read, CAST(n_write AS VARCHAR) AS cache_write,
  CASE WHEN bad_output THEN 'malformed' ELSE CAST(n_output AS VARCHAR) END AS output
FROM usable"""
    sql["split_cache_writes"] = _with(*SESSIONS) + """
SELECT event_id, CASE WHEN ttl THEN n_5m ELSE 0 END AS cache_write_5m,
  CASE WHEN ttl THEN n_1h ELSE 0 END AS cache_write_1h,
  CASE WHEN ttl THEN n_write - n_5m - n_1h ELSE n_write END AS cache_write_unknown
FROM timed"""
    sql["unpivot_usage"] = _with(*SESSIONS, SESSION_FACTS) + _fact_totals("session_facts")
    sql["rollout_deltas"] = _with(*ROLLOUTS) + "SELECT event_id, d_input, d_cached, d_output FROM increments"
    sql["negative_deltas"] = _with(*ROLLOUTS) + f"""
SELECT {inputs.ROLLOUT_FILE} AS file, CAST(sum({_NEGATIVE}) AS BIGINT) AS negative_deltas
FROM increments GROUP BY user_id"""
    sql["uncached_input"] = _with(*ROLLOUTS) + """
SELECT event_id, greatest(d_input - d_cached, 0) AS tokens FROM increments"""
    sql["first_delta_flag"] = _with(*ROLLOUTS) + "SELECT event_id, source_quality FROM increments"
    sql["unpivot_rollouts"] = _with(*THREAD_FACTS) + _fact_totals("rollout_facts")
    sql["month_bucket"] = _with(FACTS) + " UNION ALL ".join(
        f"SELECT '{zone}' AS zone, {_month(zone)} AS month, count(*) AS facts FROM facts GROUP BY ALL"
        for zone in ("UTC", "Asia/Tokyo", "America/New_York")
    )

    # joins
    sql["resolve_model_alias"] = _with(FACTS, NAMES) + """
SELECT model_key, resolved_key, count(*) AS facts FROM facts LEFT JOIN names ON name = model_key GROUP BY ALL"""
    sql["rate_for"] = _with(FACTS, NAMES, PERIODS) + f"""
SELECT model_key, resolved_key, rate_id, {_COUNTED}, {_FACT_RANGE}
FROM facts LEFT JOIN names ON name = model_key
LEFT JOIN periods ON period_model = resolved_key AND occurred_at_utc >= CAST(period_from AS TIMESTAMP)
  AND occurred_at_utc < CAST(period_until AS TIMESTAMP)
GROUP BY ALL"""
    sql["filter_sessions"] = _with(FACTS, REQUESTED) + f"""
SELECT session_id, agent, {_COUNTED} FROM facts
WHERE session_id IN (SELECT session_id FROM requested) GROUP BY ALL"""
    sql["session_matched"] = _with(FACTS, REQUESTED) + """
SELECT r.session_id, CAST(count(f.session_id) > 0 AS INT) AS matched, count(f.session_id) AS facts,
  CAST(coalesce(sum(f.tokens), 0) AS BIGINT) AS tokens
FROM requested r LEFT JOIN facts f USING (session_id) GROUP BY r.session_id"""
    sql["reconcile_tokens_used"] = _with(
        *THREAD_FACTS,
        "derived AS (SELECT session_id AS thread_id, CAST(sum(tokens) AS BIGINT) AS derived_total "
        "FROM rollout_facts GROUP BY 1)",
        f"""owned AS (SELECT thread_id, derived_total, {inputs.tokens_used('derived_total')} AS tokens_used
  FROM derived JOIN threads ON id = thread_id)""",
    ) + """
SELECT thread_id, tokens_used, derived_total, abs(tokens_used - derived_total) AS difference FROM owned
WHERE tokens_used <> 0 AND derived_total <> 0
  AND abs(tokens_used - derived_total) > 100 AND abs(tokens_used - derived_total) * 100 > tokens_used"""

    # prices
    sql["price_facts"] = _with(*PRICED) + f"""
SELECT {_text('occurred_at_utc')} AS occurred_at, session_id, model_key, token_kind, mode, tokens,
  {_double('cost')} AS estimated_cost_usd, {_double('credit')} AS credits, status AS pricing_status
FROM priced"""
    sql["price_lower_bound"] = _with(*PRICED) + f"""
SELECT model_key, mode, status AS pricing_status, CAST(sum(tokens) AS BIGINT) AS tokens,
  {_double('coalesce(sum(cost), 0)')} AS estimated_cost_usd
FROM priced WHERE token_kind = 'cache_write_unknown' GROUP BY ALL"""
    sql["price_credits"] = _with(*PRICED) + f"""
SELECT model_key, token_kind, mode, CAST(sum(tokens) AS BIGINT) AS tokens, {_double('sum(credit)')} AS credits
FROM priced WHERE credit IS NOT NULL GROUP BY ALL"""

    # reports
    sql["usage_report"] = _report(REPORT_DIMENSIONS)
    sql["report_by_month"] = _report_by("month", "month", "America/New_York")
    sql["report_from_summary"] = sql["report_by_month"]
    sql["report_by_agent"] = _report_by("agent", "agent")
    sql["report_by_model"] = _report_by("model", "model")
    sql["report_by_kind"] = _report_by("token-kind", "token_kind")
    sql["worst_status"] = f"SELECT month, model, pricing_status FROM ({_report(('month', 'model'))})"
    sql["report_totals"] = _with(*PRICED) + (
        f"SELECT tokens, priced_tokens, unpriced_tokens, estimated_cost_usd, credits "
        f"FROM (SELECT {_MEASURES} FROM priced)"
    )
    sql["report_order"] = f"SELECT model, token_kind, tokens FROM ({_report(('model', 'token-kind'))})"
    sql["measure_sessions"] = DIGEST
    sql["source_quality_counts"] = _with(FACTS, REQUESTED) + """
SELECT source_quality, count(*) AS facts FROM facts
WHERE session_id IN (SELECT session_id FROM requested) GROUP BY ALL"""
    log_prices = (*LOG_FACTS, NAMES, RATES, CREDITS, _priced("log_facts"))
    sql["data_quality"] = _with(*log_prices) + f"""
SELECT
  (SELECT count(*) FROM ev WHERE corrupt)
    + (SELECT count(*) FROM usable WHERE bad_time OR bad_input OR bad_output)
    + (SELECT count(*) FROM snaps JOIN threads ON user_id = c_custkey
       WHERE bad_time AND c_custkey % 10 NOT IN (0, 1)) AS malformed_events,
  (SELECT count(*) FROM threads WHERE rollout_path IS NOT NULL
    AND (c_custkey % 10 = 1 OR c_custkey NOT IN (SELECT user_id FROM events))) AS skipped_files,
  (SELECT CAST(sum({_NEGATIVE}) AS BIGINT) FROM thread_increments) AS negative_deltas,
  (SELECT CAST(sum(tokens) AS BIGINT) FROM priced WHERE status = 'unpriced') AS unpriced_tokens"""
    sql["union_sources"] = _with(*LOG_FACTS) + f"""
SELECT agent, token_kind, source_quality, {_COUNTED} FROM log_facts GROUP BY ALL"""
    sql["report_from_logs"] = _report(REPORT_DIMENSIONS, ctes=log_prices)

    # sinks
    sql["export_facts"] = _with(*SESSIONS, SESSION_FACTS) + """
SELECT CAST(to_json({
  occurred_at_utc: replace(strftime(occurred_at_utc, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00',
  agent: agent, session_id: session_id, model_raw: model_raw, model_key: model_key, token_kind: token_kind,
  tokens: tokens, mode: mode, source_quality: source_quality}) AS VARCHAR) AS value
FROM session_facts"""
    sql["sink_report_csv"] = _report(("agent", "model", "token-kind"))
    sql["sink_report_json"] = _report(("month", "model", "token-kind"))
    sql["sink_measure_json"] = DIGEST
    sql["sink_report_envelope"] = f"""
SELECT r.*, '1' AS schema_version, '1996-02-29T15:00:00+00:00' AS since, 'Asia/Tokyo' AS timezone,
  'test-1' AS catalog_version, '["agent","model"]' AS dimensions,
  CAST(CAST(sum(unpriced_tokens) OVER () AS BIGINT) AS VARCHAR) AS all_unpriced
FROM ({_report(("agent", "model"))}) r"""
    sql["sink_measure_envelope"] = f"""
WITH d AS ({DIGEST}),
totals AS (SELECT * FROM d WHERE scope IN ('session', 'total')),
lines AS (
  SELECT session_id, count(*) AS n_rows, CAST(sum(tokens) AS BIGINT) AS row_tokens
  FROM d WHERE scope LIKE '%_row' GROUP BY session_id)
SELECT 'measure/v1' AS protocol_version, session_id, CASE WHEN scope = 'session' THEN matched END AS matched,
  CAST(coalesce(n_rows, 0) AS INT) AS n_rows, coalesce(row_tokens, 0) AS row_tokens,
  tokens, priced_tokens, unpriced_tokens, estimated_cost_usd, credits,
  (SELECT CAST(count(*) AS VARCHAR) FROM lineitem WHERE l_partkey % 10 <> 0
    AND concat('s', CAST(l_orderkey % 1000 AS STRING)) IN (SELECT {inputs.REQUESTED_SESSION} FROM supplier)) AS ok_facts
FROM totals t LEFT JOIN lines l USING (session_id)
WHERE t.session_id IS NOT NULL
UNION ALL
SELECT 'measure/v1', NULL, NULL, (SELECT CAST(count(*) AS INT) FROM d WHERE scope = 'total_row'),
  (SELECT CAST(sum(tokens) AS BIGINT) FROM d WHERE scope = 'total_row'),
  tokens, priced_tokens, unpriced_tokens, estimated_cost_usd, credits,
  (SELECT CAST(count(*) AS VARCHAR) FROM lineitem WHERE l_partkey % 10 <> 0
    AND concat('s', CAST(l_orderkey % 1000 AS STRING)) IN (SELECT {inputs.REQUESTED_SESSION} FROM supplier))
FROM d WHERE scope = 'total'"""
    cells = _report(("agent", "model", "token-kind"))
    for exact, name in (("sum(cost)", "estimated_cost_usd"), ("sum(credit)", "credits")):
        cells = cells.replace(f"{_double(f'coalesce({exact}, 0)')} AS {name}", f"coalesce({exact}, 0) AS {name}")
    sql["format_report_cells"] = f"""
SELECT coalesce(month, '-') AS month, agent, model, token_kind, CAST(tokens AS VARCHAR) AS tokens,
  CAST(priced_tokens AS VARCHAR) AS priced_tokens, CAST(unpriced_tokens AS VARCHAR) AS unpriced_tokens,
  CAST(CAST(round(estimated_cost_usd, 4) AS DECIMAL(38,4)) AS VARCHAR) AS estimated_cost_usd,
  CASE WHEN credits = 0 THEN '-' ELSE CAST(CAST(round(credits, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS credits,
  pricing_status
FROM ({cells})"""

    # catalogs
    sql["check_catalog_header"] = _with(HEADERS) + """
SELECT catalog_id, 'missing catalog_version' AS reason FROM headers WHERE catalog_version IS NULL
UNION ALL SELECT catalog_id, 'unsupported schema_version' FROM headers WHERE schema_version <> '1'
UNION ALL SELECT catalog_id, 'unsupported currency' FROM headers WHERE currency <> 'USD'
UNION ALL SELECT catalog_id, 'unsupported unit' FROM headers WHERE unit <> 'per_mtok'"""
    sql["check_missing_fields"] = _with(ENTRIES, CATALOG_PERIODS) + f"""
SELECT catalog_id, model_key, {_NULL} AS rate_id, 'missing model_key' AS reason FROM entries
WHERE model_key IS NULL
UNION ALL SELECT catalog_id, model_key, rate_id, 'missing rate_id' FROM spans WHERE rate_id IS NULL
UNION ALL SELECT catalog_id, model_key, rate_id, 'missing effective_from' FROM spans WHERE from_text IS NULL"""
    sql["check_duplicate_models"] = _with(ENTRIES) + """
SELECT catalog_id, model_key, count(*) AS entries FROM entries
WHERE model_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""
    sql["check_alias_collisions"] = _with(ENTRIES, ALIASES) + """
SELECT catalog_id, model_key, alias,
  CASE WHEN alias = model_key THEN 'own model_key' ELSE 'another model_key' END AS reason
FROM aliases a WHERE EXISTS (
  SELECT 1 FROM entries e WHERE e.catalog_id = a.catalog_id AND e.model_key = a.alias)"""
    sql["check_duplicate_aliases"] = _with(ENTRIES, ALIASES) + """
SELECT catalog_id, alias, count(*) AS uses FROM aliases GROUP BY ALL HAVING count(*) > 1"""
    sql["check_negative_rates"] = _with(ENTRIES, CATALOG_PERIODS, HEADERS) + f"""
SELECT catalog_id, model_key, rate_id, field, written,
  CASE WHEN TRY_CAST(written AS DOUBLE) IS NULL THEN 'not a decimal' ELSE 'negative' END AS reason
FROM (
  {_long_prices('catalog_id, model_key, rate_id')}
  UNION ALL SELECT catalog_id, model_key, NULL, 'fast_multiplier', fast_multiplier FROM entries
  UNION ALL SELECT catalog_id, NULL, NULL, 'usd_per_credit', usd_per_credit FROM headers)
WHERE written IS NOT NULL AND (TRY_CAST(written AS DOUBLE) IS NULL OR TRY_CAST(written AS DOUBLE) < 0)"""
    sql["check_period_bounds"] = _with(ENTRIES, CATALOG_PERIODS) + """
SELECT catalog_id, model_key, rate_id, 'unreadable effective_from' AS reason FROM spans WHERE from_text = 'soon'
UNION ALL SELECT catalog_id, model_key, rate_id, 'ends before it starts' FROM spans WHERE ends <= starts"""
    sql["check_period_overlap"] = _with(ENTRIES, CATALOG_PERIODS) + """
SELECT catalog_id, model_key, first_rate_id, rate_id AS second_rate_id FROM (
  SELECT *, lag(rate_id) OVER w AS first_rate_id, row_number() OVER w AS place,
    coalesce(lag(ends) OVER w, TIMESTAMP '9999-12-31') AS earlier_end
  FROM spans WHERE model_key IS NOT NULL AND starts IS NOT NULL
  WINDOW w AS (PARTITION BY catalog_id, model_key ORDER BY starts, rate_id NULLS FIRST))
WHERE place > 1 AND earlier_end > starts"""
    sql["check_credit_consistency"] = _with(
        ENTRIES,
        CATALOG_PERIODS,
        HEADERS,
        """both_prices AS (
  SELECT catalog_id, model_key, rate_id, 'input_nocache' AS rate_field, input_nocache AS usd, credit_input AS credit
  FROM spans WHERE has_credits
  UNION ALL SELECT catalog_id, model_key, rate_id, 'output', output, credit_output FROM spans WHERE has_credits)""",
    ) + """
SELECT catalog_id, model_key, rate_id, rate_field, TRY_CAST(usd AS DOUBLE) AS usd_per_mtok,
  CAST(credit AS DOUBLE) AS credits_per_mtok, CAST(usd_per_credit AS DOUBLE) AS usd_per_credit
FROM both_prices JOIN headers USING (catalog_id)
WHERE TRY_CAST(usd AS DECIMAL(18,9)) <> CAST(credit AS DECIMAL(18,9)) * CAST(usd_per_credit AS DECIMAL(18,9))"""
    sql["catalog_summary"] = _with(ENTRIES, HEADERS) + """
, keys AS (SELECT DISTINCT catalog_id, model_key FROM entries WHERE model_key IS NOT NULL),
counts AS (SELECT catalog_id, count(*) AS model_count FROM keys GROUP BY 1)
SELECT catalog_id, catalog_version, currency, unit, usd_per_credit,
  coalesce(model_count, 0) AS model_count, model_key
FROM headers LEFT JOIN counts USING (catalog_id) LEFT JOIN keys USING (catalog_id)"""
    sql["model_rate_history"] = _with(
        ENTRIES,
        CATALOG_PERIODS,
        f"wanted AS (SELECT DISTINCT {HISTORY_NAME} AS queried FROM supplier)",
    ) + f"""
SELECT catalog_id, queried, model_key, coalesce(fast_multiplier, '1.0') AS fast_multiplier, rate_id,
  from_text AS effective_from, coalesce(until_text, '(open)') AS effective_until,
  field AS rate_field, coalesce(written, '(unpriced)') AS price
FROM ({_long_prices('catalog_id, model_key, alias_1, alias_2, fast_multiplier, rate_id, from_text, until_text')})
JOIN wanted ON queried IN (model_key, alias_1, alias_2)"""
    return sql
