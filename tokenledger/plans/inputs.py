"""Inputs of the operators, derived from the test tables by projection.

The rules are SQL expressions that Spark and an oracle engine both understand; operators never see
them, they get log lines, threads, facts and catalogs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.models import model_key
from tokenledger.operators import rollouts
from tokenledger.operators.facts import with_model_keys
from tokenledger.operators.ordering import running_totals
from tokenledger.session import written
from tokenledger.sources import catalog as catalogs
from tokenledger.sources.catalog import Catalog
from tokenledger.sources.threads import resolve_rollouts

# Lines of a file closer together in time than this are worked through by one task.
BLOCK_SECONDS = 600

HOME = "/home/agent"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_model(n: str) -> str:
    return (
        f"CASE CAST({n} % 8 AS INT) WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-a[1m]' "
        "WHEN 2 THEN 'model-a-fast-200k' WHEN 3 THEN 'claude-x-4.7' "
        "WHEN 4 THEN 'claude-x-4.7@20260101' WHEN 5 THEN 'model-b-alias' "
        "WHEN 6 THEN 'model-unlisted' END"
    )


def columns(fields: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in fields.items()]


# --- facts, from lineitem ---------------------------------------------------------------------------

FACT_FIELDS = {
    "occurred_at_utc": "CAST(l_shipdate AS TIMESTAMP)",
    "agent": "CASE WHEN l_returnflag = 'R' THEN 'codex' ELSE 'claude' END",
    "session_id": "concat('s', CAST(l_orderkey % 1000 AS STRING))",
    "model_raw": raw_model("l_suppkey"),
    "token_kind": (
        "CASE l_linenumber % 6 WHEN 0 THEN 'input_nocache' WHEN 1 THEN 'cache_read' "
        "WHEN 2 THEN 'cache_write_5m' WHEN 3 THEN 'cache_write_1h' "
        "WHEN 4 THEN 'cache_write_unknown' ELSE 'output' END"
    ),
    "tokens": "CAST(floor(l_quantity * 1000) AS BIGINT)",
    "mode": (
        "CASE WHEN l_linestatus = 'F' THEN 'fast' WHEN l_partkey % 2 = 0 THEN 'normal' "
        "ELSE 'unknown' END"
    ),
    "source_quality": "CASE WHEN l_partkey % 10 = 0 THEN 'first_event_delta' ELSE 'ok' END",
}

# Facts with some values outside their domain.
BROKEN_FACT_FIELDS = FACT_FIELDS | {
    "agent": "CASE WHEN l_partkey % 97 = 0 THEN 'other' WHEN l_returnflag = 'R' THEN 'codex' ELSE 'claude' END",
    "token_kind": "CASE WHEN l_partkey % 89 = 0 THEN 'reasoning' ELSE 'output' END",
    "tokens": "CAST(floor(l_quantity * 1000) AS BIGINT) - CASE WHEN l_partkey % 83 = 0 THEN 60000 ELSE 0 END",
    "mode": "CASE WHEN l_partkey % 79 = 0 THEN NULL ELSE 'fast' END",
    "source_quality": "CASE WHEN l_partkey % 73 = 0 THEN 'guess' ELSE 'ok' END",
}


def line_facts(spark: SparkSession, sf_dir: str, fields: dict[str, str] = FACT_FIELDS) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(*columns(fields))
    return raw.withColumn("model_key", model_key(F.col("model_raw")))


def keyed_line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts, with keys worked out per distinct name: for what groups or prices all of them."""
    return with_model_keys(table(spark, sf_dir, "lineitem").selectExpr(*columns(FACT_FIELDS)))


REQUESTED_SESSION = "concat('s', CAST(s_suppkey * 13 AS STRING))"


def requested_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session ids to ask for: some without facts, and all of them twice."""
    ids = table(spark, sf_dir, "supplier").selectExpr(f"{REQUESTED_SESSION} AS session_id")
    return ids.unionByName(ids)


# --- log lines, from events -------------------------------------------------------------------------

SESSION_FIELDS = {
    "corrupt": "event_id % 29 = 0",
    "blank_line": "event_id % 29 <> 0 AND event_id % 37 = 0",
    "line_type": (
        "CASE event_type WHEN 'view' THEN 'user' WHEN 'signup' THEN 'system' ELSE 'assistant' END"
    ),
    "own_id": (
        "CASE WHEN event_id % 4 = 0 THEN concat('s', CAST(user_id AS STRING), '-', "
        "CAST(event_id % 3 AS STRING)) END"
    ),
    "bad_time": "event_id % 31 = 0",
    "model_name": raw_model("event_id"),
    "no_usage": "event_id % 23 = 0",
    "speed": "CASE event_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' END",
    "n_input": "CAST(floor(value * 10) AS BIGINT)",
    "bad_input": "event_id % 41 = 0",
    "text_input": "event_id % 11 = 0",
    "n_read": "event_id % 500",
    "n_write": "event_id % 300",
    "ttl": "event_id % 2 = 0",
    "n_5m": "CAST(floor((event_id % 300) / 2) AS BIGINT)",
    "n_1h": "CAST(floor((event_id % 300) / 4) AS BIGINT)",
    "n_output": "event_id % 700",
    "bad_output": "event_id % 43 = 0",
}

_INPUT = (
    "CASE WHEN bad_input THEN '\"1.5\"' WHEN text_input THEN concat('\"', n_input, '\"') "
    "ELSE CAST(n_input AS STRING) END"
)
_BREAKDOWN = (
    "CASE WHEN ttl THEN concat(',\"cache_creation\":{\"ephemeral_5m_input_tokens\":', n_5m, "
    "',\"ephemeral_1h_input_tokens\":', n_1h, '}') ELSE '' END"
)
_USAGE = f"""
CASE WHEN no_usage THEN '"n/a"' ELSE concat(
  '{{"input_tokens":', {_INPUT}, ',"cache_read_input_tokens":', n_read,
  ',"cache_creation_input_tokens":', n_write, {_BREAKDOWN},
  ',"output_tokens":', CASE WHEN bad_output THEN '"abc"' ELSE CAST(n_output AS STRING) END,
  coalesce(concat(',"speed":"', speed, '"'), ''), '}}') END
"""
_SESSION_JSON = f"""
concat('{{"type":"', line_type, '","timestamp":"', CASE WHEN bad_time THEN 'nope' ELSE iso END, '"',
  coalesce(concat(',"sessionId":"', own_id, '"'), ''),
  ',"message":{{', coalesce(concat('"model":"', model_name, '",'), ''),
  '"content":[{{"type":"text","text":"}}{{"}}],"usage":', {_USAGE}, '}}}}')
"""


def _iso(ts: str) -> Column:
    return F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _in_lines(events: DataFrame) -> DataFrame:
    moment = F.col("ts").cast("timestamp")
    return events.withColumns(
        {
            "block": F.floor(F.unix_timestamp(moment) / BLOCK_SECONDS),
            "pos": F.struct("ts", "event_id"),
            "iso": _iso("ts"),
        }
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table, which is a single block, over all cores: what is made of them is far more work."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs, one file per user: corrupt and blank lines, bad times, ids that come and go."""
    events = _in_lines(_spread(table(spark, sf_dir, "events"))).selectExpr("*", *columns(SESSION_FIELDS))
    text = F.expr(_SESSION_JSON)
    line = F.when(F.col("corrupt"), F.substring(text, 1, 40)).when(F.col("blank_line"), "  ").otherwise(text)
    return events.select(
        F.concat(F.lit("user-"), "user_id").alias("file"), "block", "pos", _settled(line)
    )


def _settled(line: Column) -> Column:
    """A line built from many expressions, exploded from an array of one: the optimizer takes the
    result as it is, instead of reasoning about filters in terms of everything inside."""
    return F.explode(F.array(line)).alias("line")


ROLLOUT_FIELDS = {
    "started": "event_type = 'signup'",
    "started_mode": (
        "CASE event_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'fast-turbo' ELSE 'some-new-mode' END"
    ),
    "a_input": "CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END",
    "a_cached": (
        "CASE WHEN event_type = 'signup' THEN 0 WHEN event_id % 13 = 0 THEN "
        "CAST(floor(value * 10) AS BIGINT) + 5 ELSE CAST(floor(floor(value * 10) / 3) AS BIGINT) END"
    ),
    "a_output": "CASE WHEN event_type = 'signup' THEN 0 ELSE event_id % 700 END",
    "marker": "event_id % 40 = 0",
    "bad_time": "event_id % 31 = 0",
    "week": "date_trunc('week', ts)",
}
_ROLLOUT_JSON = """
concat('{"type":"event_msg","timestamp":"', CASE WHEN bad_time THEN 'nope' ELSE iso END, '","payload":{',
  CASE WHEN started THEN concat('"type":"task_started","collaboration_mode_kind":"', started_mode, '"')
  ELSE concat('"type":"token_count","info":{"total_token_usage":', CASE WHEN marker THEN 'null' ELSE concat(
    '{"input_tokens":', t_input, ',"cached_input_tokens":', t_cached, ',"output_tokens":', t_output,
    ',"reasoning_output_tokens":7}') END, '}') END, '}}')
"""
ROLLOUT_FILE = f"concat('{HOME}/u', CAST(user_id AS STRING), '.jsonl')"


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout logs, one file per user: counters add up within a week, then start again."""
    events = _in_lines(table(spark, sf_dir, "events")).selectExpr("*", *columns(ROLLOUT_FIELDS))
    amounts = {f"t_{n}": F.col(f"a_{n}") for n in ("input", "cached", "output")}
    # Whole rows are sorted and merged there, so the text of a time is made afterwards.
    needed = ["user_id", "block", "pos", *ROLLOUT_FIELDS]
    counted = running_totals(events.select(*needed), ["user_id", "week"], amounts).withColumn("iso", _iso("pos.ts"))
    return counted.select(
        F.concat(F.lit("file://"), F.expr(ROLLOUT_FILE)).alias("file"),
        "block",
        "pos",
        _settled(F.expr(_ROLLOUT_JSON)),
    )


# --- threads, from customer -------------------------------------------------------------------------

THREAD_FIELDS = {
    "id": "CAST(c_custkey AS STRING)",
    "model": (
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'gpt-y' WHEN 'MACHINERY' THEN 'gpt-y-fast' "
        "WHEN 'AUTOMOBILE' THEN 'gpt-y-codex' WHEN 'FURNITURE' THEN 'gpt-z' END"
    ),
    "archived": "CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END",
    "created_at_ms": "c_custkey * 1000",
    "rollout_path": (
        "CASE WHEN c_custkey % 10 = 0 THEN NULL "
        "WHEN c_custkey % 10 = 1 THEN concat('gone/u', CAST(c_custkey AS STRING), '.jsonl') "
        "WHEN c_custkey % 10 = 3 THEN concat('x/../u', CAST(c_custkey AS STRING), '.jsonl') "
        f"WHEN c_custkey % 10 = 4 THEN concat('{HOME}//./u', CAST(c_custkey AS STRING), '.jsonl') "
        "WHEN c_custkey % 10 = 5 THEN concat('./u', CAST(c_custkey AS STRING), '.jsonl') "
        f"WHEN c_custkey % 2 = 0 THEN concat('{HOME}/u', CAST(c_custkey AS STRING), '.jsonl') "
        "ELSE concat('u', CAST(c_custkey AS STRING), '.jsonl') END"
    ),
}


def thread_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread per customer, without its own token total. Most have no events, so no log either."""
    return _spread(table(spark, sf_dir, "customer")).selectExpr("c_custkey", *columns(THREAD_FIELDS))


# A thread's own total: right, two per cent more, or none.
def tokens_used(derived: str) -> str:
    return (
        f"CASE c_custkey % 3 WHEN 0 THEN {derived} "
        f"WHEN 1 THEN CAST(floor({derived} * 102 / 100) AS BIGINT) ELSE 0 END"
    )


def rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the rollout logs: a listing, which reads no lines."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("file://"), F.expr(ROLLOUT_FILE)).alias("file"))


def resolved_threads(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """All threads, looked up in a listing, which is taken where it is not handed in."""
    threads = thread_table(spark, sf_dir).withColumn("tokens_used", F.lit(0).cast("bigint"))
    return resolve_rollouts(threads, rollout_files(spark, sf_dir) if files is None else files, HOME)


def threads_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing serves both the lookup of threads and the names of their files."""
    files = written(rollout_files(spark, sf_dir))
    return written(rollouts.by_file(resolved_threads(spark, sf_dir, files), files))


# --- small catalog with test prices, for pricing ----------------------------------------------------

# model, rate id, from, until, prices in the order of the rate fields
TEST_PERIODS = (
    ("model-a", "a-1", "1996-01-01T00:00:00+00:00", "1998-07-01T00:00:00+00:00", "5.0", "0.5", "6.25", "10.0", "30.0"),
    ("model-a", "a-2", "1998-07-01T00:00:00+00:00", None, "6.0", "0.6", None, None, "36.0"),
    ("claude-x-4-7", "x-1", "1995-01-01T00:00:00+00:00", "1997-01-01T00:00:00+00:00", "3.0", "0.3", "3.75", "6.0", "15.0"),
    ("claude-x-4-7", "x-2", "1999-01-01T00:00:00+00:00", None, "2.0", "0.075", "2.5", "4.0", "10.0"),
    ("model-b", "b-1", "1990-01-01T00:00:00+00:00", None, "2000000", "0.123456789", None, "0.0", "14.0"),
)
# model, alias, fast multiplier, credits of input, cache read and output
TEST_MODELS = (
    ("model-a", None, "1.125", ("125", "12.5", "750")),
    ("claude-x-4-7", None, "1.0", None),
    ("model-b", "model-b-alias", "2.0", ("43.75", "4.375", None)),
)


def test_catalog_document() -> str:
    models = []
    for key, alias, multiplier, credit in TEST_MODELS:
        rates = [
            dict(zip(("rate_id", "effective_from", "effective_until", *catalogs.RATE_FIELDS), period[1:]))
            for period in TEST_PERIODS
            if period[0] == key
        ]
        entry = {"model_key": key, "aliases": [alias] if alias else [], "fast_multiplier": multiplier, "rates": rates}
        if credit:
            entry["credits_per_mtok"] = dict(zip(("input_nocache", "cache_read", "output"), credit))
        models.append(entry)
    header = {
        "schema_version": "1",
        "catalog_version": "test-1",
        "currency": "USD",
        "unit": "per_mtok",
        "usd_per_credit": "0.04",
    }
    return json.dumps({**header, "models": models})


def test_catalog(spark: SparkSession) -> Catalog:
    document = F.lit(test_catalog_document())
    docs = spark.range(1).select(
        F.lit("test").alias("catalog_id"),
        document.alias("document"),
        catalogs.fingerprint(F.encode(document, "UTF-8")).alias("sha256"),
    )
    return catalogs.catalog_from_documents(docs)


# --- one model with a period per part, and moments of orders ----------------------------------------

# Three hours each, every seventh a single one, which leaves a gap; for both SQL dialects.
PART_PERIOD_SQL = {
    "begins": "CAST('1992-01-01 00:00:00' AS TIMESTAMP) + 3 * p_partkey * INTERVAL '1' HOUR",
    "ends": (
        "CAST('1992-01-01 00:00:00' AS TIMESTAMP) + (3 * p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 3 END) "
        "* INTERVAL '1' HOUR"
    ),
}
ORDER_MOMENT_SQL = "CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL '1' SECOND"


# --- large catalogs with faults, from part and supplier ---------------------------------------------


def _model(k: str) -> str:
    return f"concat('m', CAST({k} AS STRING))"


def fixed_2(hundredths: str) -> str:
    """A whole number of hundredths as decimal text."""
    return (
        f"concat(CAST(CAST(floor(({hundredths}) / 100) AS BIGINT) AS STRING), '.', "
        f"lpad(CAST(({hundredths}) % 100 AS STRING), 2, '0'))"
    )


_K = "p_partkey"
_CENTS = f"(({_K} % 400) * 5 + 25)"
_MONTH = f"lpad(CAST({_K} % 12 + 1 AS STRING), 2, '0')"

ENTRY_FIELDS = {
    "catalog_id": f"concat('catalog-', CAST({_K} % 10 AS STRING))",
    "model_key": (
        f"CASE WHEN {_K} % 53 = 5 THEN NULL WHEN {_K} % 47 = 13 THEN {_model(f'{_K} - 10')} "
        f"ELSE {_model(_K)} END"
    ),
    "alias_1": f"concat({_model(_K)}, '-alias')",
    "alias_2": (
        f"CASE WHEN {_K} % 31 = 1 THEN {_model(_K)} WHEN {_K} % 29 = 2 THEN {_model(f'{_K} + 10')} "
        f"WHEN {_K} % 37 = 4 THEN concat('shared-', CAST({_K} % 10 AS STRING)) END"
    ),
    "fast_multiplier": (
        f"CASE WHEN {_K} % 61 = 7 THEN '-1' WHEN {_K} % 89 = 25 AND {_K} % 83 <> 24 THEN '1.125' WHEN {_K} % 3 = 0 THEN '1.0' WHEN {_K} % 3 = 1 THEN '2.5' END"
    ),
    "has_credits": f"{_K} % 2 = 0",
    "credit_input": (
        f"CASE WHEN {_K} % 41 = 9 THEN {fixed_2(f'{_CENTS} * 25 + 100')} ELSE {fixed_2(f'{_CENTS} * 25')} END"
    ),
    "credit_output": fixed_2(f"{_CENTS} * 150"),
}
_SHARED_PRICES = {
    "cache_read": fixed_2(f"CAST(floor({_CENTS} / 10) AS BIGINT)"),
    "cache_write_5m": f"CASE WHEN {_K} % 4 = 0 THEN NULL ELSE {fixed_2(f'CAST(floor({_CENTS} * 5 / 4) AS BIGINT)')} END",
    "cache_write_1h": f"CASE WHEN {_K} % 4 = 0 THEN NULL ELSE {fixed_2(f'{_CENTS} * 2')} END",
    "output": fixed_2(f"{_CENTS} * 6"),
}
FIRST_PERIOD = {
    "rate_id": f"concat({_model(_K)}, '-1')",
    "effective_from": f"CASE WHEN {_K} % 71 = 17 THEN NULL ELSE concat('1996-', {_MONTH}, '-01T00:00:00Z') END",
    "effective_until": (
        f"CASE WHEN {_K} % 43 = 11 THEN '1995-01-01T00:00:00Z' "
        f"ELSE concat('1998-', {_MONTH}, '-01T00:00:00+00:00') END"
    ),
    "input_nocache": f"CASE WHEN {_K} % 73 = 19 THEN 'abc' WHEN {_K} % 83 = 23 THEN '2000000' WHEN {_K} % 83 = 24 THEN '0.123456789' "
    f"ELSE {fixed_2(_CENTS)} END",
    **_SHARED_PRICES,
}
SECOND_PERIOD = {
    "rate_id": f"CASE WHEN {_K} % 67 = 15 THEN NULL ELSE concat({_model(_K)}, '-2') END",
    "effective_from": (
        f"CASE WHEN {_K} % 19 = 6 THEN concat('1998-', {_MONTH}, '-01T00:00:00+09:00') "
        f"WHEN {_K} % 59 = 13 THEN 'soon' ELSE concat('1998-', {_MONTH}, '-01') END"
    ),
    "effective_until": f"CASE WHEN {_K} % 5 = 0 THEN '' END",
    "input_nocache": f"CASE WHEN {_K} % 79 = 21 THEN '-1.00' ELSE {fixed_2(_CENTS)} END",
    **_SHARED_PRICES,
}
_S = "s_suppkey"
HEADER_FIELDS = {
    "catalog_id": f"concat('catalog-', CAST({_S} AS STRING))",
    "schema_version": f"CASE WHEN {_S} % 13 = 1 THEN '2' ELSE '1' END",
    "catalog_version": f"CASE WHEN {_S} % 11 = 10 THEN NULL ELSE concat('v', CAST({_S} AS STRING)) END",
    "currency": f"CASE WHEN {_S} % 7 = 2 THEN 'EUR' ELSE 'USD' END",
    "unit": f"CASE WHEN {_S} % 17 = 3 THEN 'per_ktok' ELSE 'per_mtok' END",
    "usd_per_credit": f"CASE WHEN {_S} % 19 = 18 THEN '-0.04' ELSE '0.04' END",
}
_HEADER_NAMES = [name for name in HEADER_FIELDS if name != "catalog_id"]


def header_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog document per supplier, without models."""
    rows = table(spark, sf_dir, "supplier").selectExpr(*columns(HEADER_FIELDS))
    document = F.to_json(F.struct(*_HEADER_NAMES))
    return rows.select(
        "catalog_id",
        document.alias("document"),
        catalogs.fingerprint(F.encode(document, "UTF-8")).alias("sha256"),
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalogs with one model per part, through their JSON text."""
    part = table(spark, sf_dir, "part")

    def period(fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"

    built = part.selectExpr(
        *columns(ENTRY_FIELDS),
        f"array({period(FIRST_PERIOD)}, {period(SECOND_PERIOD)}) AS rates",
    )
    credit = F.struct(F.col("credit_input").alias("input_nocache"), F.col("credit_output").alias("output"))
    lines = built.select(
        "catalog_id",
        F.to_json(
            F.struct(
                "model_key",
                F.array_compact(F.array("alias_1", "alias_2")).alias("aliases"),
                "fast_multiplier",
                F.when(F.col("has_credits"), credit).alias("credits_per_mtok"),
                "rates",
            )
        ).alias("entry"),
    ).select("catalog_id", F.explode(F.array("entry")).alias("entry"))
    headers = catalogs.catalog_from_documents(header_documents(spark, sf_dir)).headers
    return Catalog(headers, catalogs.entries_from_lines(lines))
