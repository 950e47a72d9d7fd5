"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.fixed_values import AGENTS, REPORT_COLUMNS
from tokenledger.functions import times
from tokenledger.functions.counts import text_value, token_count
from tokenledger.functions.models import model_key, rollout_mode, session_mode
from tokenledger.operators import facts as fact_ops
from tokenledger.operators import integrity, pricing, quality, report, rollouts, rollup, session_events
from tokenledger.operators.intervals import cover_join
from tokenledger.operators.ordering import carry_along
from tokenledger.plans import inputs
from tokenledger.session import shared_dir, use_utc, written
from tokenledger.sinks import export, report_files
from tokenledger.sources import logs, manifest
from tokenledger.sources.catalog import documents
from tokenledger.sources.threads import select_threads

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return build(spark, sf_dir)

    _REGISTRY[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _event_id() -> Column:
    return F.col("pos.event_id").alias("event_id")


def _number(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


# --- sources ----------------------------------------------------------------------------------------


def _written_logs(spark: SparkSession, sf_dir: str) -> str:
    """Log files below one folder per project, lines in time order within each file."""
    events = inputs.table(spark, sf_dir, "events")
    lines = events.select(
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project"),
        F.concat(F.lit('{"type":"user","event":'), "event_id", F.lit("}")).alias("value"),
        "ts",
        "event_id",
    )
    root = shared_dir(spark)
    ordered = lines.sortWithinPartitions("project", "ts", "event_id")
    ordered.select("project", "value").write.partitionBy("project").text(root)
    return root


def _project(file: Column) -> Column:
    return F.regexp_extract(file, r"project=(\w+)", 1).alias("project")


def _event_of_line() -> Column:
    return F.get_json_object("line", "$.event").cast("bigint")


@query
def scan_session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs.session_lines(spark, _written_logs(spark, sf_dir), pattern="*.txt")
    return lines.groupBy(_project(F.col("file"))).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(_event_of_line()).alias("sum_event_id")
    )


@query
def log_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files were written in event order: lines read back out of that order are counted."""
    lines = logs.session_lines(spark, _written_logs(spark, sf_dir), pattern="*.txt")
    numbered = lines.withColumn("event", _event_of_line()).drop("line")
    carried = carry_along(numbered, ["file"], latest={"previous": F.lit(True)}, carrying={"previous": ["event"]})
    return carried.groupBy(_project(F.col("file"))).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("previous.event") > F.col("event")).alias("n_out_of_order"),
    )


@query
def prune_files_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that may hold events since 12 hours, and since 25 hours, after they were last written:
    the day of slack keeps all of the former and none of the latter."""
    root = _written_logs(spark, sf_dir)
    last = logs.file_listing(spark, [root], pattern="*.txt", recursive=True).agg(F.max("modified_at")).first()[0]

    def counted(hours: int, name: str) -> DataFrame:
        bound = F.lit(last) + F.expr(f"INTERVAL {hours} HOURS")
        lines = logs.session_lines(spark, root, pattern="*.txt", touched_since=bound)
        return lines.groupBy(_project(F.col("file"))).agg(F.count(F.lit(1)).alias(name))

    early, late = counted(12, "n_early"), counted(25, "n_late")
    return early.join(late, "project", "left").fillna(0, "n_late")


@query
def read_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the logs of every second project, which are named, beside as many names of no file."""
    root = _written_logs(spark, sf_dir)
    listing = logs.file_listing(spark, [root], pattern="*.txt", recursive=True)
    there = listing.filter("regexp_extract(file, 'project=p(.)', 1) % 2 = 0").select(logs.plain_path(F.col("file")).alias("path"))
    gone = there.select(F.concat("path", F.lit(".gone")).alias("path"))
    files = manifest.named_files(there.unionByName(gone))
    lines = manifest.read_named(files, lambda found: found.select("file", _event_of_line().alias("event")))
    return lines.groupBy(_project(F.col("file"))).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("event").alias("sum_event_id")
    )


@query
def skipped_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a listing names, but no line came from: every fifth listed name is of a file that is gone."""
    root = _written_logs(spark, sf_dir)
    lines = logs.session_lines(spark, root, pattern="*.txt")
    listing = logs.file_listing(spark, [root], pattern="*.txt", recursive=True)
    users = inputs.table(spark, sf_dir, "events").filter("user_id % 5 = 0").select("user_id").distinct()
    gone = users.select(
        F.concat(F.lit("file:///gone/u"), "user_id").alias("file"),
        F.lit(None).cast("timestamp").alias("modified_at"),
        (F.col("user_id") % 2).alias("size"),
    )
    return quality.skipped_files(logs.unread_files(listing.unionByName(gone), lines))


@query
def parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_lines(inputs.session_lines(spark, sf_dir), logs.SESSION_EVENT)
    return parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("blank").alias("n_blank"),
        F.count_if("malformed").alias("n_malformed"),
        F.count_if(F.col("event").isNotNull()).alias("n_events"),
    )


def _threads_with_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Resolved threads by file with their own totals, and their counters."""
    threads = inputs.threads_by_file(spark, sf_dir)
    events = rollouts.read_events(inputs.rollout_lines(spark, sf_dir))
    counters = written(rollouts.thread_counters(rollouts.deltas(events, threads)))
    threads = threads.drop("tokens_used")
    own = counters.select(
        "file",
        "thread_id",
        F.col("thread_id").cast("bigint").alias("c_custkey"),
        "derived_total",
    ).selectExpr("file", "thread_id", f"{inputs.tokens_used('derived_total')} AS tokens_used")
    return threads.join(own.hint("merge"), ["file", "thread_id"]), counters


@query
def scan_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = inputs.thread_table(spark, sf_dir).drop("c_custkey")
    return select_threads(
        threads, include_archived=False, created_since_ms=5_000, created_until_ms=1_000_000
    )


@query
def resolve_rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.resolved_threads(spark, sf_dir).select("id", "path", "present")


@query
def load_rate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = inputs.part_catalog(spark, sf_dir).rates
    return rates.select(
        "catalog_id",
        "model_key",
        "rate_id",
        _text(F.col("effective_from")).alias("effective_from"),
        _text(F.col("effective_until")).alias("effective_until"),
        "rate_field",
        _number("usd_per_mtok"),
    )


# Folders that written catalogs are dealt to.
CATALOG_FOLDERS = 256


@query
def catalog_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of catalog files: a written file is a document and a line end.

    Files are dealt to folders, each of which one task writes, the commit moves and one task lists as a whole.
    """
    path = shared_dir(spark)
    docs = inputs.header_documents(spark, sf_dir).select(
        "catalog_id", F.pmod(F.crc32("catalog_id"), F.lit(CATALOG_FOLDERS)).alias("dealt"), F.col("document").alias("value")
    )
    docs.repartition(CATALOG_FOLDERS, "dealt").write.partitionBy("dealt", "catalog_id").text(path)
    read = documents(spark, path)
    return read.select(F.regexp_extract("catalog_id", r"catalog_id=([^/]+)", 1).alias("catalog_id"), "sha256")


# --- filters ----------------------------------------------------------------------------------------


@query
def filter_billable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_lines(inputs.session_lines(spark, sf_dir), logs.SESSION_EVENT)
    return session_events.billable(parsed).select("file", _event_id())


@query
def filter_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_lines(inputs.rollout_lines(spark, sf_dir), logs.ROLLOUT_EVENT)
    return rollouts.snapshots(parsed).select(logs.plain_path(F.col("file")).alias("file"), _event_id())


@query
def malformed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that would count, were it not for their time."""
    sessions = logs.parse_lines(inputs.session_lines(spark, sf_dir), logs.SESSION_EVENT)
    threads = logs.parse_lines(inputs.rollout_lines(spark, sf_dir), logs.ROLLOUT_EVENT)

    def untimed(source: str, events: DataFrame) -> DataFrame:
        return events.filter(times.instant(F.col("event.timestamp")).isNull()).select(
            F.lit(source).alias("source"), _event_id()
        )

    return untimed("session", session_events.billable(sessions)).unionByName(
        untimed("rollout", rollouts.snapshots(threads))
    )


def _window() -> tuple[Column | None, Column | None]:
    since = times.required_window_bound("1996-03-01", "Asia/Tokyo")
    until = times.required_window_bound("1998-07-01T00:00:00Z", "Asia/Tokyo")
    return since, until


@query
def filter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fact_ops.in_window(inputs.line_facts(spark, sf_dir), *_window())
    return facts.groupBy("agent", "token_kind").agg(
        F.count(F.lit(1)).alias("facts"),
        F.sum("tokens").alias("tokens"),
        _text(F.min("occurred_at_utc")).alias("first_at"),
        _text(F.max("occurred_at_utc")).alias("last_at"),
    )


@query
def filter_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fact_ops.of_agents(inputs.line_facts(spark, sf_dir), ["codex", "nobody"])
    return facts.groupBy("agent", "token_kind").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("tokens").alias("tokens")
    )


@query
def parse_window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound per order, in every accepted form and some others."""
    zone = "America/New_York"
    orders = inputs.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    bound = (
        F.when(F.col("o_orderkey") % 7 == 0, day)
        .when(F.col("o_orderkey") % 7 == 1, F.concat(day, F.lit("T12:30:00")))
        .when(F.col("o_orderkey") % 7 == 2, F.concat(day, F.lit("T12:30:00Z")))
        .when(F.col("o_orderkey") % 7 == 3, F.concat(day, F.lit("T12:30:00+09:00")))
        .when(F.col("o_orderkey") % 7 == 4, F.concat(day, F.lit(" 12:30:15.25")))
        .when(F.col("o_orderkey") % 7 == 5, "")
        .otherwise("soon")
    )
    return orders.select("o_orderkey", bound.alias("bound")).select(
        "o_orderkey",
        "bound",
        _text(times.window_bound(F.col("bound"), zone)).alias("instant"),
        times.bad_window_bound(F.col("bound"), zone).cast("int").alias("invalid"),
    )


@query
def check_fact_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.line_facts(spark, sf_dir, inputs.BROKEN_FACT_FIELDS)
    broken = fact_ops.domain_violations(facts)
    return broken.groupBy("reason").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("tokens").alias("tokens")
    )


# --- derivation of facts ----------------------------------------------------------------------------

MODEL_NAME = (
    "concat(CASE p_partkey % 3 WHEN 0 THEN '  ' ELSE '' END, "
    "CASE p_partkey % 5 WHEN 0 THEN 'claude-opus-4.7' WHEN 1 THEN 'claude-x.1.2.3' WHEN 2 THEN 'gpt-5.6' "
    "WHEN 3 THEN p_name ELSE '' END, "
    "CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN '[1m]' WHEN 2 THEN '@20260101' WHEN 3 THEN '-fast' "
    "WHEN 4 THEN '-200k-fast' WHEN 5 THEN '-LATEST' WHEN 6 THEN '[1m]@20260101' WHEN 7 THEN '@123' "
    "WHEN 8 THEN '-1m[x]' WHEN 9 THEN '@202601' WHEN 10 THEN '-fast-' WHEN 11 THEN '-latest@20260101[a]' "
    "ELSE ' ' END)"
)


@query
def normalize_model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{MODEL_NAME} AS model_raw")
    return names.select("p_partkey", "model_raw", model_key(F.col("model_raw")).alias("model_key"))


@query
def detect_mode_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_lines(inputs.session_lines(spark, sf_dir), logs.SESSION_EVENT)
    speed = text_value(F.col("event.message.usage.speed"))
    return session_events.billable(parsed).select(_event_id(), session_mode(speed).alias("mode"))


def _thread_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rollouts.read_events(inputs.rollout_lines(spark, sf_dir))
    return rollouts.deltas(events, inputs.threads_by_file(spark, sf_dir))


def _file_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.deltas(rollouts.read_events(inputs.rollout_lines(spark, sf_dir)))


@query
def detect_mode_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = rollout_mode(F.col("model"), F.col("collaboration_mode"))
    return _thread_deltas(spark, sf_dir).select(
        _event_id(), "model", "collaboration_mode", mode.alias("mode")
    )


@query
def fill_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = session_events.read_events(inputs.session_lines(spark, sf_dir))
    return session_events.fill_session_id(events).select(_event_id(), "session_id")


@query
def sticky_collaboration_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_deltas(spark, sf_dir).select(_event_id(), "collaboration_mode")


@query
def coerce_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_lines(inputs.session_lines(spark, sf_dir), logs.SESSION_EVENT)
    usage = "event.message.usage"

    def shown(field: str) -> Column:
        return F.coalesce(token_count(F.col(f"{usage}.{field}")).cast("string"), F.lit("malformed"))

    return session_events.billable(parsed).select(
        _event_id(),
        shown("input_tokens").alias("input"),
        shown("cache_read_input_tokens").alias("cache_read"),
        shown("cache_creation_input_tokens").alias("cache_write"),
        shown("output_tokens").alias("output"),
    )


@query
def split_cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = session_events.read_events(inputs.session_lines(spark, sf_dir)).filter("billable")
    five, hour, unknown = session_events.cache_writes(
        F.col("has_ttl"), F.col("cache_write"), F.col("write_5m"), F.col("write_1h")
    )
    return events.select(
        _event_id(),
        five.alias("cache_write_5m"),
        hour.alias("cache_write_1h"),
        unknown.alias("cache_write_unknown"),
    )


def _fact_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy(
        "agent", "session_id", "model_raw", "model_key", "token_kind", "mode", "source_quality"
    ).agg(
        F.count(F.lit(1)).alias("facts"),
        F.sum("tokens").alias("tokens"),
        _text(F.min("occurred_at_utc")).alias("first_at"),
        _text(F.max("occurred_at_utc")).alias("last_at"),
    )


@query
def unpivot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact_totals(session_events.session_facts(inputs.session_lines(spark, sf_dir)))


@query
def rollout_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_deltas(spark, sf_dir).select(_event_id(), "d_input", "d_cached", "d_output")


@query
def negative_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _file_deltas(spark, sf_dir).groupBy("file").agg(
        F.sum(rollouts.negative_count()).alias("negative_deltas")
    )
    return counted.withColumn("file", logs.plain_path(F.col("file")))


@query
def uncached_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_deltas(spark, sf_dir).select(_event_id(), rollouts.uncached_input().alias("tokens"))


@query
def first_delta_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_deltas(spark, sf_dir).select(
        _event_id(), rollouts.source_quality().alias("source_quality")
    )


@query
def unpivot_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact_totals(rollouts.delta_facts(_thread_deltas(spark, sf_dir)))


@query
def month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = ("UTC", "Asia/Tokyo", "America/New_York")
    months = F.array(
        *[
            F.struct(F.lit(zone).alias("zone"), times.month_start(F.col("occurred_at_utc"), zone).alias("month"))
            for zone in zones
        ]
    )
    facts = inputs.line_facts(spark, sf_dir).select(F.inline(months))
    counted = facts.groupBy("zone", "month").agg(F.count(F.lit(1)).alias("facts"))
    return counted.select("zone", times.month_label(F.col("month")).alias("month"), "facts")


# --- joins ------------------------------------------------------------------------------------------


@query
def resolve_model_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = pricing.resolve_alias(inputs.line_facts(spark, sf_dir), inputs.test_catalog(spark))
    return facts.groupBy("model_key", "resolved_key").agg(F.count(F.lit(1)).alias("facts"))


@query
def rate_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = pricing.lookup_period(inputs.keyed_line_facts(spark, sf_dir), inputs.test_catalog(spark))
    return facts.groupBy("model_key", "resolved_key", "rate_id").agg(
        F.count(F.lit(1)).alias("facts"),
        F.sum("tokens").alias("tokens"),
        _text(F.min("occurred_at_utc")).alias("first_at"),
        _text(F.max("occurred_at_utc")).alias("last_at"),
    )


@query
def filter_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = inputs.requested_sessions(spark, sf_dir)
    facts = fact_ops.of_sessions(inputs.line_facts(spark, sf_dir), wanted)
    return facts.groupBy("session_id", "agent").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("tokens").alias("tokens")
    )


@query
def session_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.sessions_matched(
        inputs.line_facts(spark, sf_dir), inputs.requested_sessions(spark, sf_dir)
    )
    return found.withColumn("matched", F.col("matched").cast("int"))


@query
def reconcile_tokens_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, counters = _threads_with_totals(spark, sf_dir)
    return quality.reconcile(threads, counters).select(
        "thread_id", "tokens_used", "derived_total", "difference"
    )


# --- prices -----------------------------------------------------------------------------------------


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price_facts(inputs.keyed_line_facts(spark, sf_dir), inputs.test_catalog(spark))


@query
def join_many_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the one of a model's very many periods that covers them."""
    periods = inputs.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "'one' AS period_model", *[f"{sql} AS {name}" for name, sql in inputs.PART_PERIOD_SQL.items()]
    )
    orders = inputs.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{inputs.ORDER_MOMENT_SQL} AS at", "CASE WHEN o_orderkey >= 0 THEN 'one' END AS model"
    )
    joined = cover_join(orders, periods, {"model": "period_model"}, "at", "begins", "ends")
    return joined.select("o_orderkey", "p_partkey")


@query
def price_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select(
        _text(F.col("occurred_at_utc")).alias("occurred_at"),
        "session_id",
        "model_key",
        "token_kind",
        "mode",
        "tokens",
        _number("estimated_cost_usd"),
        _number("credits"),
        "pricing_status",
    )


@query
def price_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = _priced(spark, sf_dir).filter(F.col("token_kind") == "cache_write_unknown")
    return unknown.groupBy("model_key", "mode", "pricing_status").agg(
        F.sum("tokens").alias("tokens"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast("double").alias("estimated_cost_usd"),
    )


@query
def price_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_credits = _priced(spark, sf_dir).filter(F.col("credits").isNotNull())
    return with_credits.groupBy("model_key", "token_kind", "mode").agg(
        F.sum("tokens").alias("tokens"), F.sum("credits").cast("double").alias("credits")
    )


# --- reports ----------------------------------------------------------------------------------------


def _report(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    facts = inputs.keyed_line_facts(spark, sf_dir)
    return report.usage_report(facts, inputs.test_catalog(spark), **options)


@query
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_output(report.in_report_order(_report(spark, sf_dir)))


@query
def report_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["month"], timezone="America/New_York")
    return report.as_output(rows).select("month", *report.MEASURES, "pricing_status")


@query
def report_from_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by month in New York, from a summary that facts of two parts were appended to one after the other."""
    facts, catalog, path = inputs.keyed_line_facts(spark, sf_dir), inputs.test_catalog(spark), shared_dir(spark)
    for agent in AGENTS:
        rollup.summarized(facts.filter(F.col("agent") == agent), catalog).write.mode("append").parquet(path)
    rows = rollup.report_from(spark.read.parquet(path), group_by=["month"], timezone="America/New_York")
    return report.as_output(rows).select("month", *report.MEASURES, "pricing_status")


@query
def report_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["agent", "no-such-dimension"])
    return report.as_output(rows).select("agent", *report.MEASURES, "pricing_status")


@query
def report_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["model"])
    return report.as_output(rows).select("model", *report.MEASURES, "pricing_status")


@query
def report_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["token-kind"])
    return report.as_output(rows).select("token_kind", *report.MEASURES, "pricing_status")


@query
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["month", "model"])
    return rows.select("month", "model", "pricing_status")


@query
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_output(report.report_totals(_report(spark, sf_dir)))


@query
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows in order, without month and agent, which leaves nulls to be placed."""
    rows = _report(spark, sf_dir, group_by=["model", "token-kind"])
    return report.in_report_order(rows).select("model", "token_kind", "tokens")


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, catalog = inputs.keyed_line_facts(spark, sf_dir), inputs.test_catalog(spark)
    digest = report.measure_sessions(facts, catalog, inputs.requested_sessions(spark, sf_dir))
    return digest.withColumn("matched", F.col("matched").cast("int"))


@query
def measure_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_output(_digest(spark, sf_dir))


@query
def source_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.source_quality_counts(
        inputs.line_facts(spark, sf_dir), inputs.requested_sessions(spark, sf_dir)
    )


@query
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over both kinds of logs, with all threads. Parsed logs serve several counters, so they
    are written once."""
    catalog = inputs.test_catalog(spark)
    session_log = written(session_events.read_events(inputs.session_lines(spark, sf_dir)))
    rollout_log = written(rollouts.read_events(inputs.rollout_lines(spark, sf_dir)))
    files = written(inputs.rollout_files(spark, sf_dir))
    resolved = written(inputs.resolved_threads(spark, sf_dir, files))
    threads = written(rollouts.by_file(resolved, files))
    increments = written(rollouts.deltas(rollout_log, threads))
    facts = fact_ops.union_sources(
        session_events.usage_facts(session_events.fill_session_id(session_log)),
        rollouts.delta_facts(increments),
    )
    return quality.data_quality(
        quality.malformed_events(session_log),
        quality.malformed_rollout_events(rollout_log, threads),
        quality.negative_deltas(rollouts.thread_counters(increments)),
        quality.skipped_threads(resolved),
        quality.unpriced_tokens(report.usage_report(facts, catalog, group_by=[])),
    )


def _log_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_ops.union_sources(
        session_events.session_facts(inputs.session_lines(spark, sf_dir)),
        rollouts.delta_facts(_thread_deltas(spark, sf_dir)),
    )


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_facts(spark, sf_dir).groupBy("agent", "token_kind", "source_quality").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("tokens").alias("tokens")
    )


@query
def report_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: log lines of both sources to ordered report rows."""
    rows = report.usage_report(_log_facts(spark, sf_dir), inputs.test_catalog(spark))
    return report.as_output(report.in_report_order(rows))


# --- sinks ------------------------------------------------------------------------------------------


@query
def export_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_lines(session_events.session_facts(inputs.session_lines(spark, sf_dir)))


@query
def sink_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["agent", "model", "token-kind"])
    path = shared_dir(spark)
    report_files.write_report_csv(rows, path)
    schema = report.as_output(rows).select(*REPORT_COLUMNS).schema
    return spark.read.schema(schema).option("header", "true").csv(path)


@query
def sink_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir, group_by=["month", "model", "token-kind"])
    path = shared_dir(spark)
    report_files.write_report_json(rows, path)
    return spark.read.schema(report.as_output(rows).schema).json(path)


@query
def sink_measure_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = _digest(spark, sf_dir)
    path = shared_dir(spark)
    report_files.write_digest_json(digest, path)
    return spark.read.schema(report.as_output(digest).schema).json(path)


def _read_header(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Fields of the header written at ``path``, by JSON path."""
    header = spark.read.text(f"{path}/header")
    return header.select(*[F.get_json_object("value", where).alias(name) for name, where in fields.items()])


@query
def sink_report_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows as written, next to what their header says."""
    catalog = inputs.test_catalog(spark)
    rows = written(_report(spark, sf_dir, group_by=["agent", "model"]))
    since, _ = _window()
    envelope = report_files.report_envelope(
        rows,
        headers=catalog.headers,
        data_quality=quality.data_quality(quality.unpriced_tokens(rows)),
        group_by=["agent", "model"],
        timezone="Asia/Tokyo",
        since=since,
    )
    path = shared_dir(spark)
    report_files.write_envelope(envelope, path)
    fields = {
        "schema_version": "$.schema_version",
        "since": "$.window.since",
        "timezone": "$.timezone",
        "catalog_version": "$.rates.catalog_version",
        "dimensions": "$.group_by",
        "all_unpriced": "$.data_quality.unpriced_tokens",
    }
    written_rows = spark.read.schema(envelope.parts["rows"].schema).json(f"{path}/rows")
    header = _read_header(spark, path, fields).withColumn("of_schema", F.col("schema_version"))
    keyed = written_rows.withColumn("of", F.lit(report_files.REPORT_SCHEMA_VERSION))
    return keyed.join(F.broadcast(header), F.col("of") == F.col("of_schema")).drop("of", "of_schema")


@query
def sink_measure_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a digest as written, and the total, next to what their header says."""
    facts, catalog = inputs.keyed_line_facts(spark, sf_dir), inputs.test_catalog(spark)
    wanted = inputs.requested_sessions(spark, sf_dir)
    digest = written(report.measure_sessions(facts, catalog, wanted))
    envelope = report_files.digest_envelope(
        digest,
        headers=catalog.headers,
        data_quality=quality.data_quality(quality.unpriced_tokens(digest.filter("scope = 'total'"))),
        source_quality=report.source_quality_counts(facts, wanted),
        agents=["codex", "claude"],
        timezone="UTC",
    )
    path = shared_dir(spark)
    report_files.write_envelope(envelope, path)
    parts = [
        spark.read.schema(envelope.parts[name].schema).json(f"{path}/{name}") for name in ("sessions", "total")
    ]
    objects = parts[0].unionByName(parts[1], allowMissingColumns=True)
    header = _read_header(spark, path, {"protocol_version": "$.protocol_version", "ok_facts": "$.data_quality.source_quality.ok"})
    keyed = objects.withColumn("of", F.lit(report_files.DIGEST_PROTOCOL_VERSION))
    return keyed.join(F.broadcast(header), F.col("of") == F.col("protocol_version")).select(
        "protocol_version",
        "ok_facts",
        "session_id",
        F.col("matched").cast("int").alias("matched"),
        F.size("rows").alias("n_rows"),
        F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, r: n + r["tokens"]).alias("row_tokens"),
        *[F.col(f"totals.{name}").alias(name) for name in report.MEASURES],
    )


@query
def format_report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_files.report_cells(_report(spark, sf_dir, group_by=["agent", "model", "token-kind"]))


# --- catalogs ---------------------------------------------------------------------------------------


@query
def check_catalog_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.header_violations(inputs.part_catalog(spark, sf_dir).headers)


@query
def check_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.missing_fields(inputs.part_catalog(spark, sf_dir))


@query
def check_duplicate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_models(inputs.part_catalog(spark, sf_dir))


@query
def check_alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.alias_collisions(inputs.part_catalog(spark, sf_dir))


@query
def check_duplicate_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_aliases(inputs.part_catalog(spark, sf_dir))


@query
def check_negative_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.value_violations(inputs.part_catalog(spark, sf_dir))


@query
def check_period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.period_bound_violations(inputs.part_catalog(spark, sf_dir))


@query
def check_period_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.period_overlaps(inputs.part_catalog(spark, sf_dir))


@query
def check_credit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.credit_inconsistencies(inputs.part_catalog(spark, sf_dir)).select(
        "catalog_id",
        "model_key",
        "rate_id",
        "rate_field",
        _number("usd_per_mtok"),
        _number("credits_per_mtok"),
        _number("usd_per_credit"),
    )


@query
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.catalog_summary(inputs.part_catalog(spark, sf_dir))


HISTORY_NAME = "concat('m', CAST(s_suppkey * 7 AS STRING), CASE WHEN s_suppkey % 2 = 1 THEN '-alias' ELSE '' END)"


@query
def model_rate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inputs.table(spark, sf_dir, "supplier").selectExpr(f"{HISTORY_NAME} AS queried")
    return integrity.rate_history(inputs.part_catalog(spark, sf_dir), names)
