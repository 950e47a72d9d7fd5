"""End-to-end jobs: logs, threads and a catalog in; report, export or digest out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.fixed_values import AGENTS, REPORT_DIMENSIONS
from tokenledger.functions.times import required_window_bound
from tokenledger.operators import facts as fact_ops
from tokenledger.operators import quality, report, rollouts, session_events
from tokenledger.operators.integrity import violations
from tokenledger.operators.joins import lookup
from tokenledger.session import use_utc, written
from tokenledger.sinks import report_files
from tokenledger.sources import logs, manifest, session_index
from tokenledger.sources.catalog import Catalog, catalog_from_documents, documents
from tokenledger.sources.threads import below, resolve_rollouts, select_threads, with_paths


@dataclass(frozen=True)
class Sources:
    """Where usage is read from; a source left out contributes nothing. With ``rollout_roots`` logs elsewhere count
    as absent. ``session_index`` is where :func:`~tokenledger.sources.session_index.update_index` keeps its index, which
    spares digests reading logs without the requested sessions."""

    session_root: str | None = None
    threads: DataFrame | None = None
    rollout_home: str | None = None
    rollout_roots: Sequence[str] = ()
    session_index: str | None = None


@dataclass(frozen=True)
class Collected:
    facts: DataFrame
    counters: list[DataFrame]
    reconciliation: DataFrame | None = None


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """A catalog document that passed all integrity checks."""
    catalog = catalog_from_documents(documents(spark, path))
    # One row per rule, of which there is a fixed number.
    faults = violations(catalog).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("example"))
    if broken := faults.orderBy("rule").collect():
        found = "; ".join(f"{row.rule}: {row.n}, such as {row.example}" for row in broken)
        raise PySparkException(f"rate catalog {path} is invalid: {found}")
    return catalog.require_single()


def check_window(spark: SparkSession, since: str | None, until: str | None, timezone: str) -> None:
    """Fails on an unreadable bound or an unknown zone, before anything is read."""
    moment = F.lit("2000-01-01").cast("timestamp")
    bounds = [required_window_bound(bound, timezone) for bound in (since, until)]
    spark.range(1).select(
        F.from_utc_timestamp(moment, timezone), *(bound for bound in bounds if bound is not None)
    ).collect()


def collect_usage(
    spark: SparkSession,
    sources: Sources,
    *,
    agents: Sequence[str] = AGENTS,
    include_archived: bool = True,
    touched_since: Column | None = None,
    session_ids: DataFrame | None = None,
) -> Collected:
    """Facts of all sources with the counters of everything scanned, files not touched since then left out.

    With ``session_ids`` and an index of the session logs, only logs that may hold these sessions are scanned, and
    only these threads are looked up.

    Parsed lines and increments are read by several branches, so they are written once to the shared
    folder: the logs themselves, by far the largest data, are scanned a single time.
    """
    use_utc(spark)
    parts, counters, reconciliation = [], [], None
    if "claude" in agents and sources.session_root:
        paths = [logs.session_glob(sources.session_root)]
        listed = logs.file_listing(spark, paths, touched_since=touched_since)
        if session_ids is not None and sources.session_index:
            index = session_index.read_index(spark, sources.session_index)
            files = written(manifest.of_listing(session_index.may_hold(listed, index, session_ids)))
            events = manifest.read_named(files, session_events.read_events)
            vanished = manifest.gone(files, events)
        else:
            listed = written(listed)
            lines = logs.session_lines(spark, sources.session_root, touched_since=touched_since)
            events = written(session_events.read_events(lines))
            vanished = logs.vanished_files(listed, logs.file_listing(spark, paths), events)
        parts.append(session_events.usage_facts(session_events.fill_session_id(events)))
        counters += [quality.malformed_events(events), quality.skipped_files(vanished)]
    if "codex" in agents and sources.threads is not None:
        home = sources.rollout_home or ""
        threads = select_threads(sources.threads, include_archived=include_archived)
        if session_ids is not None and sources.session_index:
            threads = lookup(threads, session_ids.select(F.col("session_id").alias("wanted_id")).distinct(), {"id": "wanted_id"}, how="left_semi")
        # Only files that a thread names are looked up and read, whatever else is in their folders.
        named = with_paths(threads, home).select("path")
        if sources.rollout_roots:
            named = named.filter(below(F.col("path"), sources.rollout_roots))
        files = manifest.named_files(named)
        resolved = written(resolve_rollouts(threads, files, home))
        by_file = written(rollouts.by_file(resolved, files))
        scanned = manifest.touched(files, touched_since)
        events = manifest.read_named(scanned, rollouts.read_events)
        vanished = manifest.gone(scanned, events)
        increments = written(rollouts.deltas(events, by_file))
        per_thread = rollouts.thread_counters(increments)
        parts.append(rollouts.delta_facts(increments))
        counters += [
            quality.malformed_rollout_events(events, by_file),
            quality.negative_deltas(per_thread),
            quality.skipped_threads(resolved),
            quality.skipped_files(vanished),
        ]
        reconciliation = quality.reconcile(by_file, per_thread)
    if not parts:
        raise PySparkException("no source to read usage from")
    return Collected(fact_ops.union_sources(*parts), counters, reconciliation)


def selected_facts(
    collected: Collected,
    *,
    agents: Sequence[str] = AGENTS,
    since: str | None = None,
    until: str | None = None,
    timezone: str = "UTC",
) -> DataFrame:
    """Facts of the agents in a window whose bounds are dates or times, local to ``timezone``."""
    lower, upper = required_window_bound(since, timezone), required_window_bound(until, timezone)
    return fact_ops.of_agents(fact_ops.in_window(collected.facts, lower, upper), agents)


def usage_report(
    spark: SparkSession,
    sources: Sources,
    catalog: Catalog,
    *,
    agents: Sequence[str] = AGENTS,
    group_by: Sequence[str] = REPORT_DIMENSIONS,
    since: str | None = None,
    until: str | None = None,
    timezone: str = "UTC",
    include_archived: bool = True,
    prune_files: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Ordered report rows, and the one-row frame of data-quality counters.

    With ``prune_files`` logs that were last written well before ``since`` are not read; the counters then
    describe the others.
    """
    check_window(spark, since, until, timezone)
    catalog.require_single()
    touched = required_window_bound(since, timezone) if prune_files else None
    collected = collect_usage(
        spark, sources, agents=agents, include_archived=include_archived, touched_since=touched
    )
    facts = selected_facts(collected, agents=agents, since=since, until=until, timezone=timezone)
    # Few rows of many facts, with several readers.
    rows = written(report.usage_report(facts, catalog, group_by=group_by, timezone=timezone))
    counters = quality.data_quality(*collected.counters, quality.unpriced_tokens(rows))
    return report.in_report_order(rows), counters


def usage_document(
    spark: SparkSession, sources: Sources, catalog: Catalog, *, timezone: str = "UTC", **options
) -> report_files.Envelope:
    """:func:`usage_report` with a header, for :func:`~tokenledger.sinks.report_files.write_envelope`."""
    rows, counters = usage_report(spark, sources, catalog, timezone=timezone, **options)
    return report_files.report_envelope(
        rows,
        headers=catalog.headers,
        data_quality=counters,
        group_by=options.get("group_by", REPORT_DIMENSIONS),
        timezone=timezone,
        since=required_window_bound(options.get("since"), timezone),
        until=required_window_bound(options.get("until"), timezone),
    )


def _collected_in_window(
    spark: SparkSession,
    sources: Sources,
    *,
    prune_files: bool = False,
    session_ids: DataFrame | None = None,
    **options,
) -> Collected:
    since, until, zone = options.get("since"), options.get("until"), options.get("timezone", "UTC")
    check_window(spark, since, until, zone)
    touched = required_window_bound(since, zone) if prune_files else None
    agents = options.get("agents", AGENTS)
    return collect_usage(spark, sources, agents=agents, touched_since=touched, session_ids=session_ids)


def export_facts(spark: SparkSession, sources: Sources, *, prune_files: bool = False, **options) -> DataFrame:
    """Facts of all threads, archived ones too, in a window; see :mod:`tokenledger.sinks.export`."""
    return selected_facts(_collected_in_window(spark, sources, prune_files=prune_files, **options), **options)


def measure(
    spark: SparkSession,
    sources: Sources,
    catalog: Catalog,
    session_ids: DataFrame,
    *,
    prune_files: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digest of the requested sessions, counters, and counts of source qualities.

    Unpriced tokens and source qualities are those of the requested sessions, the other counters
    describe everything that was read: with ``sources.session_index`` only what may hold these sessions.
    """
    catalog.require_single()
    collected = _collected_in_window(spark, sources, prune_files=prune_files, session_ids=session_ids, **options)
    facts = selected_facts(collected, **options)
    digest = written(report.measure_sessions(facts, catalog, session_ids))
    unpriced = quality.unpriced_tokens(digest.filter("scope = 'total'"))
    counters = quality.data_quality(*collected.counters, unpriced)
    return digest, counters, report.source_quality_counts(facts, session_ids)


def measure_document(
    spark: SparkSession,
    sources: Sources,
    catalog: Catalog,
    session_ids: DataFrame,
    *,
    timezone: str = "UTC",
    **options,
) -> report_files.Envelope:
    """:func:`measure` with a header, for :func:`~tokenledger.sinks.report_files.write_envelope`."""
    digest, counters, qualities = measure(
        spark, sources, catalog, session_ids, timezone=timezone, **options
    )
    return report_files.digest_envelope(
        digest,
        headers=catalog.headers,
        data_quality=counters,
        source_quality=qualities,
        agents=options.get("agents", AGENTS),
        timezone=timezone,
        since=required_window_bound(options.get("since"), timezone),
        until=required_window_bound(options.get("until"), timezone),
    )
