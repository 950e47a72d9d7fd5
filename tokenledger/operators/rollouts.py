"""Rollout logs: cumulative counters per thread, turned into the increments between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import FACT_COLUMNS
from tokenledger.functions.counts import token_counts
from tokenledger.functions.models import model_key, rollout_mode
from tokenledger.functions.times import instant
from tokenledger.operators.ordering import carry_along
from tokenledger.sources.logs import ROLLOUT_EVENT, parse_lines, plain_path
from tokenledger.sources.threads import normal_path

_TOTALS = "event.payload.info.total_token_usage"
# Names of the counters here, and in a snapshot.
_COUNTERS = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens"}


def _is_message(kind: str) -> Column:
    named = (F.col("event.type") == "event_msg") & (F.col("event.payload.type") == kind)
    return F.coalesce(named, F.lit(False))


def snapshots(parsed: DataFrame) -> DataFrame:
    """Token-count messages with counters. One without is an initialisation marker: it gives no
    increment and is not the first snapshot either."""
    return parsed.filter(_is_message("token_count") & F.col(_TOTALS).isNotNull())


def read_events(lines: DataFrame) -> DataFrame:
    """One narrow row per line that matters: usable snapshots, started tasks, malformed lines."""
    parsed = parse_lines(lines, ROLLOUT_EVENT).filter(~F.col("blank"))
    snapshot = _is_message("token_count") & F.col(_TOTALS).isNotNull()
    event_message = F.coalesce(F.col("event.type") == "event_msg", F.lit(False))
    no_payload = event_message & F.col("event.payload").isNull() & F.col("ill_typed")
    no_totals = _is_message("token_count") & F.col(_TOTALS).isNull() & F.col("ill_typed")
    events = parsed.select(
        "file",
        "block",
        "pos",
        F.when(snapshot, instant(F.col("event.timestamp"))).alias("occurred_at_utc"),
        F.when(
            _is_message("task_started"), F.col("event.payload.collaboration_mode_kind")
        ).alias("started_mode"),
        token_counts(*[F.col(f"{_TOTALS}.{field}") for field in _COUNTERS.values()]).alias("counts"),
        snapshot.alias("is_snapshot"),
        (F.col("malformed") | no_payload | no_totals).alias("unreadable"),
    ).filter(F.col("is_snapshot") | F.col("started_mode").isNotNull() | F.col("unreadable"))
    events = events.select(
        "*", *[F.col("counts")[i].alias(name) for i, name in enumerate(_COUNTERS)]
    ).drop("counts")
    readable = F.col("occurred_at_utc").isNotNull()
    for counter in _COUNTERS:
        readable = readable & F.col(counter).isNotNull()
    usable = F.col("is_snapshot") & readable
    broken = F.col("unreadable") | (F.col("is_snapshot") & ~readable)
    return events.select(
        "*", usable.alias("usable"), broken.cast("int").alias("malformed")
    ).drop("unreadable")


def deltas(events: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """Increments of every usable snapshot over the one before it in its file.

    The first one counts from zero, and is marked. A counter that went back gives a negative
    increment and becomes the baseline all the same. ``collaboration_mode`` is the first one a
    started task named before the snapshot. ``threads`` (keyed by ``file``) adds its columns; files
    without a thread drop out, and a file of two threads counts for both.
    """
    relevant = events.filter(F.col("is_snapshot") | F.col("started_mode").isNotNull()).drop("malformed")
    carried = carry_along(
        relevant,
        ["file"],
        latest={"previous": F.col("usable")},
        earliest={"started": F.col("started_mode").isNotNull()},
        attach=threads,
        carrying={"previous": list(_COUNTERS), "started": ["started_mode"]},
    )
    kept = [c for c in threads.columns if c != "file"] if threads is not None else []

    def increment(counter: str) -> Column:
        return F.col(counter) - F.coalesce(F.col(f"previous.{counter}"), F.lit(0))

    return carried.filter("usable").select(
        "file",
        "block",
        "pos",
        "occurred_at_utc",
        *kept,
        F.col("started.started_mode").alias("collaboration_mode"),
        F.col("previous").isNull().alias("first_delta"),
        increment("input").alias("d_input"),
        increment("cached").alias("d_cached"),
        increment("output").alias("d_output"),
    )


def negative_count() -> Column:
    """How many channels of a snapshot went back. Input and cached input are one channel."""
    input_back = (F.col("d_input") < 0) | (F.col("d_cached") < 0)
    return input_back.cast("int") + (F.col("d_output") < 0).cast("int")


def uncached_input() -> Column:
    return F.greatest(F.col("d_input") - F.col("d_cached"), F.lit(0))


def source_quality() -> Column:
    return F.when(F.col("first_delta"), "first_event_delta").otherwise("ok")


def delta_facts(increments: DataFrame) -> DataFrame:
    """Facts of increments that carry ``thread_id`` and ``model``, and its key where it was worked out per
    thread. A channel that went back gives none."""
    forward = (F.col("d_input") >= 0) & (F.col("d_cached") >= 0)
    amounts = {
        "input_nocache": F.when(forward, uncached_input()),
        "cache_read": F.when(forward, F.col("d_cached")),
        "output": F.col("d_output"),
    }
    key = F.col("model_key") if "model_key" in increments.columns else model_key(F.col("model"))
    long = increments.select(
        "occurred_at_utc",
        F.lit("codex").alias("agent"),
        F.col("thread_id").alias("session_id"),
        F.col("model").alias("model_raw"),
        key.alias("model_key"),
        rollout_mode(F.col("model"), F.col("collaboration_mode")).alias("mode"),
        source_quality().alias("source_quality"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("token_kind"), amount.alias("tokens"))
                    for kind, amount in amounts.items()
                ]
            )
        ),
    )
    return long.filter(F.col("tokens") > 0).select(*FACT_COLUMNS)


def by_file(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Threads whose log exists, keyed by ``file`` as the line frame names it: what :func:`deltas` takes."""
    names = files.select("file", normal_path(plain_path(F.col("file"))).alias("path")).distinct()
    return resolved.filter("present").join(names.hint("merge"), "path").select(
        "file", F.col("id").alias("thread_id"), "model", model_key(F.col("model")).alias("model_key"), "tokens_used"
    )


def thread_counters(increments: DataFrame) -> DataFrame:
    """Per thread: its own total, the total of its facts before any time filter, and negative deltas."""
    forward = (F.col("d_input") >= 0) & (F.col("d_cached") >= 0)
    tokens = F.when(forward, uncached_input() + F.col("d_cached")).otherwise(0) + F.greatest(
        F.col("d_output"), F.lit(0)
    )
    return increments.groupBy("file", "thread_id").agg(
        F.sum(tokens).alias("derived_total"),
        F.sum(negative_count()).alias("negative_deltas"),
    )


def rollout_facts(lines: DataFrame, threads: DataFrame) -> DataFrame:
    return delta_facts(deltas(read_events(lines), threads))
