"""What was broken along the way, counted instead of dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import RECONCILE_SHARE, RECONCILE_TOKENS

COUNTERS = ("malformed_events", "skipped_files", "negative_deltas", "unpriced_tokens")


def data_quality(*counters: DataFrame) -> DataFrame:
    """One row of all counters, from frames that each hold some of them (any number of rows)."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counters)
    for name in COUNTERS:
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(0))
    return merged.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in COUNTERS]
    )


def malformed_events(events: DataFrame) -> DataFrame:
    return events.agg(F.sum("malformed").alias("malformed_events"))


def malformed_rollout_events(events: DataFrame, threads: DataFrame) -> DataFrame:
    """Malformed lines of files that a thread points at, once per thread."""
    per_file = events.groupBy("file").agg(F.sum("malformed").alias("malformed_events"))
    return threads.select("file").join(per_file.hint("merge"), "file").agg(
        F.sum("malformed_events").alias("malformed_events")
    )


def negative_deltas(thread_counters: DataFrame) -> DataFrame:
    return thread_counters.agg(F.sum("negative_deltas").alias("negative_deltas"))


def skipped_threads(resolved: DataFrame) -> DataFrame:
    """Threads whose log is not there."""
    return resolved.agg(F.count_if(~F.col("present")).alias("skipped_files"))


def skipped_files(unread: DataFrame) -> DataFrame:
    return unread.agg(F.count(F.lit(1)).alias("skipped_files"))


def unpriced_tokens(report_rows: DataFrame) -> DataFrame:
    return report_rows.agg(F.sum("unpriced_tokens").alias("unpriced_tokens"))


def reconcile(threads: DataFrame, thread_counters: DataFrame) -> DataFrame:
    """Threads whose own total is further from their derived total than rounding can explain.

    Derived totals are over the whole log, before any time filter. Threads without either total say
    nothing and are left out.
    """
    totals = thread_counters.select("file", "thread_id", "derived_total")
    difference = F.abs(F.col("tokens_used") - F.col("derived_total"))
    share = F.col("tokens_used") * F.lit(RECONCILE_SHARE).cast("decimal(3,2)")
    return (
        threads.join(totals.hint("merge"), ["file", "thread_id"])
        .filter((F.col("tokens_used") != 0) & (F.col("derived_total") != 0))
        .withColumn("difference", difference)
        .filter(F.col("difference") > F.greatest(F.lit(RECONCILE_TOKENS), share))
    )
