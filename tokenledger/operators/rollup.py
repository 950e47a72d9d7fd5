"""A summary of priced facts from which reports follow without the facts.

A summary has tokens and numbers of facts per quarter of an hour, agent, model, token kind and unit price. Offsets of
time zones are whole quarters, so the months of any zone, and any grouping, are sums of its rows; unit prices are part of
the key, so costs are exact although periods may begin within a quarter. Sums add up: the summary of new facts is
put beside the old ones, which nothing rebuilds, and reports add up what belongs together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import REPORT_COLUMNS, REPORT_DIMENSIONS
from tokenledger.functions.times import month_label
from tokenledger.operators.pricing import with_unit_prices
from tokenledger.operators.report import measures, report_keys, token_groups
from tokenledger.sources.catalog import Catalog

QUARTER_SECONDS = 900
_KEYS = ("quarter", "agent", "model", "token_kind", "usd_per_token", "credits_per_token", "pricing_status")


def quarter_of(moment: Column) -> Column:
    """The beginning of an instant's quarter of an hour."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(moment) / QUARTER_SECONDS) * QUARTER_SECONDS)


def summarized(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """The summary of facts, to be written or appended to summaries of other facts priced by the same catalog."""
    keys = {
        "quarter": quarter_of(F.col("occurred_at_utc")),
        "agent": F.col("agent"),
        "model": F.col("model_key"),
        "token_kind": F.col("token_kind"),
    }
    return token_groups(with_unit_prices(facts, catalog), keys)


def compacted(summary: DataFrame) -> DataFrame:
    """One row per key of appended summaries. Reports are the same without it, of more rows."""
    return summary.groupBy(*_KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("facts").alias("facts"))


def _on_a_quarter(bound: Column) -> Column:
    broken = F.raise_error(F.concat(F.lit("not at a quarter of an hour: "), bound.cast("string"))).cast("timestamp")
    return F.when(quarter_of(bound) == bound, bound).otherwise(broken)


def report_from(
    summary: DataFrame,
    *,
    group_by: Sequence[str] = REPORT_DIMENSIONS,
    timezone: str = "UTC",
    since: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """The rows that :func:`~tokenledger.operators.report.usage_report` gives for the facts. Bounds of a window have to
    be at quarters of an hour, others fail the job: a summary cannot tell what lies on either side."""
    if since is not None:
        summary = summary.filter(F.col("quarter") >= _on_a_quarter(since))
    if until is not None:
        summary = summary.filter(F.col("quarter") < _on_a_quarter(until))
    keys = report_keys(group_by, F.col("quarter"), F.col("model"), timezone)
    prices = ["usd_per_token", "credits_per_token", "pricing_status"]
    # Added up per price before anything is multiplied, as for facts.
    groups = summary.groupBy(*[column.alias(name) for name, column in keys.items()], *prices).agg(
        F.sum("tokens").alias("tokens"), F.sum("facts").alias("facts")
    )
    rows = groups.groupBy(*keys).agg(*measures())
    return rows.withColumn("month", month_label(F.col("month"))).select(*REPORT_COLUMNS)
