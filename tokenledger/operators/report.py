"""Grouped reports, totals and per-session digests.

All of them go through two groupings. The first adds up tokens per wanted key and unit price, with
partial sums before its shuffle, so a hot key reaches its task as one row per upstream task. The second
works on that far smaller frame, multiplies, and folds prices away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import (
    PRICING_STATUSES,
    REPORT_COLUMNS,
    REPORT_DIMENSIONS,
    SOURCE_QUALITIES,
)
from tokenledger.functions.times import month_label, month_start
from tokenledger.operators.facts import of_sessions
from tokenledger.operators.pricing import amount, with_unit_prices
from tokenledger.sources.catalog import Catalog

MEASURES = ("tokens", "priced_tokens", "unpriced_tokens", "estimated_cost_usd", "credits")
_KEYS = ("month", "agent", "model", "token_kind")


def token_groups(priced: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Tokens and number of facts per key, unit price and status, over facts with unit prices."""
    prices = ["usd_per_token", "credits_per_token", "pricing_status"]
    return priced.groupBy(*[column.alias(name) for name, column in keys.items()], *prices).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("facts")
    )


def _status_rank() -> Column:
    ranks = [F.when(F.col("pricing_status") == s, i) for i, s in enumerate(PRICING_STATUSES)]
    return F.coalesce(*ranks)


def measures() -> list[Column]:
    """Aggregates over token groups. One unpriced fact makes the status ``unpriced``, while the cost
    is still that of the priced part."""
    tokens = F.col("tokens")
    unpriced = F.col("pricing_status") == "unpriced"

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    worst = F.min(_status_rank())
    statuses = [F.when(worst == i, s) for i, s in enumerate(PRICING_STATUSES)]
    return [
        total(tokens).cast("bigint").alias("tokens"),
        total(F.when(~unpriced, tokens)).cast("bigint").alias("priced_tokens"),
        total(F.when(unpriced, tokens)).cast("bigint").alias("unpriced_tokens"),
        total(amount(tokens, F.col("usd_per_token"))).cast("decimal(38,17)").alias("estimated_cost_usd"),
        total(amount(tokens, F.col("credits_per_token"))).cast("decimal(38,17)").alias("credits"),
        F.coalesce(*statuses).alias("pricing_status"),
    ]


def report_keys(group_by: Sequence[str], moment: Column, model: Column, timezone: str) -> dict[str, Column]:
    """The four keys of report rows; a dimension left out is a literal null, so that no facts give no rows."""
    available = {
        "month": ("month", month_start(moment, timezone), "date"),
        "agent": ("agent", F.col("agent"), "string"),
        "model": ("model", model, "string"),
        "token-kind": ("token_kind", F.col("token_kind"), "string"),
    }
    return {
        name: column if dimension in group_by else F.lit(None).cast(type_)
        for dimension, (name, column, type_) in available.items()
    }


def usage_report(
    facts: DataFrame,
    catalog: Catalog,
    *,
    group_by: Sequence[str] = REPORT_DIMENSIONS,
    timezone: str = "UTC",
) -> DataFrame:
    """Report rows by any subset of the dimensions; the others are null, unknown names do nothing.

    Cost and credits are exact decimals here, see :func:`as_output`.
    """
    keys = report_keys(group_by, F.col("occurred_at_utc"), F.col("model_key"), timezone)
    groups = token_groups(with_unit_prices(facts, catalog), keys)
    rows = groups.groupBy(*_KEYS).agg(*measures())
    return rows.withColumn("month", month_label(F.col("month"))).select(*REPORT_COLUMNS)


def in_report_order(rows: DataFrame) -> DataFrame:
    """Rows by month, agent, model, kind, with nulls first as empty text, in code-point order."""
    return rows.orderBy(*[F.coalesce(F.col(key), F.lit("")) for key in _KEYS])


def as_output(rows: DataFrame) -> DataFrame:
    """Cost and credits as doubles, converted once, after all sums."""
    return rows.withColumns(
        {name: F.col(name).cast("double") for name in ("estimated_cost_usd", "credits")}
    )


def report_totals(rows: DataFrame) -> DataFrame:
    """One row with the sums of report rows; zeros when there are none."""
    return rows.agg(
        *[
            F.coalesce(F.sum(name), F.lit(0)).cast(dict(rows.dtypes)[name]).alias(name)
            for name in MEASURES
        ]
    )


def measure_sessions(facts: DataFrame, catalog: Catalog, session_ids: DataFrame) -> DataFrame:
    """Digest of the requested sessions, in one pass over the facts.

    ``scope`` tells the rows apart: ``session_row`` (by session, agent, model, kind), ``session`` (its
    totals, present and zero for sessions without facts), ``total_row`` and ``total`` (over all
    requested sessions). ``matched`` is whether there were facts.
    """
    wanted = session_ids.select("session_id").distinct()
    chosen = of_sessions(facts, wanted)
    dims = ["session_id", "agent", "model", "token_kind"]
    groups = token_groups(
        with_unit_prices(chosen, catalog),
        {
            "session_id": F.col("session_id"),
            "agent": F.col("agent"),
            "model": F.col("model_key"),
            "token_kind": F.col("token_kind"),
        },
    )
    # An empty group per requested session gives unmatched sessions their zero totals.
    empty = wanted.select(
        "session_id",
        *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns[1:-3]],
        F.lit("priced").alias("pricing_status"),
        F.lit(0).cast("bigint").alias("tokens"),
        F.lit(0).cast("bigint").alias("facts"),
    )
    sets = [dims, ["session_id"], dims[1:], []]
    rows = (
        groups.unionByName(empty)
        .groupingSets([[F.col(c) for c in s] for s in sets], *dims)
        .agg(F.grouping_id().alias("level"), F.sum("facts").alias("facts"), *measures())
    )
    scopes = {0b0000: "session_row", 0b0111: "session", 0b1000: "total_row", 0b1111: "total"}
    scope = F.coalesce(*[F.when(F.col("level") == n, s) for n, s in scopes.items()])
    rows = rows.withColumn("scope", scope).withColumn("matched", F.col("facts") > 0)
    return rows.filter(F.col("matched") | F.col("scope").isin("session", "total")).select(
        "scope", *dims, "matched", *MEASURES, "pricing_status"
    )


def sessions_matched(facts: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Every requested id once, whether it has facts, and its tokens."""
    wanted = session_ids.select("session_id").distinct()
    counted = (
        of_sessions(facts, wanted)
        .groupBy("session_id")
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("facts"))
    )
    empty = wanted.select(
        "session_id", F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("facts")
    )
    return (
        counted.unionByName(empty)
        .groupBy("session_id")
        .agg(
            (F.sum("facts") > 0).alias("matched"),
            F.sum("facts").alias("facts"),
            F.sum("tokens").alias("tokens"),
        )
    )


def source_quality_counts(facts: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Number of facts per source quality in the requested sessions, zeros included."""
    counted = of_sessions(facts, session_ids).agg(
        *[F.count_if(F.col("source_quality") == q).alias(q) for q in SOURCE_QUALITIES]
    )
    return counted.unpivot([], list(SOURCE_QUALITIES), "source_quality", "facts")
