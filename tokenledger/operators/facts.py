"""Filters and checks over facts, the one shape every source ends in."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import (
    AGENTS,
    FACT_COLUMNS,
    MODES,
    SOURCE_QUALITIES,
    TOKEN_KINDS,
    UNKNOWN_MODEL,
)
from tokenledger.functions.models import model_key
from tokenledger.operators.joins import lookup
from tokenledger.session import written


def in_window(facts: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Facts with ``since <= t < until``; either bound may be open."""
    if since is not None:
        facts = facts.filter(F.col("occurred_at_utc") >= since)
    if until is not None:
        facts = facts.filter(F.col("occurred_at_utc") < until)
    return facts


def of_agents(facts: DataFrame, agents: Iterable[str]) -> DataFrame:
    """Facts of the named agents; a name no fact has matches nothing."""
    return facts.filter(F.col("agent").isin(*agents))


def of_sessions(facts: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Facts of the requested sessions, however often an id was requested."""
    wanted = session_ids.select(F.col("session_id").alias("wanted_id")).distinct()
    return lookup(facts, wanted, {"session_id": "wanted_id"}, how="left_semi")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Facts of all sources. Equal facts stay: each one was billed."""
    return reduce(DataFrame.unionByName, [source.select(*FACT_COLUMNS) for source in sources])


def with_model_keys(rows: DataFrame) -> DataFrame:
    """Adds ``model_key`` of ``model_raw``. There are far fewer names than rows, so the rules for names run once
    per distinct name; the names are written, as they are measured before they are joined."""
    raw = written(rows.select(F.col("model_raw").alias("raw_name")).filter(F.col("raw_name").isNotNull()).distinct())
    names = raw.select("raw_name", model_key(F.col("raw_name")).alias("model_key"))
    keyed = lookup(rows, names, {"model_raw": "raw_name"}).drop("raw_name")
    return keyed.withColumn("model_key", F.coalesce("model_key", F.lit(UNKNOWN_MODEL)))


def domain_violations(facts: DataFrame) -> DataFrame:
    """Facts outside their domain, one row per broken rule, with the ``reason``."""

    def outside(column: str, allowed: tuple[str, ...]) -> Column:
        return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))

    rules = {
        "invalid agent": outside("agent", AGENTS),
        "invalid token_kind": outside("token_kind", TOKEN_KINDS),
        "invalid mode": outside("mode", MODES),
        "invalid source_quality": outside("source_quality", SOURCE_QUALITIES),
        "negative tokens": F.coalesce(F.col("tokens") < 0, F.lit(True)),
        "missing instant": F.col("occurred_at_utc").isNull(),
    }
    reasons = F.array(*[F.when(broken, reason) for reason, broken in rules.items()])
    return (
        facts.withColumn("reason", F.explode(reasons)).filter(F.col("reason").isNotNull())
    )
