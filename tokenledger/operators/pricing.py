"""Facts against a rate catalog, in exact decimals.

Prices per token are worked out once per catalog row: rate x multiplier / 1e6 has at most 17 decimals
and is below 10, so it fits 18 digits, which Spark keeps in a long. A price that has no exact value in
these types fails the job, it is neither rounded nor left out; catalog checks name it beforehand. Token
counts are added up per price first and multiplied once per group, never once per fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import RATE_FIELDS
from tokenledger.functions.times import instant
from tokenledger.operators.intervals import CROWDED, cover_join, covers
from tokenledger.operators.joins import lookup
from tokenledger.sources.catalog import MULTIPLIER, RATE, Catalog, all_names, exact

UNIT = "decimal(18,17)"
_PER_TOKEN = "0.000001"


def model_names(catalog: Catalog) -> DataFrame:
    """Every name the catalog knows, keys and aliases, with the key it stands for."""
    return catalog.require_single().entries.select(
        F.explode(all_names()).alias("catalog_name"), F.col("model_key").alias("resolved_key")
    )


def resolve_alias(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``resolved_key``: the catalog's key for ``model_key``, null when it knows no such name."""
    names = model_names(catalog)
    found = lookup(facts, names, {"model_key": "catalog_name"}, broadcast=catalog.is_small)
    return found.drop("catalog_name")


def _covering(
    facts: DataFrame, periods: DataFrame, catalog: Catalog, on: dict[str, str], start: str, end: str
) -> DataFrame:
    """Facts with the ``periods`` of their key that cover them. Of a catalog whose models have few periods, a fact
    meets all of its model; else those of its cell of time."""
    if catalog.most_periods > CROWDED:
        return cover_join(facts, periods, on, "occurred_at_utc", start, end)
    condition = covers(F.col("occurred_at_utc"), F.col(start), F.col(end))
    return lookup(facts, periods, on, condition=condition, broadcast=catalog.is_small)


def lookup_period(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``resolved_key`` and ``rate_id``: the price period covering each fact.

    An unknown model has neither; a known model outside all its periods has only the key.
    """
    periods = catalog.periods.select(
        F.col("model_key").alias("period_model"),
        "rate_id",
        F.col("effective_from").alias("period_from"),
        F.col("effective_until").alias("period_until"),
    )
    return _covering(
        resolve_alias(facts, catalog), periods, catalog, {"resolved_key": "period_model"}, "period_from", "period_until"
    ).drop("period_model", "period_from", "period_until")


def unit_price(price: Column, factor: Column) -> Column:
    """Price of one token; null where :data:`UNIT` cannot hold it exactly."""
    whole = price * factor * F.lit(_PER_TOKEN).cast("decimal(6,6)")
    held = whole.try_cast(UNIT)
    return F.when(held == whole, held)


def _unit_or_fail(price: Column, factor: Column) -> Column:
    broken = F.raise_error(F.concat(F.lit("no exact price per token: "), price.cast("string"))).cast(UNIT)
    return F.when(price.isNotNull(), F.coalesce(unit_price(price, factor), broken))


def price_book(catalog: Catalog) -> DataFrame:
    """One row per name, period, priced kind and speed: what one token costs then.

    Cache writes of unknown duration go at the 5-minute price, as a lower bound. Taken from the nested
    entries without a join; fields without a price have no row.
    """
    multiplier = F.coalesce(exact(F.col("fast_multiplier"), MULTIPLIER), F.lit(1).cast(MULTIPLIER))
    periods = catalog.require_single().entries.select(
        F.explode(all_names()).alias("book_name"),
        multiplier.alias("multiplier"),
        F.col("credits_per_mtok").alias("credit"),
        "rates",
    ).select("book_name", "multiplier", "credit", F.explode("rates").alias("rate"))

    def priced(kind: str, field: str, status: str) -> Column:
        return F.struct(
            F.lit(kind).alias("book_kind"),
            exact(F.col(f"rate.{field}"), RATE).alias("usd"),
            exact(F.col(f"credit.{field}"), RATE).alias("credit"),
            F.lit(status).alias("book_status"),
        )

    kinds = [priced(field, field, "priced") for field in RATE_FIELDS]
    kinds.append(priced("cache_write_unknown", "cache_write_5m", "lower_bound"))
    one = F.lit(1).cast(MULTIPLIER)
    speeds = F.array(
        F.struct(F.lit(False).alias("book_fast"), one.alias("factor")),
        F.struct(F.lit(True).alias("book_fast"), F.col("multiplier").alias("factor")),
    )
    return (
        periods.select("*", F.inline(speeds))
        .select(
            "book_name",
            "book_fast",
            "factor",
            instant(F.col("rate.effective_from")).alias("book_from"),
            instant(F.nullif("rate.effective_until", F.lit(""))).alias("book_until"),
            F.inline(F.array(*kinds)),
        )
        .filter(F.col("usd").isNotNull())
        .select(
            "book_name",
            "book_kind",
            "book_fast",
            "book_from",
            "book_until",
            "book_status",
            _unit_or_fail(F.col("usd"), F.col("factor")).alias("usd_per_token"),
            _unit_or_fail(F.col("credit"), F.col("factor")).alias("credits_per_token"),
        )
    )


def with_unit_prices(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``usd_per_token``, ``credits_per_token`` and ``pricing_status``; no price is ``unpriced``,
    which is not the same as a price of zero."""
    on = {"model_key": "book_name", "token_kind": "book_kind", "is_fast": "book_fast"}
    fast = facts.withColumn("is_fast", F.col("mode") == "fast")
    joined = _covering(fast, price_book(catalog), catalog, on, "book_from", "book_until")
    return joined.select(
        *facts.columns,
        "usd_per_token",
        "credits_per_token",
        F.coalesce("book_status", F.lit("unpriced")).alias("pricing_status"),
    )


def amount(tokens: Column, unit: Column) -> Column:
    """Exact product of a token count and a price per token, as decimal(38,17)."""
    return tokens.cast("decimal(19,0)") * unit


def price_facts(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """Each fact with its cost and credits (null when unpriced) and pricing status."""
    tokens = F.col("tokens")
    return with_unit_prices(facts, catalog).select(
        *facts.columns,
        amount(tokens, F.col("usd_per_token")).alias("estimated_cost_usd"),
        amount(tokens, F.col("credits_per_token")).alias("credits"),
        "pricing_status",
    )
