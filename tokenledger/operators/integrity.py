"""Integrity checks of rate catalogs. Each gives the violations, so an empty frame is a valid catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import (
    CATALOG_CURRENCY,
    CATALOG_SCHEMA_VERSION,
    CATALOG_UNIT,
    RATE_FIELDS,
)
from tokenledger.operators.joins import lookup
from tokenledger.operators.ordering import carry_along
from tokenledger.operators.pricing import unit_price
from tokenledger.sources.catalog import MULTIPLIER, RATE, Catalog, all_names, held_exactly, usd_per_credit


def _reasons(rules: dict[str, Column]) -> Column:
    found = F.array(*[F.when(broken, reason) for reason, broken in rules.items()])
    return F.explode(F.array_compact(found))


def _not(column: str, allowed: str) -> Column:
    return F.coalesce(F.col(column) != allowed, F.lit(True))


def header_violations(headers: DataFrame) -> DataFrame:
    """Headers without a version, or of a schema, currency or unit that is not understood."""
    rules = {
        "missing catalog_version": F.coalesce(F.col("catalog_version") == "", F.lit(True)),
        "unsupported schema_version": _not("schema_version", CATALOG_SCHEMA_VERSION),
        "unsupported currency": _not("currency", CATALOG_CURRENCY),
        "unsupported unit": _not("unit", CATALOG_UNIT),
    }
    return headers.select("catalog_id", _reasons(rules).alias("reason"))


def missing_fields(catalog: Catalog) -> DataFrame:
    def missing(column: str) -> Column:
        return F.coalesce(F.col(column) == "", F.lit(True))

    models = catalog.entries.filter(missing("model_key")).select(
        "catalog_id",
        "model_key",
        F.lit(None).cast("string").alias("rate_id"),
        F.lit("missing model_key").alias("reason"),
    )
    rules = {
        "missing rate_id": missing("rate_id"),
        "missing effective_from": F.col("from_text").isNull(),
    }
    periods = catalog.periods.select("catalog_id", "model_key", "rate_id", _reasons(rules).alias("reason"))
    return models.unionByName(periods)


def duplicate_models(catalog: Catalog) -> DataFrame:
    return (
        catalog.entries.filter(F.col("model_key").isNotNull())
        .groupBy("catalog_id", "model_key")
        .agg(F.count(F.lit(1)).alias("entries"))
        .filter(F.col("entries") > 1)
    )


def alias_collisions(catalog: Catalog) -> DataFrame:
    """Aliases that are themselves a model key: their own model's or another's."""
    own = F.col("alias") == F.col("model_key")
    keys = catalog.entries.select("catalog_id", F.col("model_key").alias("alias")).distinct()
    return (
        catalog.aliases.join(keys, ["catalog_id", "alias"])
        .withColumn("reason", F.when(own, "own model_key").otherwise("another model_key"))
        .select("catalog_id", "model_key", "alias", "reason")
    )


def duplicate_aliases(catalog: Catalog) -> DataFrame:
    return (
        catalog.aliases.groupBy("catalog_id", "alias")
        .agg(F.count(F.lit(1)).alias("uses"))
        .filter(F.col("uses") > 1)
    )


_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def value_violations(catalog: Catalog) -> DataFrame:
    """Prices, credits, multipliers and credit prices that are no decimal, negative, or that the decimals
    this library computes in do not hold exactly; also prices per token, fast or not."""
    rates = catalog.rates.select("catalog_id", "model_key", "rate_id", F.col("rate_field").alias("field"), "written")
    none = F.lit(None).cast("string").alias("rate_id")
    credits = catalog.credits.select(
        "catalog_id", "model_key", none, F.concat(F.lit("credits."), "rate_field").alias("field"), "written"
    )
    multipliers = catalog.entries.select(
        "catalog_id",
        "model_key",
        none,
        F.lit("fast_multiplier").alias("field"),
        F.col("fast_multiplier").alias("written"),
    )
    credit_price = catalog.headers.select(
        "catalog_id",
        F.lit(None).cast("string").alias("model_key"),
        none,
        F.lit("usd_per_credit").alias("field"),
        F.col("usd_per_credit").alias("written"),
    )
    values = rates.unionByName(credits).unionByName(multipliers).unionByName(credit_price)
    written, is_multiplier = F.col("written"), F.col("field") == "fast_multiplier"
    held = F.when(is_multiplier, held_exactly(written, MULTIPLIER).isNotNull()).otherwise(
        held_exactly(written, RATE).isNotNull()
    )
    # Both types leave as many digits before the point as a double tells apart exactly.
    limit = F.when(is_multiplier, F.lit(1e6)).otherwise(F.lit(1e9))
    number = written.try_cast("double")
    reason = (
        F.when(~written.rlike(_DECIMAL), "not a decimal")
        .when(number < 0, "negative")
        .when(~held, F.when(number >= limit, "too large").otherwise("too fine"))
    )
    broken = values.filter(written.isNotNull()).withColumn("reason", reason)
    return broken.filter(F.col("reason").isNotNull()).unionByName(_unit_price_violations(catalog))


def _unit_price_violations(catalog: Catalog) -> DataFrame:
    """Prices that are fine as written, but not per token."""
    multiplier = F.coalesce(held_exactly(F.col("fast_multiplier"), MULTIPLIER), F.lit(1).cast(MULTIPLIER))
    priced = catalog.entries.select(
        "catalog_id", "model_key", multiplier.alias("multiplier"), "credits_per_mtok", F.explode_outer("rates").alias("rate")
    )
    fields = [
        F.struct(rate_id.alias("rate_id"), F.lit(f"{prefix}{field}").alias("field"), F.col(f"{column}.{field}").alias("written"))
        for column, prefix, rate_id in (
            ("rate", "", F.col("rate.rate_id")),
            ("credits_per_mtok", "credits.", F.lit(None).cast("string")),
        )
        for field in RATE_FIELDS
    ]
    values = priced.select("catalog_id", "model_key", "multiplier", F.inline(F.array(*fields))).distinct()
    price, one = held_exactly(F.col("written"), RATE), F.lit(1).cast(MULTIPLIER)
    plain, fast = unit_price(price, one), unit_price(price, F.col("multiplier"))
    largest = price.cast("double") * F.greatest(F.col("multiplier").cast("double"), F.lit(1.0))
    broken = values.filter((price >= 0) & (F.col("multiplier") >= 0) & (plain.isNull() | fast.isNull()))
    reason = F.when(largest >= 1e7, "too large per token").otherwise("too fine per token")
    return broken.select("catalog_id", "model_key", "rate_id", "field", "written", reason.alias("reason"))


def period_bound_violations(catalog: Catalog) -> DataFrame:
    """Periods with an unreadable bound, or that end before they start."""
    start, end = F.col("effective_from"), F.col("effective_until")
    rules = {
        "unreadable effective_from": F.col("from_text").isNotNull() & start.isNull(),
        "unreadable effective_until": F.col("until_text").isNotNull() & end.isNull(),
        "ends before it starts": F.coalesce(end <= start, F.lit(False)),
    }
    return catalog.periods.select("catalog_id", "model_key", "rate_id", _reasons(rules).alias("reason"))


def period_overlaps(catalog: Catalog) -> DataFrame:
    """Neighbouring periods of a model, by start, where the first ends after the second starts.

    Touching periods are fine, an open period ends never. Periods are grouped by model and month of
    their start, so that a model with very many of them is still many tasks.
    """
    periods = (
        catalog.periods.filter(F.col("model_key").isNotNull() & F.col("effective_from").isNotNull())
        .withColumn("block", (F.year("effective_from") * 12 + F.month("effective_from")).cast("bigint"))
        .withColumn("pos", F.struct("effective_from", "rate_id"))
        .select("catalog_id", "model_key", "rate_id", "effective_from", "effective_until", "block", "pos")
    )
    paired = carry_along(periods, ["catalog_id", "model_key"], latest={"earlier": F.lit(True)})
    still_open = F.col("earlier.effective_until").isNull()
    overlap = still_open | (F.col("earlier.effective_until") > F.col("effective_from"))
    return paired.filter(F.col("earlier").isNotNull() & overlap).select(
        "catalog_id",
        "model_key",
        F.col("earlier.rate_id").alias("first_rate_id"),
        F.col("rate_id").alias("second_rate_id"),
    )


def credit_inconsistencies(catalog: Catalog) -> DataFrame:
    """Prices that are not credits times the price of a credit, where both are given."""
    fields = [
        F.struct(
            F.lit(field).alias("rate_field"),
            F.col(f"rate.{field}").try_cast(RATE).alias("usd_per_mtok"),
            F.col(f"credits_per_mtok.{field}").try_cast(RATE).alias("credits_per_mtok_value"),
        )
        for field in RATE_FIELDS
    ]
    priced = (
        catalog.entries.select(
            "catalog_id", "model_key", "credits_per_mtok", F.explode("rates").alias("rate")
        )
        .select("catalog_id", "model_key", "rate.rate_id", F.inline(F.array(*fields)))
        .filter(F.col("usd_per_mtok").isNotNull() & F.col("credits_per_mtok_value").isNotNull())
        .withColumnRenamed("credits_per_mtok_value", "credits_per_mtok")
    )
    credit = usd_per_credit(catalog.headers).withColumnRenamed("catalog_id", "header_id")
    expected = F.col("credits_per_mtok") * F.col("usd_per_credit")
    return (
        lookup(priced, credit, {"catalog_id": "header_id"}, how="inner")
        .filter(F.col("usd_per_mtok") != expected)
        .drop("header_id")
    )


def violations(catalog: Catalog) -> DataFrame:
    """Everything that makes a catalog unusable, as one frame of rule and subject."""

    def named(rule: str, found: DataFrame, *subject: str) -> DataFrame:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in subject]
        return found.select("catalog_id", F.lit(rule).alias("rule"), F.concat_ws(" ", *parts).alias("subject"))

    return (
        named("header", header_violations(catalog.headers), "reason")
        .unionByName(named("missing field", missing_fields(catalog), "model_key", "rate_id", "reason"))
        .unionByName(named("duplicate model", duplicate_models(catalog), "model_key"))
        .unionByName(named("alias collision", alias_collisions(catalog), "model_key", "alias"))
        .unionByName(named("duplicate alias", duplicate_aliases(catalog), "alias"))
        .unionByName(named("value", value_violations(catalog), "model_key", "rate_id", "field", "reason"))
        .unionByName(named("period bounds", period_bound_violations(catalog), "model_key", "rate_id", "reason"))
        .unionByName(named("period overlap", period_overlaps(catalog), "model_key", "first_rate_id", "second_rate_id"))
    )


def catalog_summary(catalog: Catalog) -> DataFrame:
    """Header, number of models and the sorted model keys: one row per key, and one with a null key
    for a catalog without models."""
    keys = catalog.entries.select("catalog_id", "model_key").filter(F.col("model_key").isNotNull()).distinct()
    counts = keys.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("model_count"))
    headers = (
        catalog.headers.select("catalog_id", "catalog_version", "currency", "unit", "usd_per_credit")
        .join(counts, "catalog_id", "left")
        .fillna(0, "model_count")
    )
    without_models = headers.filter(F.col("model_count") == 0).withColumn(
        "model_key", F.lit(None).cast("string")
    )
    with_models = lookup(
        keys, headers.withColumnRenamed("catalog_id", "header_id"), {"catalog_id": "header_id"}, how="inner"
    ).drop("header_id")
    return with_models.unionByName(without_models).orderBy("catalog_id", "model_key")


def rate_history(catalog: Catalog, names: DataFrame) -> DataFrame:
    """All prices over time of the models ``queried``, by key or alias, by period start.

    Names are taken as they are; those the catalog does not know give no row.
    """
    entries = catalog.entries.select(
        "catalog_id", "model_key", "fast_multiplier", "rates", F.explode(all_names()).alias("name")
    )
    wanted = names.select("queried").distinct()
    found = lookup(entries, wanted, {"name": "queried"}, how="inner").select(
        "catalog_id", "queried", "model_key", "fast_multiplier", F.explode("rates").alias("rate")
    )
    prices = F.array(
        *[
            F.struct(
                F.lit(field).alias("rate_field"),
                F.coalesce(F.col(f"rate.{field}"), F.lit("(unpriced)")).alias("price"),
            )
            for field in RATE_FIELDS
        ]
    )
    return found.select(
        "catalog_id",
        "queried",
        "model_key",
        F.coalesce("fast_multiplier", F.lit("1.0")).alias("fast_multiplier"),
        "rate.rate_id",
        F.col("rate.effective_from").alias("effective_from"),
        F.coalesce(F.nullif("rate.effective_until", F.lit("")), F.lit("(open)")).alias("effective_until"),
        F.inline(prices),
    ).orderBy("catalog_id", "queried", "effective_from", "rate_field")
