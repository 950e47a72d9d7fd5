"""Rate catalogs: JSON documents with a header and, per model, prices that change over time.

Decimals and times stay text until they are used, so that integrity checks see what was written.
A catalog handed in replaces any other, nothing is merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tokenledger.fixed_values import RATE_FIELDS
from tokenledger.functions.times import instant
from tokenledger.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS

_FIELDS = ", ".join(f"{field}: string" for field in RATE_FIELDS)
_PERIOD = f"struct<rate_id: string, effective_from: string, effective_until: string, {_FIELDS}>"
MODEL_ENTRY = (
    "struct<model_key: string, aliases: array<string>, fast_multiplier: string, "
    f"credits_per_mtok: struct<{_FIELDS}>, rates: array<{_PERIOD}>>"
)
_HEADER_FIELDS = ("schema_version", "catalog_version", "currency", "unit", "usd_per_credit")
_DOCUMENT = ", ".join(f"{f} string" for f in _HEADER_FIELDS) + f", models array<{MODEL_ENTRY}>"

RATE = "decimal(18,9)"
MULTIPLIER = "decimal(12,6)"
# Wide enough to tell what a written value loses in one of these.
_WRITTEN = "decimal(38,28)"


def held_exactly(written: Column, kind: str) -> Column:
    """Written text as a decimal of ``kind``; null where it is no decimal, or one that ``kind`` cannot hold."""
    value = written.try_cast(_WRITTEN)
    held = value.try_cast(kind)
    return F.when(held == value, held)


def exact(written: Column, kind: str) -> Column:
    """Like :func:`held_exactly`, but text without an exact value fails the query that uses it."""
    held = held_exactly(written, kind)
    broken = F.raise_error(F.concat(F.lit(f"no exact {kind}: "), written)).cast(kind)
    return F.when(written.isNotNull(), F.coalesce(held, broken))


@dataclass(frozen=True)
class Catalog:
    """``headers``: one row per document. ``entries``: one row per model, with nested periods."""

    headers: DataFrame
    entries: DataFrame

    @cached_property
    def _measures(self) -> Row:
        """Measured once per catalog, on the entries, in parallel."""
        entry_rows = F.size(all_names()) * F.coalesce(F.size("rates"), F.lit(0)) * 2 * (len(RATE_FIELDS) + 1)
        return self.entries.agg(
            F.coalesce(F.sum(entry_rows), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(entry_rows * F.length("model_key")), F.lit(0)).alias("text"),
            F.coalesce(F.max(F.size("rates")), F.lit(0)).alias("periods"),
        ).first()

    @property
    def is_small(self) -> bool:
        """Whether every lookup table made from the entries is measured to fit a broadcast.

        The largest has a row per name, period, kind and speed.
        """
        size = self._measures
        return size["rows"] <= BROADCAST_ROWS and size["rows"] * 100 + size["text"] <= BROADCAST_BYTES

    @property
    def most_periods(self) -> int:
        """How many periods the model with the most has."""
        return self._measures["periods"]

    @cached_property
    def is_single(self) -> bool:
        """Whether there is exactly one document. Prices of several would add up for the same fact."""
        return len(self.headers.select("catalog_id").limit(2).collect()) == 1

    def require_single(self) -> Catalog:
        if not self.is_single:
            raise PySparkException("prices come from exactly one rate catalog")
        return self

    @property
    def models(self) -> DataFrame:
        """Keys and fast multipliers; a model without a multiplier has 1."""
        multiplier = F.coalesce(F.col("fast_multiplier").try_cast(MULTIPLIER), F.lit(1).cast(MULTIPLIER))
        return self.entries.select("catalog_id", "model_key", multiplier.alias("fast_multiplier"))

    @property
    def aliases(self) -> DataFrame:
        return self.entries.select("catalog_id", "model_key", F.explode("aliases").alias("alias"))

    @property
    def periods(self) -> DataFrame:
        """One row per price period, with the five prices as written."""
        return self.entries.select(
            "catalog_id", "model_key", F.explode("rates").alias("rate")
        ).select(
            "catalog_id",
            "model_key",
            "rate.rate_id",
            F.col("rate.effective_from").alias("from_text"),
            F.nullif("rate.effective_until", F.lit("")).alias("until_text"),
            instant(F.col("rate.effective_from")).alias("effective_from"),
            instant(F.nullif("rate.effective_until", F.lit(""))).alias("effective_until"),
            *[F.col(f"rate.{field}") for field in RATE_FIELDS],
        )

    @property
    def rates(self) -> DataFrame:
        """One row per period and rate field; a null price means the field is not priced."""
        keys = ["catalog_id", "model_key", "rate_id", "effective_from", "effective_until"]
        return (
            self.periods.unpivot(keys, list(RATE_FIELDS), "rate_field", "written")
            .withColumn("usd_per_mtok", F.col("written").try_cast(RATE))
        )

    @property
    def credits(self) -> DataFrame:
        """One row per model with a credit table and rate field."""
        return (
            self.entries.filter(F.col("credits_per_mtok").isNotNull())
            .select("catalog_id", "model_key", "credits_per_mtok.*")
            .unpivot(["catalog_id", "model_key"], list(RATE_FIELDS), "rate_field", "written")
            .withColumn("credits_per_mtok", F.col("written").try_cast(RATE))
        )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Catalog documents with the sha256 of their exact bytes."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("catalog_id"),
        F.decode("content", "UTF-8").alias("document"),
        fingerprint(F.col("content")).alias("sha256"),
    )


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def catalog_from_documents(docs: DataFrame) -> Catalog:
    """Header and models of each document in a frame of ``catalog_id, document, sha256``."""
    doc = F.from_json("document", _DOCUMENT, {"allowSingleQuotes": "false", "mode": "FAILFAST"})
    opened = docs.select("catalog_id", "sha256", F.inline(F.array(doc)))
    headers = opened.select("catalog_id", "sha256", *_HEADER_FIELDS)
    return Catalog(headers, opened.select("catalog_id", F.inline("models")))


def entries_from_lines(lines: DataFrame) -> DataFrame:
    """Model entries from one JSON object per row (``catalog_id, entry``): the form for catalogs too
    large for one document."""
    entry = F.from_json("entry", MODEL_ENTRY, {"allowSingleQuotes": "false", "mode": "FAILFAST"})
    return lines.select("catalog_id", F.inline(F.array(entry)))


def all_names() -> Column:
    """Key and aliases of an entry, each once."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array("model_key"), aliases))


def usd_per_credit(headers: DataFrame) -> DataFrame:
    """Price of a credit per catalog, 0 where the header gives none."""
    price = F.coalesce(F.col("usd_per_credit").try_cast(RATE), F.lit(0).cast(RATE))
    return headers.select("catalog_id", price.alias("usd_per_credit"))
