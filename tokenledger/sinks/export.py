"""Fact export: only the fields needed to reproduce a cost estimate, never paths or content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import FACT_COLUMNS
from tokenledger.functions.times import iso_utc
from tokenledger.sinks.publication import publish


def export_rows(facts: DataFrame) -> DataFrame:
    """The nine exported columns, with the instant as ISO-8601 text."""
    return facts.select(*FACT_COLUMNS).withColumn("occurred_at_utc", iso_utc(F.col("occurred_at_utc")))


def export_lines(facts: DataFrame) -> DataFrame:
    """One JSON object per fact; null session and model stay, as JSON null."""
    rows = export_rows(facts)
    return rows.select(
        F.to_json(F.struct(*FACT_COLUMNS), {"ignoreNullFields": "false"}).alias("value")
    )


def publish_export(facts: DataFrame, path: str) -> None:
    """The export with a manifest and a header naming its columns, all of it or nothing."""
    spark = facts.sparkSession
    header = spark.range(1).select(F.to_json(F.struct(F.array(*map(F.lit, FACT_COLUMNS)).alias("columns"))).alias("value"))
    publish(spark, path, {"facts": export_lines(facts)}, header)


def write_export(facts: DataFrame, path: str) -> None:
    export_lines(facts).write.text(path)
