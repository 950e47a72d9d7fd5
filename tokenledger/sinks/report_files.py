"""Reports as files and documents.

Rows go to part files, one per task, however many there are. A report or digest with what describes it is an
:class:`Envelope`: a one-row JSON header, and the rows as part files beside it, in one layout for all sizes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import (
    DIGEST_PROTOCOL_VERSION,
    REPORT_COLUMNS,
    REPORT_SCHEMA_VERSION,
)
from tokenledger.functions.cells import cost_cell, credits_cell, text_cell
from tokenledger.functions.times import iso_utc
from tokenledger.operators.report import MEASURES, as_output
from tokenledger.sinks.publication import publish, read_published

_KEEP_NULLS = {"ignoreNullFields": "false"}
# What a report is ordered by.
REPORT_KEYS = ("month", "agent", "model", "token_kind")
# Rows up to which a report is read as one object.
DOCUMENT_ROWS = 10_000
_DIGEST_KEYS = ("agent", "model", "token_kind")


def write_report_csv(rows: DataFrame, path: str) -> None:
    """The ten report columns with a header; null is an empty field."""
    as_output(rows).select(*REPORT_COLUMNS).write.option("header", "true").csv(path)


def write_report_json(rows: DataFrame, path: str) -> None:
    """One JSON object per report row, nulls kept."""
    as_output(rows).select(*REPORT_COLUMNS).write.options(**_KEEP_NULLS).json(path)


def write_digest_json(digest: DataFrame, path: str) -> None:
    """One JSON object per digest row, with its scope."""
    as_output(digest).write.options(**_KEEP_NULLS).json(path)


def report_cells(rows: DataFrame) -> DataFrame:
    """Report rows as display text."""
    special = {"estimated_cost_usd": cost_cell, "credits": credits_cell}
    return rows.select(
        *[special.get(name, text_cell)(F.col(name)).alias(name) for name in REPORT_COLUMNS]
    )


def _optional_iso(moment: Column | None) -> Column:
    return F.lit(None).cast("string") if moment is None else iso_utc(moment)


def _window(since: Column | None, until: Column | None) -> Column:
    return F.struct(_optional_iso(since).alias("since"), _optional_iso(until).alias("until"))


@dataclass(frozen=True)
class Envelope:
    """``header``: one row with the column ``value``, a JSON object. ``parts``: named frames of rows."""

    header: DataFrame
    parts: dict[str, DataFrame]


def write_envelope(envelope: Envelope, path: str) -> None:
    """``<path>/header`` and one folder per part, JSON lines, all of them or none; see
    :mod:`~tokenledger.sinks.publication`."""
    parts = {
        name: rows.select(F.to_json(F.struct(*rows.columns), _KEEP_NULLS).alias("value"))
        for name, rows in envelope.parts.items()
    }
    publish(envelope.header.sparkSession, path, parts, envelope.header)


def read_document(spark: SparkSession, path: str, most_rows: int = DOCUMENT_ROWS) -> dict[str, Any]:
    """A written report or digest as one object, for results of at most ``most_rows`` rows: the header's fields, and
    ``rows``, or ``sessions`` by their id and ``total``."""
    header, parts = read_published(spark, path)
    read = {}
    for name, lines in parts.items():
        found = lines.limit(most_rows + 1).collect()
        if len(found) > most_rows:
            raise PySparkException(f"{path} has more than {most_rows} {name}; read it as a table")
        read[name] = [json.loads(row["value"]) for row in found]
    document = json.loads(header)
    if "rows" in read:
        return {**document, "rows": sorted(read["rows"], key=lambda row: [row[key] or "" for key in REPORT_KEYS])}
    sessions = {one.pop("session_id"): one for one in sorted(read["sessions"], key=lambda one: one["session_id"])}
    return {**document, "session_ids": list(sessions), "sessions": sessions, "total": read["total"][0]}


def _side_by_side(*single_rows: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    keyed = [frame.withColumn("_one", F.lit(1)) for frame in single_rows]
    joined = keyed[0]
    for frame in keyed[1:]:
        joined = joined.join(F.broadcast(frame), "_one")
    return joined.drop("_one")


def _rates(headers: DataFrame) -> DataFrame:
    return headers.agg(F.first(F.struct("catalog_version", "sha256")).alias("rates"))


def report_envelope(
    rows: DataFrame,
    *,
    headers: DataFrame,
    data_quality: DataFrame,
    group_by: Sequence[str],
    timezone: str,
    since: Column | None = None,
    until: Column | None = None,
) -> Envelope:
    """A report with its header; the part ``rows`` has one object per report row."""
    quality = data_quality.select(F.struct(*data_quality.columns).alias("data_quality"))
    header = _side_by_side(_rates(headers), quality).select(
        F.to_json(
            F.struct(
                F.lit(REPORT_SCHEMA_VERSION).alias("schema_version"),
                iso_utc(F.current_timestamp()).alias("generated_at"),
                _window(since, until).alias("window"),
                F.lit(timezone).alias("timezone"),
                "rates",
                F.array(*[F.lit(name) for name in group_by]).alias("group_by"),
                "data_quality",
            ),
            _KEEP_NULLS,
        ).alias("value")
    )
    return Envelope(header, {"rows": as_output(rows).select(*REPORT_COLUMNS)})


def digest_envelope(
    digest: DataFrame,
    *,
    headers: DataFrame,
    data_quality: DataFrame,
    source_quality: DataFrame,
    agents: Sequence[str],
    timezone: str,
    since: Column | None = None,
    until: Column | None = None,
) -> Envelope:
    """A digest with its header. ``sessions`` has one object per session, sorted by id, with its rows and
    totals; ``total`` has one, over all sessions. An object's rows are one per agent, model and kind in it."""
    rows = as_output(digest).withColumn("month", F.lit(None).cast("string"))
    is_row = F.col("scope").endswith("_row")
    row = F.when(is_row, F.struct(*REPORT_COLUMNS))
    keys = F.struct(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in _DIGEST_KEYS])
    entry = F.when(is_row, F.struct(keys.alias("keys"), row.alias("row")))
    grouped = rows.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["row"]).alias("rows"),
        F.first(F.when(~is_row, F.struct(*MEASURES)), ignorenulls=True).alias("totals"),
        F.first(F.when(~is_row, F.col("matched")), ignorenulls=True).alias("matched"),
        F.first("scope").startswith("total").alias("is_total"),
    )
    sessions = grouped.filter(~F.col("is_total")).select("session_id", "matched", "rows", "totals")
    total = grouped.filter("is_total").select("rows", "totals")
    # One row per source quality, a fixed number.
    qualities = source_quality.agg(
        F.map_from_entries(F.collect_list(F.struct("source_quality", "facts"))).alias("source_quality")
    )
    header = _side_by_side(_rates(headers), qualities, data_quality).select(
        F.to_json(
            F.struct(
                F.lit(DIGEST_PROTOCOL_VERSION).alias("protocol_version"),
                iso_utc(F.current_timestamp()).alias("generated_at"),
                _window(since, until).alias("window"),
                F.lit(timezone).alias("timezone"),
                F.array(*[F.lit(agent) for agent in sorted(agents)]).alias("agent"),
                "rates",
                F.struct(*data_quality.columns, "source_quality").alias("data_quality"),
            ),
            _KEEP_NULLS,
        ).alias("value")
    )
    return Envelope(header, {"sessions": sessions.orderBy("session_id"), "total": total})
