"""Append-only JSON-lines logs.

A *line frame* has the columns ``file``, ``block``, ``pos``, ``line``. The physical order of a file is
``(block, pos)``: a block is the part of a file one task reads, so neither reading nor ordering ever
needs a whole file in one place.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.fixed_values import FILE_AGE_SLACK
from tokenledger.functions.models import SPACES

LINE_SCHEMA = "file string, block bigint, pos bigint, line string"
LISTING_SCHEMA = "file string, modified_at timestamp, size bigint"

_COUNTS = "input_tokens variant, cache_read_input_tokens variant, cache_creation_input_tokens variant"
_TTL = "ephemeral_5m_input_tokens variant, ephemeral_1h_input_tokens variant"
SESSION_EVENT = (
    "struct<type: string, timestamp: string, sessionId: string, message: struct<model: string, "
    f"usage: struct<{_COUNTS}, cache_creation: struct<{_TTL}>, output_tokens variant, speed variant>>>"
)
_TOTALS = "input_tokens variant, cached_input_tokens variant, output_tokens variant"
ROLLOUT_EVENT = (
    "struct<type: string, timestamp: string, payload: struct<type: string, "
    f"collaboration_mode_kind: string, info: struct<total_token_usage: struct<{_TOTALS}>>>>"
)


def plain_path(uri: Column) -> Column:
    """A ``file`` value as a plain path: no ``file:`` scheme, no percent escapes."""
    return F.try_url_decode(F.regexp_replace(without_scheme(uri), r"\+", "%2B"))


def without_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^file:/+", "/")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The folders or patterns that are there, each looked up on its own: an absent one takes none with it."""
    context = spark.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop, context._jsc.hadoopConfiguration()

    def matches(path: str) -> bool:
        pattern = hadoop.fs.Path(path)
        found = pattern.getFileSystem(conf).globStatus(pattern)
        return found is not None and len(found) > 0

    return [path for path in paths if matches(path)]


def _lines(text: DataFrame, touched_since: Column | None) -> DataFrame:
    if touched_since is not None:
        text = text.filter(may_hold(F.col("_metadata.file_modification_time"), touched_since))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def lines_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the files of these names, taken as they are; removed files are left out."""
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in paths]
    return _lines(spark.read.option("ignoreMissingFiles", "true").text(literal), None)


def may_hold(modified_at: Column, since: Column) -> Column:
    """Whether a file can hold events from ``since`` on. Only ever prunes on the early side: a file
    written late may still hold early events."""
    return modified_at >= since - F.expr(FILE_AGE_SLACK)


def session_glob(root: str, pattern: str = "*.jsonl") -> str:
    """Session logs are exactly one folder below their root."""
    return f"{root.rstrip('/')}/*/{pattern}"


def session_lines(
    spark: SparkSession,
    root: str,
    *,
    pattern: str = "*.jsonl",
    touched_since: Column | None = None,
) -> DataFrame:
    """Lines of every session log; none when there is no such folder.

    A log may be removed while others are read: it is left out, and :func:`vanished_files` counts it.
    """
    glob = session_glob(root, pattern)
    if not existing(spark, [glob]):
        return spark.createDataFrame([], LINE_SCHEMA)
    return _lines(spark.read.option("ignoreMissingFiles", "true").text(glob), touched_since)


def rollout_lines(
    spark: SparkSession,
    roots: list[str],
    *,
    pattern: str = "*",
    touched_since: Column | None = None,
) -> DataFrame:
    """Lines of every file anywhere below the given folders, whatever its ending; callers keep those that a
    thread names. Removed files are left out as in :func:`session_lines`."""
    there = existing(spark, roots)
    if not there:
        return spark.createDataFrame([], LINE_SCHEMA)
    options = {"ignoreMissingFiles": "true", "recursiveFileLookup": "true", "pathGlobFilter": pattern}
    return _lines(spark.read.options(**options).text(there), touched_since)


def file_listing(
    spark: SparkSession,
    paths: list[str],
    *,
    pattern: str = "*",
    recursive: bool = False,
    touched_since: Column | None = None,
) -> DataFrame:
    """Names, times and sizes of files; their content is not read."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], LISTING_SCHEMA)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    listing = reader.load(there).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size"),
    )
    return listing if touched_since is None else listing.filter(may_hold(F.col("modified_at"), touched_since))


def unread_files(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """Listed, non-empty files that gave no line: gone or unreadable by the time they were read."""
    seen = lines.select("file").distinct()
    return listing.filter(F.col("size") > 0).join(seen, "file", "left_anti")


def vanished_files(before: DataFrame, after: DataFrame, events: DataFrame) -> DataFrame:
    """Listed, non-empty files that were gone after reading and gave no event. Unlike :func:`unread_files`
    this needs no second pass over lines."""
    return unread_files(before, events).join(after.select("file"), "file", "left_anti")


def parse_lines(lines: DataFrame, event_type: str) -> DataFrame:
    """Each line with its ``event``; blank lines are neither events nor malformed.

    Only the fields of ``event_type`` are materialised, whatever else a line holds is skipped while
    scanning it, and it is scanned once: it is read as the first of two elements, and the second, whose type no
    line can know, is only found there when the line is one complete JSON value and nothing else.

    Adds ``blank``, ``malformed`` (not a JSON object) and ``ill_typed`` (an object, but some field
    of ``event_type`` is of another JSON type; that field is null).
    """
    last = uuid.uuid4().hex
    envelope = F.from_json(
        F.concat(F.lit('{"lines":['), F.col("line"), F.lit(f',{{"type":"{last}"}}]}}')),
        f"lines array<{event_type}>, bad string",
        {"columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false"},
    )
    # Inlined as an array of one: a filter on what was parsed stays above, and never parses again.
    parsed = lines.select("*", F.inline(F.array(envelope)))
    parsed = parsed.select(*lines.columns, "bad", F.size("lines").alias("n"), F.get("lines", F.lit(1))["type"].alias("last"), F.get("lines", F.lit(0)).alias("event"))
    blank = F.col("line").rlike(rf"^[{SPACES}]*$")
    whole = F.coalesce((F.col("n") == 2) & (F.col("last") == last), F.lit(False))
    is_object = whole & F.col("event").isNotNull()
    return parsed.select(
        *lines.columns,
        blank.alias("blank"),
        (~blank & ~is_object).alias("malformed"),
        (is_object & F.col("bad").isNotNull()).alias("ill_typed"),
        F.when(is_object, F.col("event")).alias("event"),
    )
