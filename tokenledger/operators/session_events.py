"""Session logs: one billable event per assistant line with a usage block, one fact per token kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.fixed_values import FACT_COLUMNS, UNKNOWN_MODEL
from tokenledger.functions.counts import text_value, token_counts
from tokenledger.functions.models import model_key, session_mode
from tokenledger.functions.times import instant
from tokenledger.operators.ordering import carry_along
from tokenledger.sources.logs import SESSION_EVENT, parse_lines


# Names of the counts here, and where a usage block has them.
_COUNTS = {
    "input": "input_tokens",
    "cache_read": "cache_read_input_tokens",
    "cache_write": "cache_creation_input_tokens",
    "write_5m": "cache_creation.ephemeral_5m_input_tokens",
    "write_1h": "cache_creation.ephemeral_1h_input_tokens",
    "output": "output_tokens",
}


def billable(parsed: DataFrame) -> DataFrame:
    """Assistant events whose usage is an object; anything else is ignored, not malformed."""
    return parsed.filter(_is_billable())


def _is_billable() -> Column:
    assistant = F.col("event.type") == "assistant"
    return F.coalesce(assistant & F.col("event.message.usage").isNotNull(), F.lit(False))


def read_events(lines: DataFrame) -> DataFrame:
    """One narrow row per line that matters: with usage, with a session id, or unreadable.

    ``own_session`` the id on the line itself; ``billable`` whether it carries usage at a known time;
    ``malformed`` how often the line counts as malformed (0 or 1); token counts are null where the
    log holds something that is not a count.
    """
    parsed = parse_lines(lines, SESSION_EVENT).filter(~F.col("blank"))
    usage = "event.message.usage"
    events = parsed.select(
        "file",
        "block",
        "pos",
        F.nullif("event.sessionId", F.lit("")).alias("own_session"),
        F.when(_is_billable(), instant(F.col("event.timestamp"))).alias("occurred_at_utc"),
        F.coalesce(F.nullif("event.message.model", F.lit("")), F.lit(UNKNOWN_MODEL)).alias("model_raw"),
        text_value(F.col(f"{usage}.speed")).alias("speed"),
        F.col(f"{usage}.cache_creation").isNotNull().alias("has_ttl"),
        token_counts(*[F.col(f"{usage}.{field}") for field in _COUNTS.values()]).alias("counts"),
        _is_billable().alias("has_usage"),
        (F.col("malformed") | _unreadable_message()).alias("unreadable"),
    ).filter(F.col("has_usage") | F.col("own_session").isNotNull() | F.col("unreadable"))
    events = events.select(
        "*", *[F.col("counts")[i].alias(name) for i, name in enumerate(_COUNTS)]
    ).drop("counts")
    timed = F.col("has_usage") & F.col("occurred_at_utc").isNotNull()
    incomplete = timed & ~_readable_counts()[-1]
    broken = F.col("unreadable") | (F.col("has_usage") & ~timed) | incomplete
    return events.select(
        "*",
        session_mode(F.col("speed")).alias("mode"),
        timed.alias("billable"),
        broken.cast("int").alias("malformed"),
    ).drop("speed", "unreadable")


def _unreadable_message() -> Column:
    """An assistant line whose message is no object at all."""
    assistant = F.coalesce(F.col("event.type") == "assistant", F.lit(False))
    return assistant & F.col("event.message").isNull() & F.col("ill_typed")


def _readable_counts() -> tuple[Column, Column, Column, Column]:
    """Whether input, cache reads, cache writes and output can be taken. A count that cannot be read
    spoils itself and all later ones, earlier kinds stay."""
    ttl_readable = F.col("write_5m").isNotNull() & F.col("write_1h").isNotNull()
    first = F.col("input").isNotNull()
    second = first & F.col("cache_read").isNotNull()
    third = second & F.col("cache_write").isNotNull() & (~F.col("has_ttl") | ttl_readable)
    return first, second, third, third & F.col("output").isNotNull()


def fill_session_id(events: DataFrame) -> DataFrame:
    """Billable events with ``session_id``: the line's own, else the first one seen in the file so far,
    on a line of any type."""
    relevant = events.filter(F.col("has_usage") | F.col("own_session").isNotNull())
    filled = carry_along(
        relevant, ["file"], earliest={"first": F.col("own_session").isNotNull()}, carrying={"first": ["own_session"]}
    )
    return (
        filled.filter("billable")
        .withColumn("session_id", F.coalesce("own_session", "first.own_session"))
        .drop("own_session", "first", "has_usage", "billable", "malformed")
    )


def cache_writes(has_ttl: Column, total: Column, write_5m: Column, write_1h: Column) -> list[Column]:
    """5-minute, 1-hour and unknown cache writes: what a breakdown leaves over is unknown, without a
    breakdown all of it is."""
    rest = F.greatest(total - (write_5m + write_1h), F.lit(0))
    return [
        F.when(has_ttl, write_5m).otherwise(0),
        F.when(has_ttl, write_1h).otherwise(0),
        F.when(has_ttl, rest).otherwise(total),
    ]


def usage_facts(events: DataFrame) -> DataFrame:
    """One fact per event and kind with tokens; kinds after an unreadable count are not emitted."""
    reads_input, reads_cache, reads_writes, reads_output = _readable_counts()
    five, hour, unknown = cache_writes(
        F.col("has_ttl"), F.col("cache_write"), F.col("write_5m"), F.col("write_1h")
    )
    amounts = {
        "input_nocache": F.when(reads_input, F.col("input")),
        "cache_read": F.when(reads_cache, F.col("cache_read")),
        "cache_write_5m": F.when(reads_writes, five),
        "cache_write_1h": F.when(reads_writes, hour),
        "cache_write_unknown": F.when(reads_writes, unknown),
        "output": F.when(reads_output, F.col("output")),
    }
    long = events.select(
        "occurred_at_utc",
        "session_id",
        "model_raw",
        model_key(F.col("model_raw")).alias("model_key"),
        "mode",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("token_kind"), amount.cast("bigint").alias("tokens"))
                    for kind, amount in amounts.items()
                ]
            )
        ),
    )
    return (
        long.filter(F.col("tokens") > 0)
        .withColumns({"agent": F.lit("claude"), "source_quality": F.lit("ok")})
        .select(*FACT_COLUMNS)
    )


def session_facts(lines: DataFrame) -> DataFrame:
    return usage_facts(fill_session_id(read_events(lines)))
