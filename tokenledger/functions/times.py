"""Instants, window bounds and month buckets. All assume a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full dates and datetimes only; Spark alone would also take "2026" or "2026-06".
_HAS_DATE = r"^\d{4}-\d{2}-\d{2}"
_ISO = (
    _HAS_DATE
    + r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
)
_HAS_OFFSET = r"[T ][\d:.]+(Z|[+-][\d:]+)$"
# Times without seconds or minutes and with an offset, which the cast does not take.
_NO_SECONDS = r"([T ]\d{2}:\d{2})(Z|[+-].*)$"
_NO_MINUTES = r"([T ]\d{2})(Z|[+-].*)$"


def instant(text: Column) -> Column:
    """ISO-8601 text as an instant; without an offset it is UTC; null when it is not a time."""
    padded = F.regexp_replace(
        F.regexp_replace(text, _NO_SECONDS, "$1:00$2"), _NO_MINUTES, "$1:00:00$2"
    )
    parsed = F.coalesce(text.try_cast("timestamp"), padded.try_cast("timestamp"))
    return F.when(text.rlike(_ISO), parsed)


def window_bound(text: Column, zone: str) -> Column:
    """A window bound as an instant: dates and offset-free times are local to ``zone``.

    Null for missing, empty and unreadable text; see :func:`bad_window_bound`.
    """
    moment = instant(text)
    return F.when(text.rlike(_HAS_OFFSET), moment).otherwise(F.to_utc_timestamp(moment, zone))


def bad_window_bound(text: Column, zone: str) -> Column:
    return F.coalesce(text != "", F.lit(False)) & window_bound(text, zone).isNull()


def required_window_bound(value: str | None, zone: str) -> Column | None:
    """A caller's bound as a constant column; unreadable text fails the query that uses it."""
    if not value:
        return None
    text = F.lit(value)
    return F.when(
        bad_window_bound(text, zone),
        F.raise_error(F.lit(f"invalid date/time: {value!r}")).cast("timestamp"),
    ).otherwise(window_bound(text, zone))


def month_start(moment: Column, zone: str = "UTC") -> Column:
    """First day of the local month, as a date: cheap to group by, formatted after grouping."""
    local = moment if zone == "UTC" else F.from_utc_timestamp(moment, zone)
    return F.trunc(local.cast("date"), "month")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def iso_utc(moment: Column) -> Column:
    """``2026-06-01T00:00:00+00:00``, with a six-digit fraction only when there is one."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(moment, ".SSSSSS")
    return F.concat(
        whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00")
    )
