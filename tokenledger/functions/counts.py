"""Token counts and texts taken from loosely typed JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON forms that count as "nothing there".
_EMPTY = ("null", '""', "false", "[]", "{}")


def token_count(value: Column) -> Column:
    """A JSON value as a whole number, or null when it is not one.

    Missing and empty values are 0, numeric text is read, fractions lose their fraction part.
    """
    empty = value.isNull() | F.to_json(value).isin(*_EMPTY)
    return F.coalesce(
        F.try_variant_get(value, "$", "bigint"), F.when(empty, F.lit(0).cast("bigint"))
    )


def token_counts(*values: Column) -> Column:
    """:func:`token_count` of several JSON values, as an array in their order.

    As a transformed array the conversions stay out of the generated method of the surrounding
    projection, which would otherwise outgrow what the JVM compiles to machine code.
    """
    return F.transform(F.array(*values), token_count)


def text_value(value: Column) -> Column:
    """A JSON value as text; null for missing, empty, false and zero."""
    text = F.try_variant_get(value, "$", "string")
    # Only texts that also a value of another type can have are looked at twice.
    suspect = text.isin("", "false", "[]", "{}", "0", "0.0")
    stays = ~F.to_json(value).isin(*_EMPTY, "0", "0.0")
    return F.when(~suspect, text).when(stays, text)
