"""Display text of report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def _fixed(value: Column, digits: int) -> Column:
    # Rounding the decimal first pins ties; a decimal prints all its digits.
    return F.round(value.cast("decimal(38,17)"), digits).cast(f"decimal(38,{digits})").cast("string")


def cost_cell(value: Column) -> Column:
    return F.coalesce(_fixed(value, 4), F.lit("-"))


def credits_cell(value: Column) -> Column:
    return F.when(value != 0, _fixed(value, 2)).otherwise("-")
