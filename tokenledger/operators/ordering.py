"""State carried along the lines of a file, without ever needing a whole file in one task.

A file may hold a third of all lines, so no window here is partitioned by file alone. Rows are
partitioned by (file, block), each block is worked through in order, and what has to cross a block
boundary is carried by a second frame with one row per block. A file's lines may be as many blocks, so
that frame is as large as the rows may be, whatever size is estimated for it: it is merged, never broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(rows: DataFrame, placed: list[str]) -> Column:
    return F.struct(*[c for c in rows.columns if c not in placed]).alias("row")


def _unpacked(name: str, placed: list[str]) -> Column:
    return F.col(name) if name in placed else F.col(f"row.{name}").alias(name)


def carry_along(
    rows: DataFrame,
    keys: list[str],
    *,
    latest: dict[str, Column] | None = None,
    earliest: dict[str, Column] | None = None,
    attach: DataFrame | None = None,
    carrying: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add, for every row, another row strictly before it within ``keys``, by (block, pos).

    ``latest`` and ``earliest`` map a new column to a condition: it becomes the last (first) earlier row
    that meets it, as a struct, or null. ``carrying`` names the columns these structs have, all if it does not name the
    new column: what is not carried is not kept in windows and sums either. Rows without a key or block drop out. ``attach`` is a frame to inner-join on ``keys``; it meets the
    frame of blocks, not the rows.
    """
    latest, earliest, carrying = latest or {}, earliest or {}, carrying or {}
    parts = [*keys, "block"]
    marks = {f"_is_{name}": condition for name, condition in {**latest, **earliest}.items()}
    # Whole rows are shuffled once and read by both branches below: packed in a struct, neither branch
    # can drop columns the other needs, and with nulls filtered here the join below adds no filter to
    # one of them, so Spark sees that they want the same shuffle. Keys and places are beside the struct, not in it
    # as well: sorts and windows hold every byte of a row.
    complete = reduce(and_, [F.col(part).isNotNull() for part in parts])
    marked = rows.filter(complete).withColumns(marks)
    placed = [*parts, "pos"]
    shared = marked.select(*placed, _packed(marked, placed)).repartition(*parts)

    def met(name: str, value: Column) -> Column:
        return F.when(F.col(f"row._is_{name}"), value)

    def value(name: str) -> Column:
        return F.struct(*[_unpacked(c, placed) for c in carrying.get(name, rows.columns)])

    before = Window.partitionBy(*parts).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = shared.select(
        *placed,
        "row",
        *[F.last(met(name, value(name)), True).over(before).alias(f"_in_{name}") for name in latest],
        *[F.first(met(name, value(name)), True).over(before).alias(f"_in_{name}") for name in earliest],
    )
    blocks = shared.groupBy(*parts).agg(
        *[F.max_by(value(name), met(name, F.col("pos"))).alias(name) for name in latest],
        *[F.min_by(value(name), met(name, F.col("pos"))).alias(name) for name in earliest],
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *parts,
        *[F.last(name, True).over(earlier).alias(f"_before_{name}") for name in latest],
        *[F.first(name, True).over(earlier).alias(f"_before_{name}") for name in earliest],
    )
    if attach is not None:
        carried = carried.join(attach.hint("merge"), keys)
    attached = [c for c in attach.columns if c not in keys] if attach is not None else []
    return inside.join(carried.hint("merge"), parts).select(
        *[_unpacked(c, placed) for c in rows.columns],
        *attached,
        *[F.coalesce(f"_in_{name}", f"_before_{name}").alias(name) for name in latest],
        *[F.coalesce(f"_before_{name}", f"_in_{name}").alias(name) for name in earliest],
    )


def running_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add running sums of expressions up to and including each row within ``keys``."""
    parts = [*keys, "block"]
    # Packed in a struct, so that both branches want the same shuffle, as in carry_along.
    packed = rows.withColumns({f"_{name}": value for name, value in totals.items()})
    placed = [*parts, "pos"]
    shared = packed.select(*placed, _packed(packed, placed)).repartition(*parts)
    upto = Window.partitionBy(*parts).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = shared.select(
        *placed, "row", *[F.sum(f"row._{name}").over(upto).alias(f"_in_{name}") for name in totals]
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shared.groupBy(*parts).agg(*[F.sum(f"row._{name}").alias(name) for name in totals])
    carried = blocks.select(
        *parts, *[F.sum(name).over(earlier).alias(f"_before_{name}") for name in totals]
    )
    return inside.join(carried.hint("merge"), parts).select(
        *[_unpacked(c, placed) for c in rows.columns],
        *[
            (F.col(f"_in_{name}") + F.coalesce(f"_before_{name}", F.lit(0))).alias(name)
            for name in totals
        ],
    )
