"""Joins of rows to the periods that cover an instant, by equality on cells of time.

A key may have very many periods. Joined on the key alone, every row would meet all of them. Here each key's time is
cut into cells as wide as its periods are on average, so its periods have at most three cells each, whatever they are;
a cell that many periods share is cut once more in the same way, by what these periods fill of it. Rows then meet,
by equality on key and cells, the few periods of one cell, and the bounds decide among those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.joins import fits_broadcast, lookup
from tokenledger.session import written

# Periods that rows may meet by equality alone before cells are cut, or cut again.
CROWDED = 8


def covers(moment: Column, start: Column, end: Column) -> Column:
    """Whether ``start <= moment < end``; no end is open."""
    return (moment >= start) & (end.isNull() | (moment < end))


def _grid(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Per key where its cells begin (``low``), how wide they are and which one is the last. Of ``periods`` in
    microseconds with ``first`` and ``last``, null where open."""
    ends = periods.groupBy(*keys).agg(
        F.min("first").alias("low"),
        F.max(F.coalesce("last", "first")).alias("high"),
        F.sum(F.col("first").cast("double")).alias("firsts"),
        F.sum(F.col("last").cast("double")).alias("lasts"),
        F.count_if(F.col("last").isNull()).alias("n_open"),
        F.count(F.lit(1)).alias("n"),
    )
    total = F.coalesce("lasts", F.lit(0.0)) + F.col("n_open") * F.col("high") - F.col("firsts")
    width = F.greatest(F.ceil(total / F.col("n")).cast("long"), F.lit(1).cast("long"))
    wide = ends.select(*keys, "low", "high", width.alias("width"))
    return wide.select(*keys, "low", "width", F.expr("(high - low) div width + 1").alias("top"))


def _cell(micros: Column) -> Column:
    """The cell of a time: -1 before the first, the last for all times from its beginning on."""
    low, width, top = F.col("low"), F.col("width"), F.col("top")
    return F.when(micros < low, F.lit(-1).cast("long")).otherwise(F.least(F.call_function("div", micros - low, width), top))


def _in_cells(periods: DataFrame, grid: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """``periods`` once per cell they reach into."""
    last = F.when(F.col("last").isNull(), F.col("top")).otherwise(_cell(F.col("last") - 1))
    joined = periods.join(grid, keys)
    return joined.withColumn(cell, F.explode(F.sequence(_cell(F.col("first")), last)))


def _clipped() -> dict[str, Column]:
    """A period's part inside its cell. The last cell has no end."""
    begin = F.col("low") + F.col("cell") * F.col("width")
    end = F.when(F.col("cell") < F.col("top"), begin + F.col("width"))
    last = F.when(F.col("last").isNull() | end.isNull(), F.coalesce("last", end)).otherwise(F.least("last", end))
    return {"first": F.greatest("first", begin), "last": last}


def cover_join(
    big: DataFrame,
    periods: DataFrame,
    on: dict[str, str],
    moment: str,
    start: str,
    end: str,
) -> DataFrame:
    """Left join of ``big`` to the ``periods`` whose key equals and that cover ``moment``.

    The result is that of :func:`lookup` with :func:`covers` as its condition: a row without a period stays, one with
    several comes once for each. Periods without a start or that end before they begin cover nothing. Column names
    of both sides have to differ. Nothing is salted: the cells spread a hot key, and rows of one hot cell are
    split by adaptive execution, which copies the few periods of that cell.
    """
    keys = [f"_key_{i}" for i in range(len(on))]
    payload = F.struct(*periods.columns).alias("period")
    usable = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end)))
    for name in on.values():
        usable &= F.col(name).isNotNull()
    bare = written(
        periods.filter(usable).select(
            *[F.col(name).alias(key) for key, name in zip(keys, on.values(), strict=True)],
            F.unix_micros(start).alias("first"),
            F.unix_micros(end).alias("last"),
            payload,
        )
    )
    grid = written(_grid(bare, keys))
    coarse = written(_in_cells(bare, grid, keys, "cell").withColumns(_clipped()).drop("low", "width", "top"))
    crowded = coarse.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).drop("n")
    crowded = written(crowded)
    again = coarse.join(crowded, [*keys, "cell"])
    fine_grid = written(_grid(again, [*keys, "cell"]))
    fine = _in_cells(again, fine_grid, [*keys, "cell"], "part").select(*keys, "cell", "part", "period")
    plain = coarse.join(crowded, [*keys, "cell"], "left_anti").select(*keys, "cell", F.lit(0).cast("long").alias("part"), "period")
    index = written(plain.unionByName(fine))

    # ``big`` travels as one column, so that its columns meet no others.
    names = dict(zip(on.values(), keys, strict=True))
    rows = big.select(
        F.struct(*big.columns).alias("row"),
        *[F.col(left).alias(f"_row{names[right]}") for left, right in on.items()],
        F.unix_micros(moment).alias("micros"),
    )
    pairs = {f"_row{key}": key for key in keys}
    placed = lookup(rows, grid, pairs)
    placed = placed.select("row", *pairs, "micros", _cell(F.col("micros")).alias("at_cell"))
    by_cell = {**pairs, "at_cell": "cell"}
    placed = lookup(placed, fine_grid, by_cell)
    part = F.coalesce(_cell(F.col("micros")), F.lit(0))
    placed = placed.select("row", *pairs, "at_cell", part.alias("at_part"))
    by_part = {**by_cell, "at_part": "part"}
    match = covers(F.col(f"row.{moment}"), F.col(f"period.{start}"), F.col(f"period.{end}"))
    for left, right in by_part.items():
        match &= F.col(left) == F.col(right)
    small = F.broadcast(index) if fits_broadcast(index) else index
    return placed.join(small, match, "left").select("row.*", "period.*")
