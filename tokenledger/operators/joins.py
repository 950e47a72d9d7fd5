"""Joins of facts to smaller frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast frame stays below this many rows and bytes on every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Copies of the smaller side, and parts of a hot key, when it is too large for that.
SALTS = 16


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a frame is measured to be small. Reads at most one row beyond the bound."""
    width = F.sum(F.length(F.to_json(F.struct(*small.columns)))).alias("bytes")
    size = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), width).first()
    return size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: dict[str, str],
    *,
    how: str = "left",
    condition: Column | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` where ``big[k] == small[v]`` and ``condition`` holds.

    A small side that is measured small goes to every executor. A larger one is shuffled, with the
    rows of ``big`` spread over salted keys so that one hot key is not one task. Exact copies of a row
    share a salt; a partition they fill is split by adaptive execution (``skewJoin``), which needs no
    keys for that. Column names of both sides have to differ.
    """
    if broadcast is None:
        broadcast = fits_broadcast(small)
    pairs = dict(on)
    if broadcast:
        small = F.broadcast(small)
    else:
        # A hash of the row, not a random number: a recomputed task gives the same salts.
        salt = F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")
        big = big.withColumn("_salt", salt)
        small = small.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs["_salt"] = "_salt_of"
    match = condition
    for left, right in pairs.items():
        equal = F.col(left) == F.col(right)
        match = equal if match is None else match & equal
    joined = big.join(small, match, how)
    return joined.drop("_salt", "_salt_of")
