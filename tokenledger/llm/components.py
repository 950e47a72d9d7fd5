"""Connected components of links between documents, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.session import written


def _state(links: DataFrame) -> tuple[int, int]:
    found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return found[0], found[1]


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")


def _large_star(links: DataFrame) -> DataFrame:
    """Greater neighbours of a node move to the least of its neighbours and itself."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    joined = both.join(least, F.col("a") == F.col("node")).filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of these."""
    joined = links.join(_least(links), F.col("a") == F.col("node"))
    moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its least node.

    ``links`` has columns a and b. Each round is written, so lineage stays short; the number of rounds grows
    with the logarithm of the longest chain. Nothing but two numbers a round reaches the driver.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(ordered.filter(F.col("a") != F.col("b")).distinct())
    state = _state(now)
    while True:
        now = written(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionAll(roots)
