"""Thread tables: one row per thread, pointing at the rollout log of the thread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.sources.logs import plain_path, without_scheme

_ABSOLUTE = r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"


def select_threads(
    threads: DataFrame,
    *,
    include_archived: bool = True,
    created_since_ms: int | None = None,
    created_until_ms: int | None = None,
) -> DataFrame:
    """Threads, newest first. Older tables lack columns; a filter without its column does nothing."""
    if not include_archived and "archived" in threads.columns:
        threads = threads.filter(F.col("archived") == 0)
    if "created_at_ms" in threads.columns:
        created = F.col("created_at_ms")
        if created_since_ms is not None:
            threads = threads.filter(created >= created_since_ms)
        if created_until_ms is not None:
            threads = threads.filter(created < created_until_ms)
        threads = threads.orderBy(created.desc())
    return threads


def rollout_file(rollout_path: Column, home: str) -> Column:
    """Where a thread's log is: relative paths are below ``home``; null when the thread names none."""
    named = F.nullif(rollout_path, F.lit(""))
    below_home = F.concat(F.lit(home.rstrip("/") + "/"), named)
    return F.when(named.rlike(_ABSOLUTE), named).otherwise(below_home)


def normal_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts. A scheme and its authority stay as they are."""
    prefix = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?", 0)
    rest = F.substring(path, F.length(prefix) + 1, F.length(path))
    parts = F.filter(F.split(rest, "/"), lambda part: (part != "") & (part != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        none,
        lambda before, part: F.when(part == "..", F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0))))
        .otherwise(F.concat(before, F.array(part))),
    )
    return F.concat(prefix, F.lit("/"), F.array_join(kept, "/"))


def below(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path without ``..`` is inside one of these folders."""
    folders = [F.concat(normal_path(without_scheme(F.lit(root))), F.lit("/")) for root in roots]
    return F.greatest(F.lit(False), *[F.startswith(path, folder) for folder in folders])


def with_paths(threads: DataFrame, home: str) -> DataFrame:
    """Threads that name a log, with its ``path``."""
    path = normal_path(without_scheme(rollout_file(F.col("rollout_path"), home)))
    return threads.withColumn("path", path).filter(F.col("path").isNotNull())


def resolve_rollouts(threads: DataFrame, files: DataFrame, home: str) -> DataFrame:
    """Threads that name a log, with its ``path`` and whether it is among ``files``.

    Threads without a path are left out uncounted; threads whose file is absent stay, as skipped.
    Several threads may share one file. Either side grows with the logs, so they are merged: the size estimated for
    names is that of compressed files, far below what a broadcast would hold on the driver.
    """
    present = files.select(normal_path(plain_path(F.col("file"))).alias("path")).distinct()
    return (
        with_paths(threads, home)
        .join(present.withColumn("present", F.lit(True)).hint("merge"), "path", "left")
        .withColumn("present", F.coalesce("present", F.lit(False)))
    )
