"""Files that are named one by one: which of them are there, and their lines.

A *manifest* has one row per named file that is there: ``path`` as it was named, ``file`` as a line frame names it,
``modified_at`` and ``size``. Files are looked up by name, so neither the folders nor their other files are listed or
read. One manifest serves the lookup of threads, pruning by time, reading and counting. Names go through the driver in
batches of bounded size, as both lookup and scans are planned there; lines never do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import partial
from itertools import batched

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tokenledger.session import shared_dir
from tokenledger.sources.logs import LINE_SCHEMA, lines_of_files, may_hold, plain_path

MANIFEST_SCHEMA = "path string, file string, modified_at timestamp, size bigint"
# Names that are looked up, or files that are read, by one job.
BATCH_FILES = 10_000
# Lookups under way at a time. Each waits for the file system, not for the driver's processor.
LOOKUPS = 32


def _status(spark: SparkSession, path: str) -> tuple | None:
    """The manifest row of a file; null for folders, what is not there, and names that Spark never reads."""
    context = spark.sparkContext
    named = context._jvm.org.apache.hadoop.fs.Path(path)
    if named.getName().startswith(("_", ".")):
        return None
    try:
        status = named.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(named)
    except Py4JJavaError as error:
        # A name below a file is no folder to the file system.
        if error.java_exception.getClass().getSimpleName() in ("FileNotFoundException", "ParentNotDirectoryException"):
            return None
        raise
    if not status.isFile():
        return None
    modified = datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc)
    # Scans name local files with one slash.
    file = re.sub("^file:/+", "file:/", status.getPath().toUri().toString())
    return path, file, modified, status.getLen()


def _appended(parts: Iterator[DataFrame], empty: DataFrame) -> DataFrame:
    """Frames written one after another to one table of the shared folder."""
    path = shared_dir(empty.sparkSession)
    empty.write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return empty.sparkSession.read.schema(empty.schema).parquet(path)


def _batches(rows: DataFrame) -> Iterator[tuple[Row, ...]]:
    yield from batched(rows.toLocalIterator(), BATCH_FILES)


def named_files(paths: DataFrame) -> DataFrame:
    """The manifest of the distinct, non-null ``path`` values."""
    spark = paths.sparkSession
    names = paths.select("path").filter(F.col("path").isNotNull()).distinct()

    def parts() -> Iterator[DataFrame]:
        with ThreadPoolExecutor(LOOKUPS) as pool:
            for batch in _batches(names):
                found = list(filter(None, pool.map(partial(_status, spark), [row["path"] for row in batch])))
                if found:
                    yield spark.createDataFrame(found, MANIFEST_SCHEMA)

    return _appended(parts(), spark.createDataFrame([], MANIFEST_SCHEMA))


def of_listing(listing: DataFrame) -> DataFrame:
    """The manifest of files that were listed."""
    return listing.select(plain_path(F.col("file")).alias("path"), "file", "modified_at", "size")


def touched(manifest: DataFrame, since: Column | None) -> DataFrame:
    """Files that may hold events from ``since`` on."""
    return manifest if since is None else manifest.filter(may_hold(F.col("modified_at"), since))


def _lines_there(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of those files that are still there when the scan is planned, which fails on names it cannot find."""
    while paths:
        try:
            return lines_of_files(spark, paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            paths = [path for path in paths if _status(spark, path)]
    return spark.createDataFrame([], LINE_SCHEMA)


def line_batches(manifest: DataFrame) -> Iterator[DataFrame]:
    """Line frames of the files, so many at a time that a plan stays small. Large files are read in blocks by several
    tasks. A file that is removed in the meantime is left out."""
    for batch in _batches(manifest.select("path")):
        yield _lines_there(manifest.sparkSession, [row["path"] for row in batch])


def read_named(manifest: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``parse`` of the lines of all files, written to the shared folder."""
    empty = manifest.sparkSession.createDataFrame([], LINE_SCHEMA)
    return _appended(map(parse, line_batches(manifest)), parse(empty))


def gone(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Non-empty files that gave no event, and that are no longer there: only those are looked up again."""
    silent = manifest.filter(F.col("size") > 0).join(events.select("file").distinct(), "file", "left_anti")
    return silent.join(named_files(silent).select("path"), "path", "left_anti")
