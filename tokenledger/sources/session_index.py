"""Which session logs may hold which sessions: a Bloom filter of session ids per log file, kept beside the logs.

A digest of a few sessions need not read all logs. The index has, for each file of a listing, the session ids of its
lines as bitmaps: ids are dealt to segments by a hash, and each sets HASHES of the 32,768 bits of its segment, so an
id that is there is always found, and one that is not is taken to be there about twice in a thousand. An entry holds
for a file of one size and time; a file that has changed since has no entry, and is read. So an index may be old, or
miss files: digests stay the same, only more is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.operators.joins import lookup
from tokenledger.operators.session_events import read_events
from tokenledger.session import written
from tokenledger.sources import logs, manifest

INDEX_SCHEMA = "file string, modified_at timestamp, size bigint, segments int, segment int, bits binary"
# Bits of a bitmap of Spark's bitmap functions, ids that share one, and bits per id.
BITS = 32_768
SEGMENT_IDS = 2_000
HASHES = 4
# Of more requested sessions, nearly every file would be read anyway.
MOST_REQUESTED = 1_000

_VERSION = ["file", "modified_at", "size"]


def _hashes(session_id: str) -> list[Column]:
    """The hash that deals an id to a segment, and the bits it sets there."""
    salted = [F.xxhash64(F.col(session_id), F.lit(salt)) for salt in range(HASHES + 1)]
    return [salted[0], *[F.pmod(value, F.lit(BITS)) for value in salted[1:]]]


def entries(listing: DataFrame, ids: DataFrame) -> DataFrame:
    """Index rows of the listed files from their distinct (``file``, ``session_id``). A file without ids has one."""
    counts = ids.groupBy(F.col("file").alias("id_file")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.select("id_file", F.ceil(F.col("n") / SEGMENT_IDS).cast("int").alias("segments")))
    dealt, *bits = _hashes("session_id")
    # A set of a file's bits is added up before it is shuffled, so a file with most of all ids is no hot key.
    placed = lookup(ids, counts, {"file": "id_file"}).select(
        "file",
        "segments",
        F.pmod(dealt, F.col("segments").cast("bigint")).cast("int").alias("segment"),
        F.explode(F.array(*bits)).alias("bit"),
    )
    maps = placed.groupBy("file", "segments", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filled = listing.select(*_VERSION).join(maps, "file", "left")
    return filled.select(
        *_VERSION, F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("segment", F.lit(0)).alias("segment"), "bits"
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries written so far; none where there is no index yet."""
    if not logs.existing(spark, [path]):
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def update_index(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Adds entries of new and changed logs below ``root`` to the index at ``path``, and returns those files. Others
    are not read again."""
    listing = logs.file_listing(spark, [logs.session_glob(root)])
    known = read_index(spark, path).select(*_VERSION).distinct()
    fresh = written(manifest.of_listing(listing.join(known, _VERSION, "left_anti")))
    ids = manifest.read_named(fresh, _ids)
    entries(fresh, ids).write.mode("append").parquet(path)
    return fresh


def _ids(lines: DataFrame) -> DataFrame:
    ids = read_events(lines).select("file", F.col("own_session").alias("session_id"))
    return ids.filter(F.col("session_id").isNotNull()).distinct()


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, position % 8) == 1


def may_hold(listing: DataFrame, index: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Listed files that may hold one of the sessions, files without an entry of their size and time among them."""
    wanted = session_ids.select(F.col("session_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
    found = wanted.select(F.array(*_hashes("id")).alias("hashes")).limit(MOST_REQUESTED + 1).collect()
    if len(found) > MOST_REQUESTED:
        return listing
    requested = F.array(*[F.lit(list(row["hashes"])) for row in found]).cast("array<array<bigint>>")
    known = index.join(listing.select(*_VERSION), _VERSION)

    def holds(bits: Column) -> Column:
        def one(hashes: Column) -> Column:
            # Files without ids have no segment.
            there = F.pmod(hashes[0], F.nullif(F.col("segments").cast("bigint"), F.lit(0))) == F.col("segment")
            for i in range(HASHES):
                there &= _is_set(bits, hashes[i + 1])
            return there

        return F.exists(requested, one)

    # Inside the outer function the bitmap is a variable, read for each requested id without being copied.
    held = F.exists(F.array("bits"), holds)
    none = known.groupBy(*_VERSION).agg(F.max(F.coalesce(held, F.lit(False))).alias("held")).filter(~F.col("held"))
    return listing.join(none.select(*_VERSION), _VERSION, "left_anti")
