"""Outputs of several parts that are there as a whole or not at all.

Parts are written to a staged folder beside the target. What lies there is then read back and counted into a manifest
(rows and a checksum of every part), the header is written last, and the folder gets its name. A job that dies on
the way leaves no folder of that name, only a staged one, which nothing reads. A file system that cannot rename at once
shows files one by one; there the manifest tells whether a part is complete.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "part string, rows bigint, checksum decimal(38,0)"
MANIFEST, HEADER = "manifest", "header"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    # No files, as of a part without rows, are no lines.
    return spark.read.schema("value string").text(folder)


def _measured(spark: SparkSession, name: str, folder: str) -> Row:
    """Rows of a written part, and the sum of the hashes of its lines, which does not depend on their order."""
    checksum = F.coalesce(F.sum(F.xxhash64("value").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    counted = _lines(spark, folder).agg(F.count(F.lit(1)).alias("rows"), checksum.alias("checksum")).first()
    return Row(part=name, rows=counted["rows"], checksum=counted["checksum"])


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, parts: dict[str, DataFrame], header: DataFrame) -> None:
    """``parts`` and ``header``, frames of the column ``value``, as folders of lines below ``path``, which must not be
    there yet."""
    target, files = _folder(spark, path)
    if files.exists(target):
        raise PySparkException(f"already there: {path}")
    staged_path = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    staged, _ = _folder(spark, staged_path)
    try:
        for name, lines in parts.items():
            lines.write.text(f"{staged_path}/{name}")
        found = [_measured(spark, name, f"{staged_path}/{name}") for name in parts]
        spark.createDataFrame(found, MANIFEST_SCHEMA).coalesce(1).write.json(f"{staged_path}/{MANIFEST}")
        header.write.text(f"{staged_path}/{HEADER}")
        if not files.rename(staged, target):
            raise PySparkException(f"cannot be named: {path}")
    finally:
        files.delete(staged, True)


def read_published(spark: SparkSession, path: str) -> tuple[str, dict[str, DataFrame]]:
    """The header and the parts as lines. Fails where one is missing or differs from the manifest."""
    for name in (HEADER, MANIFEST):
        folder, files = _folder(spark, f"{path}/{name}")
        if not files.exists(folder):
            raise PySparkException(f"no finished output at {path}: no {name}")
    manifest = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}").collect()
    for row in manifest:
        folder, files = _folder(spark, f"{path}/{row['part']}")
        if not files.exists(folder) or _measured(spark, row["part"], f"{path}/{row['part']}") != row:
            raise PySparkException(f"part {row['part']} of {path} is not what was written")
    header = _lines(spark, f"{path}/{HEADER}").first()["value"]
    return header, {row["part"]: _lines(spark, f"{path}/{row['part']}") for row in manifest}
