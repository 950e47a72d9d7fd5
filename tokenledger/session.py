"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tokenledger", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes. Cluster sizing stays with the caller."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Generated methods beyond this size stay interpreted in the JVM; operators then run one by one.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call sites of every single column expression triple the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to executors, which import it, unless they find it on the driver's ``PYTHONPATH``, as they do
    on one machine. Not needed where it is installed on all of them."""
    root, application = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if application in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(application)
    # Spark takes it from here and serves it to the executors.
    archive = Path(tempfile.mkdtemp(prefix="tokenledger-")) / "tokenledger.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for module in sorted((root / "tokenledger").rglob("*.py")):
            packed.write(module, module.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def use_utc(spark: SparkSession) -> None:
    """Instants are formatted and bucketed in the session zone, so it has to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's written intermediates, below what all executors share.

    ``spark.checkpoint.dir`` names the shared folder. Where it is unset, as in tests, the warehouse folder of the session
    serves, but on a cluster only one that is no folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        on_one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not on_one_machine and re.match(r"file:|/", base):
            raise PySparkException("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{base.rstrip('/')}/tokenledger/{spark.sparkContext.applicationId}"


_REMOVED_AT_EXIT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new, not yet existing folder in the run folder of this application."""
    base = run_dir(spark)
    if base not in _REMOVED_AT_EXIT:
        _REMOVED_AT_EXIT.add(base)
        atexit.register(_remove, spark, base)
    return f"{base}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop
    conf = context._jsc.hadoopConfiguration() if context._jsc else hadoop.conf.Configuration()
    folder = hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def remove_written(spark: SparkSession) -> None:
    """Delete the run folder. For callers whose outputs are written; frames that read from it end here."""
    _remove(spark, run_dir(spark))


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts lineage, survives executors.

    For frames that several branches read and that are costly to derive again, such as parsed logs.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
