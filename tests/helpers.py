"""Small inputs for tests."""

import json

from pyspark.sql import functions as F

from tokenledger.sources import catalog as catalogs

FACT_SCHEMA = (
    "occurred_at_utc timestamp, agent string, session_id string, model_raw string, model_key string, "
    "token_kind string, tokens bigint, mode string, source_quality string"
)


def facts(spark, *rows):
    """Facts from (time, agent, session, model key, kind, tokens, mode)."""
    frame = spark.createDataFrame(
        [(t, a, s, m, m, k, n, mode, "ok") for t, a, s, m, k, n, mode in rows],
        FACT_SCHEMA.replace("occurred_at_utc timestamp", "at string"),
    )
    return frame.withColumn("occurred_at_utc", F.col("at").cast("timestamp")).drop("at")


def period(rate_id, start, end=None, **prices):
    return {"rate_id": rate_id, "effective_from": start, "effective_until": end, **prices}


def document(*models, **header):
    base = {
        "schema_version": "1",
        "catalog_version": "v-test",
        "currency": "USD",
        "unit": "per_mtok",
        "usd_per_credit": "0.04",
    }
    return json.dumps({**base, **header, "models": list(models)})


def catalog(spark, *models, **header):
    text = F.lit(document(*models, **header))
    docs = spark.range(1).select(
        F.lit("t").alias("catalog_id"), text.alias("document"), F.lit("sha").alias("sha256")
    )
    return catalogs.catalog_from_documents(docs)


def lines(spark, files, block_size=3):
    """A line frame from {file: [line, ...]}, cut into blocks of a few lines."""
    rows = [
        (name, i // block_size, i, line) for name, content in files.items() for i, line in enumerate(content)
    ]
    return spark.createDataFrame(rows, "file string, block bigint, pos bigint, line string").repartition(4)


def rows(frame, *columns):
    return sorted(
        (tuple(r[c] for c in columns) for r in frame.select(*columns).collect()),
        key=lambda r: tuple((v is not None, v) for v in r),
    )
