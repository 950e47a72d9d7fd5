"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import (
    chat,
    clustering,
    decontamination,
    language,
    lexical,
    licenses,
    neardup,
    packing,
    quality,
    secrets,
    sharding,
    toxicity,
    urls,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_frame(spark, urls.default_rules())
    judged = urls.judged(table(spark, sf_dir, "pages"), rules)
    # Only the stated rules are named; the others are the method's own.
    stated = [f"{host}{path}" for _, host, path in urls.PREFIX_RULES]
    rule = F.when(F.col("rule").isin(stated), F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fitted(docs.filter(~held_out))
    predicted = language.predicted(docs, model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"), percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digests(found)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scanned(docs, secrets.fitted(docs)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(clustering.fitted(table(spark, sf_dir, "embeddings")))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts look like marks.
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)"
    )
    return chat.digests(chat.formatted(turns.union(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_rules,
        op2_url_filters,
        op3_language_id,
        op4_neardup,
        op5_toxicity,
        op6_packing,
        op7_decontamination,
        op8_secret_scans,
        op9_sharding,
        op10_license_scans,
        op11_lexical_search,
        op12_centroid_clustering,
        op13_chat_formatting,
    )
}
