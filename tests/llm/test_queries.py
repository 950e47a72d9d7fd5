"""Every query of the operators on the smallest tables, and the pipeline stage by stage."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from tests import check
from tests.llm import corpora
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_neardup import brute as components
from tests.llm.test_packing import check as check_bins
from tests.llm.test_quality import brute as counts
from tokenledger.llm import secrets
from tokenledger.llm.oracle import ORACLES
from tokenledger.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")

CONTRACT = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_url_filters": "page_id host path rule verdict",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_neardup": "doc_id n_shingles component_id kept",
    "op7_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


# The other queries answer for documents.
TABLES = {
    "op2_url_filters": ("pages", "page_id"),
    "op11_lexical_search": ("benchmark", "item_id"),
    "op12_centroid_clustering": ("embeddings", "vec_id"),
    "op13_chat_formatting": ("conversations", "conv_id"),
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_answer(spark, name):
    assert check.compare(spark, check.duck(SF_DIR), SF_DIR, name) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, name):
    got = driver.queries()[name](spark, SF_DIR)
    if name in CONTRACT:
        assert got.columns == CONTRACT[name].split()
    source, key = TABLES.get(name, ("documents", "doc_id"))
    whole = spark.read.parquet(f"{SF_DIR}/{source}.parquet")
    missing = whole.select(key).distinct().join(got.select(key).distinct(), key, "left_anti")
    assert missing.count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == [
        "quality rules",
        "MinHash near-dedup",
        "benchmark decontamination",
        "secret scans",
        "best-fit packing",
    ]

    def texts(frame):
        return {r["doc_id"]: r["text"] for r in frame.collect()}

    first = by_name["quality rules"](spark, docs, SF_DIR)
    assert first.columns == docs.columns
    measured = {i: counts(r["text"]) for i, r in rows.items()}
    passing = {i for i, m in measured.items() if m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"]}
    assert set(texts(first)) == passing

    second = by_name["MinHash near-dedup"](spark, first, SF_DIR)
    groups = components([(i, rows[i]["text"]) for i in passing], 80)
    assert second.columns == docs.columns
    assert set(texts(second)) == {i for i, least in groups.items() if i == least}

    third = by_name["benchmark decontamination"](spark, second, SF_DIR)
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert third.columns == docs.columns
    assert set(texts(third)) == {i for i, text in texts(second).items() if not contaminated(text, items)[-1]}

    fourth = by_name["secret scans"](spark, third, SF_DIR)
    before, after = texts(third), texts(fourth)
    assert fourth.columns == docs.columns and set(before) == set(after)
    assert all(not secrets.base_spans(text) for text in after.values())
    assert all(after[i] == text for i, text in before.items() if secrets.MASK not in after[i])

    last = by_name["best-fit packing"](spark, fourth, SF_DIR)
    check_bins(corpora.collected(last), [(i, text, rows[i]["source"]) for i, text in after.items()], 2048)

    whole = driver.queries()["pipeline"](spark, SF_DIR)
    assert whole.count() == last.count()


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    items = spark.createDataFrame([(1, "line line"), (None, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (corpora.awkward(spark), corpora.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            if name != "best-fit packing":
                assert docs.columns == before.columns
            docs.write.parquet(path := f"{tmp_path}/{name}-{before.count()}-{before.rdd.id()}")
            docs = spark.read.parquet(path)
