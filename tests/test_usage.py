"""Whole jobs over files: logs and threads in, reports and documents out."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.helpers import catalog, period, rows
from tests.test_logs import assistant, started, total

from tokenledger.fixed_values import FACT_COLUMNS, REPORT_COLUMNS
from tokenledger.operators import pricing, quality
from tokenledger.plans import usage
from tokenledger.session import remove_written, run_dir
from tokenledger.sinks import export, report_files
from tokenledger.sources.catalog import Catalog

PRICES = period("x-1", "2026-01-01", None, input_nocache="5.0", cache_read="0.5", cache_write_5m="6.25", output="30.0")
MODELS = (
    {"model_key": "x", "aliases": [], "rates": [PRICES]},
    {"model_key": "gpt-y", "aliases": [], "credits_per_mtok": {"output": "750"}, "rates": [{**PRICES, "rate_id": "g"}]},
)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    (root / "projects" / "p").mkdir(parents=True)
    (root / "sessions").mkdir()
    june, july = "2026-06-30T23:30:00Z", "2026-07-01T00:30:00Z"
    (root / "projects" / "p" / "s.jsonl").write_text(
        "\n".join(
            [
                assistant(june, {"input_tokens": 1000, "output_tokens": 10}, "x[1m]", "sess-1"),
                assistant(july, {"cache_creation_input_tokens": 500}, "x", "sess-1"),
                assistant(july, {"output_tokens": 7}, "unheard-of", None),
                "{broken",
            ]
        )
    )
    (root / "sessions" / "r.jsonl").write_text(
        "\n".join([total(june), started("default"), total(june, 100, 20, 50), total(july, 90, 30, 80)])
    )
    (root / "sessions" / "old.jsonl").write_text(total(june, 7, 0, 0))
    table = [
        ("th-1", "gpt-y", "sessions/r.jsonl", 0, 1, 400),
        ("th-2", None, str(root / "sessions" / "old.jsonl"), 1, 2, 0),
        ("th-3", "gpt-y", "sessions/gone.jsonl", 0, 3, 0),
    ]
    threads = spark.createDataFrame(
        table, "id string, model string, rollout_path string, archived int, created_at_ms bigint, tokens_used bigint"
    )
    return usage.Sources(
        session_root=str(root / "projects"),
        threads=threads,
        rollout_home=str(root),
        rollout_roots=[str(root / "sessions")],
    )


@pytest.fixture(scope="module")
def prices(spark):
    return catalog(spark, *MODELS)


def test_report(spark, sources, prices):
    shown, counters = usage.usage_report(spark, sources, prices, group_by=["agent", "model"], include_archived=False)
    assert rows(shown, "agent", "model", "tokens", "unpriced_tokens", "pricing_status") == [
        ("claude", "unheard-of", 7, 7, "unpriced"),
        ("claude", "x", 1510, 0, "lower_bound"),
        ("codex", "gpt-y", 180, 0, "priced"),
    ]
    assert counters.first().asDict() == {
        "malformed_events": 1, "skipped_files": 1, "negative_deltas": 1, "unpriced_tokens": 7,
    }


def test_window_applies_after_increments(spark, sources, prices):
    shown, counters = usage.usage_report(
        spark, sources, prices, agents=["codex"], group_by=["month"], since="2026-07-01", timezone="UTC"
    )
    assert rows(shown, "month", "tokens") == [("2026-07", 30)]
    assert counters.first().negative_deltas == 1 and counters.first().malformed_events == 0


def read_envelope(spark, envelope, path):
    """The header, and the objects of each part."""
    report_files.write_envelope(envelope, path)
    header = json.loads(spark.read.text(f"{path}/header").first().value)
    parts = {name: [json.loads(r.value) for r in spark.read.text(f"{path}/{name}").collect()] for name in envelope.parts}
    return header, parts


def test_report_envelope(spark, sources, prices, tmp_path):
    envelope = usage.usage_document(spark, sources, prices, since="2026-07-01", timezone="Asia/Tokyo")
    header, parts = read_envelope(spark, envelope, str(tmp_path / "report"))
    assert list(header) == ["schema_version", "generated_at", "window", "timezone", "rates", "group_by", "data_quality"]
    assert header["schema_version"] == "1"
    assert header["window"] == {"since": "2026-06-30T15:00:00+00:00", "until": None}
    assert header["rates"] == {"catalog_version": "v-test", "sha256": "sha"}
    assert {r["month"] for r in parts["rows"]} == {"2026-07"}
    assert all(tuple(r) == REPORT_COLUMNS for r in parts["rows"])
    assert {(r["agent"], r["model"]) for r in parts["rows"]} == {("claude", "unheard-of"), ("claude", "x"), ("codex", "(unknown)"), ("codex", "gpt-y")}


def test_export(spark, sources, tmp_path):
    exported = usage.export_facts(spark, sources)
    path = str(tmp_path / "facts")
    export.write_export(exported, path)
    records = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(records) == 9
    assert all(tuple(r) == FACT_COLUMNS for r in records)
    archived = next(r for r in records if r["session_id"] == "th-2")
    assert archived == {
        "occurred_at_utc": "2026-06-30T23:30:00+00:00", "agent": "codex", "session_id": "th-2", "model_raw": None,
        "model_key": "(unknown)", "token_kind": "input_nocache", "tokens": 7, "mode": "unknown",
        "source_quality": "first_event_delta",
    }


def test_measure_envelope(spark, sources, prices, tmp_path):
    ids = spark.createDataFrame([("sess-1",), ("th-1",), ("nobody",)], "session_id string")
    header, parts = read_envelope(spark, usage.measure_document(spark, sources, prices, ids), str(tmp_path / "digest"))
    assert header["protocol_version"] == "measure/v1" and header["agent"] == ["claude", "codex"]
    sessions = {r["session_id"]: r for r in parts["sessions"]}
    assert list(sessions) == ["nobody", "sess-1", "th-1"]
    nobody = sessions["nobody"]
    assert nobody["matched"] is False and nobody["rows"] == [] and nobody["totals"]["tokens"] == 0
    first = sessions["sess-1"]
    assert first["matched"] is True and first["totals"]["tokens"] == 1517
    assert [r["token_kind"] for r in first["rows"]] == ["output", "cache_write_unknown", "input_nocache", "output"]
    assert sessions["th-1"]["totals"]["credits"] == pytest.approx(80 * 750 / 1e6)
    assert [r["totals"]["tokens"] for r in parts["total"]] == [1517 + 180]
    assert header["data_quality"]["source_quality"] == {"ok": 5, "first_event_delta": 3}
    assert header["data_quality"]["unpriced_tokens"] == 7


def test_reconciliation(spark, sources):
    collected = usage.collect_usage(spark, sources, agents=["codex"])
    assert rows(collected.reconciliation, "thread_id", "tokens_used", "derived_total") == [("th-1", 400, 180)]


def test_csv(spark, sources, prices, tmp_path):
    shown, _ = usage.usage_report(spark, sources, prices, group_by=["agent"])
    path = str(tmp_path / "csv")
    report_files.write_report_csv(shown, path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert ",".join(REPORT_COLUMNS) in text and ",claude,,,1517," in text


def test_envelopes_have_no_largest_size(spark, prices, tmp_path):
    one = F.lit(1).cast("bigint")
    rows_ = spark.range(250_000).select(
        F.lit("2026-07").alias("month"), F.lit("claude").alias("agent"), F.col("id").cast("string").alias("model"),
        F.lit("output").alias("token_kind"), one.alias("tokens"), one.alias("priced_tokens"), (one - 1).alias("unpriced_tokens"),
        F.lit(0).cast("decimal(38,17)").alias("estimated_cost_usd"), F.lit(0).cast("decimal(38,17)").alias("credits"),
        F.lit("priced").alias("pricing_status"),
    )
    envelope = report_files.report_envelope(
        rows_, headers=prices.headers, data_quality=quality.data_quality(quality.unpriced_tokens(rows_)),
        group_by=["month"], timezone="UTC",
    )
    report_files.write_envelope(envelope, str(tmp_path / "large"))
    assert spark.read.text(str(tmp_path / "large" / "rows")).count() == 250_000
    assert spark.read.text(str(tmp_path / "large" / "header")).count() == 1


def test_no_source(spark, prices):
    with pytest.raises(Exception, match="no source"):
        usage.usage_report(spark, usage.Sources(), prices)


def test_bad_bounds_fail_before_anything_is_read(spark, prices):
    nowhere = usage.Sources(session_root="no-such-scheme://x")
    for options in ({"since": "soon"}, {"until": "2026-13-01"}, {"timezone": "Mars/Base"}):
        for job in (
            lambda **o: usage.usage_report(spark, nowhere, prices, **o),
            lambda **o: usage.export_facts(spark, nowhere, **o),
            lambda **o: usage.measure(spark, nowhere, prices, spark.range(0).selectExpr("'' as session_id"), **o),
        ):
            with pytest.raises(Exception, match=r"invalid date/time|INVALID_TIMEZONE|[Tt]ime ?zone|Mars"):
                job(**options)


def test_two_catalogs_are_refused_before_anything_is_read(spark, prices):
    twice = Catalog(prices.headers.unionAll(prices.headers), prices.entries.unionAll(prices.entries))
    with pytest.raises(Exception, match="exactly one"):
        usage.usage_report(spark, usage.Sources(session_root="no-such-scheme://x"), twice)
    with pytest.raises(Exception, match="exactly one"):
        pricing.price_book(twice)


def test_old_files_are_pruned_on_request(spark, prices, sources):
    whole, _ = usage.usage_report(spark, sources, prices, since="2020-01-01", prune_files=True)
    assert whole.agg(F.sum("tokens")).first()[0] == 1517 + 187
    none, _ = usage.usage_report(spark, sources, prices, since="2999-01-01", prune_files=True)
    assert none.count() == 0


def test_the_run_folder_can_be_removed(spark, sources, prices, tmp_path):
    shown, _ = usage.usage_report(spark, sources, prices, group_by=["agent"])
    report_files.write_report_json(shown, str(tmp_path / "out"))
    folder = Path(run_dir(spark).removeprefix("file:"))
    assert folder.exists()
    remove_written(spark)
    assert not folder.exists()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_missing_folders_are_no_error(spark, prices, tmp_path):
    gone = usage.Sources(session_root=str(tmp_path / "gone"))
    shown, counters = usage.usage_report(spark, gone, prices)
    assert shown.count() == 0 and counters.filter(F.col("malformed_events") == 0).count() == 1
