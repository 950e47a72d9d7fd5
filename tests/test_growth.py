"""What grows with the input stays off the driver and off single tasks."""

import hashlib
from pathlib import Path

from tests.helpers import rows
from tokenledger.operators import quality, rollouts
from tokenledger.plans import inputs, queries
from tokenledger.session import written
from tokenledger.sources.threads import resolve_rollouts


def test_catalog_files_are_dealt_to_folders(spark, tmp_path, monkeypatch):
    """The commit moves folders, not every file; a repeated id stays one file."""
    ids = [*range(600), 7, None]
    spark.createDataFrame([(i,) for i in ids], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(queries, "shared_dir", lambda _: f"{tmp_path}/files")
    got = dict(rows(queries.all_queries()["catalog_sha256"](spark, str(tmp_path)), "catalog_id", "sha256"))
    folders = [folder for folder in Path(tmp_path, "files").iterdir() if folder.is_dir()]
    assert 1 < len(folders) <= queries.CATALOG_FOLDERS + 1
    docs = inputs.header_documents(spark, str(tmp_path)).collect()
    lines = {}
    for row in docs:
        lines.setdefault(row.catalog_id or "__HIVE_DEFAULT_PARTITION__", []).append(f"{row.document}\n")
    assert got == {name: hashlib.sha256("".join(text).encode()).hexdigest() for name, text in lines.items()}


def test_threads_and_their_logs_are_not_broadcast(spark):
    """Estimated by compressed bytes they look small at any size that matters."""
    files = written(spark.createDataFrame([("file:///h/a",), ("file:///h/b",)], "file string"))
    threads = spark.createDataFrame(
        [("1", "m", "a", 900), ("2", "m", "gone", 5), ("3", None, "b", 5)], "id string, model string, rollout_path string, tokens_used bigint"
    )
    resolved = resolve_rollouts(threads, files, "/h")
    by_file = rollouts.by_file(resolved, files)
    totals = written(spark.createDataFrame([("file:///h/a", "1", 100)], "file string, thread_id string, derived_total bigint"))
    frames = {
        "resolved": (resolved.select("id", "present"), [("1", True), ("2", False), ("3", True)]),
        "by_file": (by_file.select("thread_id"), [("1",), ("3",)]),
        "reconciled": (quality.reconcile(by_file, totals).select("thread_id", "difference"), [("1", 800)]),
    }
    for name, (frame, expected) in frames.items():
        assert rows(frame, *frame.columns) == expected, name
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString(), name


def test_texts_of_times_are_made_after_counters_were_added_up(spark, tmp_path):
    """No sort, window or merge of a task keeps what a row's place already says."""
    events = spark.createDataFrame(
        [(i, 7, "click" if i % 3 else "signup", float(i)) for i in range(1, 20)],
        "event_id bigint, user_id bigint, event_type string, value double",
    ).selectExpr("*", "timestamp_seconds(1700000000 + event_id)::timestamp_ntz AS ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    lines = inputs.rollout_lines(spark, str(tmp_path))
    got = rows(lines.selectExpr("pos.event_id AS id", "get_json_object(line, '$.timestamp') AS at"), "id", "at")
    assert got == [(i, f"2023-11-14T22:13:{20 + i:02d}.000000Z") for i in range(1, 20)]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan[plan.index("RepartitionByExpression") :]
