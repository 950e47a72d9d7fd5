"""Logs that threads name, among others that nothing names."""

import os
import shutil

import pytest
from pyspark.sql import functions as F
from tests.helpers import rows
from tests.test_logs import AT, total

from tokenledger.operators import rollouts
from tokenledger.plans import usage
from tokenledger.sources import manifest

ODD = ["a b.jsonl", "a%20b.jsonl", "a+b.log", "[x].jsonl", "{a,b}.jsonl", "st*r.jsonl", "q?.jsonl", "back\\slash", "日é.jsonl", "plain"]


def named(spark, *paths):
    return spark.createDataFrame([(str(path),) if path is not None else (None,) for path in paths], "path string")


def lines_of(spark, files):
    frames = list(manifest.line_batches(files))
    return frames, [r.line for frame in frames for r in frame.collect()]


def test_one_log_among_ten_thousand(spark, tmp_path):
    folder = tmp_path / "sessions" / "2026"
    folder.mkdir(parents=True)
    for i in range(10_000):
        (folder / f"r{i}.jsonl").write_text("x")
    files = manifest.named_files(named(spark, folder / "r4711.jsonl"))
    assert rows(files, "path", "size") == [(str(folder / "r4711.jsonl"), 1)]
    frames, lines = lines_of(spark, files)
    assert [frame.inputFiles() for frame in frames] == [[f"file://{folder}/r4711.jsonl"]] and lines == ["x"]


@pytest.mark.parametrize("batch", [10_000, 3])
def test_names_are_taken_as_they_are(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(manifest, "BATCH_FILES", batch)
    for name in [*ODD, "x.jsonl", "a.jsonl", "b.jsonl", "star.jsonl", "q1.jsonl"]:
        (tmp_path / name).write_text(f"of {name}\n\nnext")
    files = manifest.named_files(named(spark, *[tmp_path / name for name in ODD]))
    assert sorted(os.path.basename(r.path) for r in files.collect()) == sorted(ODD)
    frames, lines = lines_of(spark, files)
    assert sorted(line for line in lines if line.startswith("of")) == sorted(f"of {name}" for name in ODD)
    assert len(frames) == -(-len(ODD) // batch)
    # Lines and manifest agree on the name of a file.
    seen = {r.file for frame in frames for r in frame.select("file").distinct().collect()}
    assert seen == {r.file for r in files.collect()}


def test_what_is_no_file_is_not_there(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / ".dot").write_text("x")
    (tmp_path / "file").write_text("x")
    names = ["folder", "_hidden", ".dot", "file/below", "gone", "gone/too", "file", "file"]
    files = manifest.named_files(named(spark, None, *[tmp_path / name for name in names]))
    assert rows(files, "path") == [(str(tmp_path / "file"),)]
    assert manifest.named_files(named(spark)).count() == 0
    assert manifest.read_named(files.limit(0), rollouts.read_events).count() == 0


def test_pruned_by_the_times_of_the_manifest(spark, tmp_path):
    for name, day in (("old", 10), ("new", 20)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (day * 86400, day * 86400))
    files = manifest.named_files(named(spark, tmp_path / "old", tmp_path / "new"))
    since = lambda day: F.timestamp_seconds(F.lit(day * 86400))
    for day, kept in ((9, 2), (11, 2), (12, 1), (21, 1), (22, 0)):
        assert manifest.touched(files, since(day)).count() == kept
    assert manifest.touched(files, None).count() == 2


def test_removed_meanwhile(spark, tmp_path):
    for name in ("kept", "removed", "empty"):
        (tmp_path / name).write_text("" if name == "empty" else total(AT, 5, 0, 0))
    files = manifest.named_files(named(spark, *[tmp_path / name for name in ("kept", "removed", "empty")]))
    (tmp_path / "removed").unlink()
    (tmp_path / "empty").unlink()
    events = manifest.read_named(files, rollouts.read_events)
    assert rows(events.select("input"), "input") == [(5,)]
    assert rows(manifest.gone(files, events), "path") == [(str(tmp_path / "removed"),)]
    (tmp_path / "removed").write_text("")
    assert manifest.gone(files, events).count() == 0


def test_threads_name_logs_anywhere(spark, tmp_path):
    (tmp_path / "home" / "sessions").mkdir(parents=True)
    (tmp_path / "elsewhere").mkdir()
    inside, outside = tmp_path / "home" / "sessions" / "r.jsonl", tmp_path / "elsewhere" / "r.jsonl"
    inside.write_text(total(AT, 5, 0, 0))
    outside.write_text(total(AT, 7, 0, 0))
    shutil.copy(inside, tmp_path / "home" / "sessions" / "unnamed.jsonl")
    made = [("1", "m", "sessions/r.jsonl", 0), ("2", "m", str(outside), 0), ("3", "m", "sessions/../gone", 0)]
    threads = spark.createDataFrame(made, "id string, model string, rollout_path string, tokens_used bigint")
    home = str(tmp_path / "home")
    for roots, facts, skipped in (([], [("1", 5), ("2", 7)], 1), ([f"{home}/sessions/"], [("1", 5)], 2), ([home], [("1", 5)], 2)):
        sources = usage.Sources(threads=threads, rollout_home=home, rollout_roots=roots)
        collected = usage.collect_usage(spark, sources, agents=["codex"])
        assert rows(collected.facts, "session_id", "tokens") == facts
        assert sum(c.first().asDict().get("skipped_files") or 0 for c in collected.counters) == skipped
