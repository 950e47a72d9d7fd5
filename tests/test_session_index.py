"""The index of session ids per log, and digests that read by it."""

import os

import pytest
from pyspark.sql import functions as F
from tests.helpers import catalog, rows
from tests.test_logs import AT, assistant, total
from tests.test_usage import MODELS

from tokenledger.plans import usage
from tokenledger.sources import logs, manifest, session_index


@pytest.fixture
def root(tmp_path):
    """Ten logs of three sessions each; the last has lines without ids."""
    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    for i in range(10):
        lines = [assistant(AT, {"output_tokens": 1 + i}, "x", f"s{i}-{j}") for j in range(3)]
        (folder / f"l{i}.jsonl").write_text("\n".join([*lines, "{broken", assistant(AT, {"output_tokens": 100}, "x", None)]))
    (folder / "none.jsonl").write_text(assistant(AT, {"output_tokens": 7}, "x", None))
    (folder / "empty.jsonl").write_text("")
    return tmp_path / "projects"


def wanted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "session_id string")


def listed(spark, root):
    return logs.file_listing(spark, [logs.session_glob(str(root))])


def names(files):
    return sorted(os.path.basename(r.file) for r in files.collect())


def test_files_without_the_ids_are_left_out(spark, root, tmp_path):
    path = str(tmp_path / "index")
    assert session_index.update_index(spark, str(root), path).count() == 11
    index = session_index.read_index(spark, path)
    hold = lambda *ids: names(session_index.may_hold(listed(spark, root), index, wanted(spark, *ids)))
    assert hold("s3-1") == ["l3.jsonl"]
    assert hold("s3-1", "s3-2", "s7-0", None, "s7-0") == ["l3.jsonl", "l7.jsonl"]
    assert hold("unheard-of") == [] == hold()
    # Without entries, or beyond the bound, all files are read.
    nothing = session_index.read_index(spark, str(tmp_path / "no-index"))
    assert len(names(session_index.may_hold(listed(spark, root), nothing, wanted(spark, "s3-1")))) == 11
    many = spark.range(session_index.MOST_REQUESTED + 1).selectExpr("cast(id as string) session_id")
    assert session_index.may_hold(listed(spark, root), index, many).count() == 11


def test_new_and_changed_logs(spark, root, tmp_path):
    path = str(tmp_path / "index")
    session_index.update_index(spark, str(root), path)
    log = root / "p" / "l1.jsonl"
    log.write_text(log.read_text() + "\n" + assistant(AT, {"output_tokens": 5}, "x", "late"))
    (root / "p" / "new.jsonl").write_text(assistant(AT, {"output_tokens": 5}, "x", "new"))
    index = lambda: session_index.read_index(spark, path)
    hold = lambda *ids: names(session_index.may_hold(listed(spark, root), index(), wanted(spark, *ids)))
    assert hold("late") == ["l1.jsonl", "new.jsonl"] == hold("unheard-of")
    assert names(session_index.update_index(spark, str(root), path)) == ["l1.jsonl", "new.jsonl"]
    assert hold("late") == ["l1.jsonl"] == hold("s1-0") and hold("new") == ["new.jsonl"]
    assert session_index.update_index(spark, str(root), path).count() == 0


def test_ids_of_large_files_are_always_found(spark):
    """Many segments, no id missed, and few taken to be there that are not."""
    listing = spark.createDataFrame([("big", 1), ("small", 2), ("none", 3)], "file string, size bigint").withColumn(
        "modified_at", F.timestamp_seconds(F.lit(0))
    )
    ids = spark.range(30_000).selectExpr("if(id % 100 = 0, 'small', 'big') file", "cast(id as string) session_id")
    index = session_index.entries(listing, ids)
    assert rows(index.groupBy("file").agg(F.first("segments").alias("n"), F.count(F.lit(1)).alias("k")), "file", "n", "k") == [
        ("big", 15, 15), ("none", 0, 1), ("small", 1, 1),
    ]
    index = index.persist()
    for start in (0, 29_500):
        asked = spark.range(start, start + 500).selectExpr("cast(id as string) session_id")
        for one in (asked.filter("session_id % 100 = 0"), asked.filter("session_id % 100 = 1")):
            held = names(session_index.may_hold(listing, index, one))
            assert ("big" if int(one.first()[0]) % 100 else "small") in held and "none" not in held
    hits = 0
    for i in range(5):
        absent = wanted(spark, *[f"absent-{i}-{j}" for j in range(20)])
        hits += "small" in names(session_index.may_hold(listing, index, absent))
    assert hits <= 1
    index.unpersist()


def test_digests_are_the_same_with_an_index(spark, root, tmp_path, monkeypatch):
    for name, n in (("a", 5), ("b", 7)):
        (tmp_path / f"{name}.jsonl").write_text(total(AT, n, 0, 0))
    made = [("th-a", "gpt-y", "a.jsonl", 0), ("th-b", "gpt-y", "b.jsonl", 0), ("th-c", "gpt-y", "gone.jsonl", 0)]
    threads = spark.createDataFrame(made, "id string, model string, rollout_path string, tokens_used bigint")
    prices, path = catalog(spark, *MODELS), str(tmp_path / "index")
    session_index.update_index(spark, str(root), path)
    read = []
    batches = manifest.line_batches

    def watched(files):
        read.extend(names(files))
        yield from batches(files)

    monkeypatch.setattr(manifest, "line_batches", watched)
    plain = usage.Sources(session_root=str(root), threads=threads, rollout_home=str(tmp_path))
    indexed = usage.Sources(session_root=str(root), threads=threads, rollout_home=str(tmp_path), session_index=path)
    ids = wanted(spark, "s4-0", "s4-2", "th-b", "nobody")
    found = {}
    for kind, sources in (("plain", plain), ("indexed", indexed)):
        read.clear()
        digest, _, qualities = usage.measure(spark, sources, prices, ids)
        found[kind] = sorted(map(str, digest.collect())), rows(qualities, "source_quality", "facts")
    assert found["plain"] == found["indexed"]
    assert sorted(read) == ["b.jsonl", "l4.jsonl"]
    counters = usage.measure(spark, indexed, prices, ids)[1].first()
    assert counters.malformed_events == 1 and counters.skipped_files == 0
