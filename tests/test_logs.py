import json
import os
import random

from tests.helpers import lines, rows
from pyspark.sql import functions as F

from tokenledger.functions.times import instant
from tokenledger.operators import quality, rollouts, session_events
from tokenledger.sources import logs
from tokenledger.sources.threads import resolve_rollouts, select_threads


def assistant(at, usage, model="m", session="s", **extra):
    event = {"type": "assistant", "timestamp": at, "message": {"model": model, "usage": usage}, **extra}
    return json.dumps({**event, "sessionId": session} if session else event)


AT = "2026-06-01T00:00:00Z"


def kinds(facts):
    return rows(facts, "token_kind", "tokens")


def test_lines_that_are_no_events(spark):
    content = [
        "", "   ", "{not json", '{"a":1} x', '{"a":1}{"b":2}', "[1]", "7", "null", "{'a':1}",
        '{"type":"user","message":"text"}', '{"type":"assistant","message":{"usage":"n/a"}}',
        '{"type":"assistant","message":"text"}', assistant("nope", {"input_tokens": 5}),
        assistant(None, {"input_tokens": 5}), assistant(AT, {"input_tokens": 5}),
    ]
    events = session_events.read_events(lines(spark, {"f": content}))
    assert quality.malformed_events(events).first()[0] == 10
    assert kinds(session_events.session_facts(lines(spark, {"f": content}))) == [("input_nocache", 5)]


def test_one_session_with_two_models(spark):
    content = [
        assistant(AT, {"input_tokens": 10, "output_tokens": 2}, "claude-a-1.5"),
        assistant("2026-07-01T00:00:00Z", {"output_tokens": 3, "speed": "fast"}, "b"),
        assistant(AT, {"output_tokens": 4, "speed": "standard"}, None),
    ]
    facts = session_events.session_facts(lines(spark, {"f": content}))
    assert rows(facts, "model_raw", "model_key", "token_kind", "tokens", "mode") == [
        ("(unknown)", "(unknown)", "output", 4, "normal"),
        ("b", "b", "output", 3, "fast"),
        ("claude-a-1.5", "claude-a-1-5", "input_nocache", 10, "unknown"),
        ("claude-a-1.5", "claude-a-1-5", "output", 2, "unknown"),
    ]


def test_cache_writes(spark):
    ttl = {"ephemeral_5m_input_tokens": 30, "ephemeral_1h_input_tokens": 20}
    cases = [
        ({"cache_creation_input_tokens": 60, "cache_creation": ttl}, [30, 20, 10]),
        ({"cache_creation_input_tokens": 40, "cache_creation": ttl}, [30, 20, 0]),
        ({"cache_creation_input_tokens": 60}, [0, 0, 60]),
        ({"cache_creation_input_tokens": 60, "cache_creation": None}, [0, 0, 60]),
        ({"cache_creation_input_tokens": 60, "cache_creation": {}}, [0, 0, 60]),
    ]
    names = ("cache_write_5m", "cache_write_1h", "cache_write_unknown")
    for usage, expected in cases:
        facts = session_events.session_facts(lines(spark, {"f": [assistant(AT, usage)]}))
        assert kinds(facts) == sorted((n, t) for n, t in zip(names, expected) if t)


def test_unreadable_count_keeps_earlier_kinds(spark):
    usage = {"input_tokens": "7", "cache_read_input_tokens": 3, "cache_creation_input_tokens": "x", "output_tokens": 9}
    content = [assistant(AT, usage), assistant(AT, {"input_tokens": -4, "output_tokens": 1.9})]
    events = session_events.read_events(lines(spark, {"f": content}))
    assert quality.malformed_events(events).first()[0] == 1
    facts = session_events.usage_facts(session_events.fill_session_id(events))
    assert kinds(facts) == [("cache_read", 3), ("input_nocache", 7), ("output", 1)]


def test_session_id_is_first_seen_across_blocks(spark):
    pick, files, expected = random.Random(4), {}, []
    for name, size in (("hot", 120), ("other", 9)):
        content, first = [], None
        for i in range(size):
            own = pick.choice([None, None, None, "", f"{name}-{i}"]) if i > 8 else None
            if pick.random() < 0.3:
                content.append(json.dumps({"type": "user", "sessionId": own}))
                first = first or own
            else:
                content.append(assistant(AT, {"output_tokens": i + 1}, session=own))
                first = first or own
                expected.append((own or first or None, i + 1))
        files[name] = content
    facts = session_events.session_facts(lines(spark, files, block_size=5))
    assert rows(facts, "session_id", "tokens") == sorted(expected, key=lambda r: (r[0] is not None, r))


def test_session_files(spark, tmp_path):
    root = tmp_path / "a b"
    (root / "p1" / "deep").mkdir(parents=True)
    (root / "p2").mkdir()
    (root / "p1" / "one.jsonl").write_text(assistant(AT, {"output_tokens": 1}) + "\n\n")
    (root / "p2" / "two.jsonl").write_text(assistant(AT, {"output_tokens": 2}))
    (root / "p1" / "deep" / "no.jsonl").write_text(assistant(AT, {"output_tokens": 4}))
    (root / "p1" / "no.txt").write_text(assistant(AT, {"output_tokens": 8}))
    (root / "no.jsonl").write_text(assistant(AT, {"output_tokens": 16}))
    read = logs.session_lines(spark, str(root))
    assert kinds(session_events.session_facts(read)) == [("output", 1), ("output", 2)]
    assert logs.session_lines(spark, str(tmp_path / "absent")).count() == 0
    old = root / "p1" / "one.jsonl"
    os.utime(old, (1_000_000_000, 1_000_000_000))
    recent = logs.session_lines(spark, str(root), touched_since=F.lit("2010-01-01").cast("timestamp"))
    assert kinds(session_events.session_facts(recent)) == [("output", 2)]
    same_day = instant(F.lit("2001-09-10T00:00:00Z"))
    assert logs.session_lines(spark, str(root), touched_since=same_day).count() == 3
    listing = logs.file_listing(spark, [str(root)], pattern="*.jsonl", recursive=True)
    assert {os.path.basename(r.file) for r in logs.unread_files(listing, read).collect()} == {"no.jsonl"}


def test_order_within_a_file_read_in_many_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    content = [json.dumps({"type": "user", "n": i, "pad": "x" * (i % 50)}) for i in range(3000)]
    (tmp_path / "p" / "f.jsonl").write_text("\n".join(content))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        read = logs.session_lines(spark, str(tmp_path)).withColumn("n", F.get_json_object("line", "$.n").cast("int"))
        found = [r.n for r in read.orderBy("block", "pos").collect()]
        assert read.select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == list(range(3000))


# --- rollouts ---------------------------------------------------------------------------------------


def total(at, *counters):
    names = ("input_tokens", "cached_input_tokens", "output_tokens")
    usage = dict(zip(names, counters), reasoning_output_tokens=99) if counters else None
    payload = {"type": "token_count", "info": {"total_token_usage": usage}}
    return json.dumps({"type": "event_msg", "timestamp": at, "payload": payload})


def started(kind):
    payload = {"type": "task_started", "collaboration_mode_kind": kind}
    return json.dumps({"type": "event_msg", "timestamp": AT, "payload": payload})


def threads(spark, *made):
    return spark.createDataFrame(list(made), "file string, thread_id string, model string, tokens_used bigint")


def rollout(spark, content, model="gpt-y", block_size=2):
    events = rollouts.read_events(lines(spark, {"f": content}, block_size))
    increments = rollouts.deltas(events, threads(spark, ("f", "t", model, 0)))
    return events, increments, rollouts.delta_facts(increments)


def test_increments_and_first_flag(spark):
    content = [total(AT), total("2026-06-01T01:00:00Z", 100, 20, 50), total("2026-06-01T02:00:00Z", 250, 50, 90)]
    _, _, facts = rollout(spark, content)
    assert rows(facts, "source_quality", "token_kind", "tokens", "session_id") == [
        ("first_event_delta", "cache_read", 20, "t"),
        ("first_event_delta", "input_nocache", 80, "t"),
        ("first_event_delta", "output", 50, "t"),
        ("ok", "cache_read", 30, "t"),
        ("ok", "input_nocache", 120, "t"),
        ("ok", "output", 40, "t"),
    ]


def test_reset_is_counted_and_becomes_the_baseline(spark):
    content = [total(AT, 100, 50, 20), total(AT, 10, 5, 2), total(AT, 30, 10, 12)]
    _, increments, facts = rollout(spark, content)
    assert quality.negative_deltas(rollouts.thread_counters(increments)).first()[0] == 2
    assert rows(facts.filter("source_quality = 'ok'"), "token_kind", "tokens") == [
        ("cache_read", 5),
        ("input_nocache", 15),
        ("output", 10),
    ]


def test_input_channel_drops_together_and_uncached_is_clamped(spark):
    content = [total(AT, 100, 50, 20), total(AT, 120, 40, 30), total(AT, 125, 60, 30)]
    _, increments, facts = rollout(spark, content)
    assert quality.negative_deltas(rollouts.thread_counters(increments)).first()[0] == 1
    assert rows(facts.filter("source_quality = 'ok'"), "token_kind", "tokens") == [("cache_read", 20), ("output", 10)]


def test_unusable_snapshots_do_not_move_the_baseline(spark):
    content = [
        total("nope", 1, 0, 0),
        total(AT, 10, 0, 0),
        total(AT, "x", 0, 0),
        '{"type":"event_msg","payload":"text"}',
        '{"type":"other","payload":"text"}',
        "{broken",
        total(AT, 30, 0, 0),
    ]
    events, _, facts = rollout(spark, content)
    assert quality.malformed_events(events).first()[0] == 4
    assert rows(facts, "source_quality", "tokens") == [("first_event_delta", 10), ("ok", 20)]


def test_collaboration_mode_sticks_from_the_first_start(spark):
    content = [total(AT, 1, 0, 0), started("default"), total(AT, 3, 0, 0), started("fast"), total(AT, 7, 0, 0)]
    _, _, facts = rollout(spark, content)
    assert rows(facts, "tokens", "mode") == [(1, "unknown"), (2, "normal"), (4, "normal")]
    _, _, facts = rollout(spark, content, model=None)
    assert rows(facts, "model_raw", "model_key", "tokens")[0] == (None, "(unknown)", 1)


def test_thread_table_generations(spark):
    made = [("a", 0, 5), ("b", 1, 9), ("c", 0, 7)]
    current = spark.createDataFrame(made, "id string, archived int, created_at_ms bigint")
    assert [r.id for r in select_threads(current).collect()] == ["b", "c", "a"]
    assert [r.id for r in select_threads(current, include_archived=False).collect()] == ["c", "a"]
    assert [r.id for r in select_threads(current, created_since_ms=7, created_until_ms=9).collect()] == ["c"]
    legacy = current.select("id")
    assert select_threads(legacy, include_archived=False, created_since_ms=99).count() == 3


def test_threads_and_their_files(spark):
    made = [("1", "/h/a.jsonl"), ("2", "a.jsonl"), ("3", "gone.jsonl"), ("4", None), ("5", "")]
    table = spark.createDataFrame([(i, p, "m", 10) for i, p in made], "id string, rollout_path string, model string, tokens_used bigint")
    files = spark.createDataFrame([("file:///h/a.jsonl",), ("file:///h/un%20used.jsonl",)], "file string")
    resolved = resolve_rollouts(table, files, "/h/")
    assert rows(resolved, "id", "path", "present") == [
        ("1", "/h/a.jsonl", True),
        ("2", "/h/a.jsonl", True),
        ("3", "/h/gone.jsonl", False),
    ]
    assert quality.skipped_threads(resolved).first()[0] == 1
    by_file = rollouts.by_file(resolved, files)
    read = lines(spark, {"file:///h/a.jsonl": [total(AT, 5, 0, 0), "{"]})
    assert rows(rollouts.rollout_facts(read, by_file), "session_id", "tokens") == [("1", 5), ("2", 5)]
    malformed = quality.malformed_rollout_events(rollouts.read_events(read), by_file)
    assert malformed.first()[0] == 2


def test_paths_are_compared_in_one_form(spark):
    paths = ["/h/x/../x/r.jsonl", "./x/r.jsonl", "x//r.jsonl", "x/r.log", "../h/x/r.jsonl", "s3a://b/h//x/./r.jsonl"]
    table = spark.createDataFrame(list(enumerate(paths)), "id int, rollout_path string")
    files = spark.createDataFrame([("file:///h/x/r.jsonl",), ("file:///h/x/r.log",), ("s3a://b/h/x/r.jsonl",)], "file string")
    assert rows(resolve_rollouts(table, files, "/h"), "id", "path", "present") == [
        (0, "/h/x/r.jsonl", True),
        (1, "/h/x/r.jsonl", True),
        (2, "/h/x/r.jsonl", True),
        (3, "/h/x/r.log", True),
        (4, "/h/x/r.jsonl", True),
        (5, "s3a://b/h/x/r.jsonl", True),
    ]


def test_an_absent_root_takes_no_other_with_it(spark, tmp_path):
    (tmp_path / "there").mkdir()
    (tmp_path / "there" / "r.log").write_text(total(AT, 5, 0, 0))
    roots = [str(tmp_path / "absent"), str(tmp_path / "there")]
    assert logs.rollout_lines(spark, roots).count() == 1
    listing = logs.file_listing(spark, roots, recursive=True)
    assert [os.path.basename(r.file) for r in listing.collect()] == ["r.log"]
    assert logs.rollout_lines(spark, roots[:1]).count() == 0


def test_vanished_files_are_counted(spark):
    made = [(f"file:///{name}", size) for name, size in (("a", 1), ("b", 1), ("c", 0), ("d", 1))]
    before = spark.createDataFrame(made, "file string, size bigint")
    after = before.filter("file = 'file:///d'")
    events = before.select("file").filter("file = 'file:///a'")
    gone = logs.vanished_files(before, after, events)
    assert [r.file for r in gone.collect()] == ["file:///b"]
    assert quality.skipped_files(gone).first()[0] == 1


def test_text_around_a_line_makes_it_malformed(spark):
    good = '{"type":"assistant"}'
    broken = [
        good + ',"k":2',
        "1,\"event\":" + good,
        '{"a":1}],"event":[{"a":2}',
        good + good,
        good + "]",
        '"k":' + good,
        good + ',"complete":true}',
    ]
    parsed = logs.parse_lines(lines(spark, {"f": [good, f" {good} ", *broken, "[1]", "7", "null"]}), logs.SESSION_EVENT)
    found = {r.line: r.malformed for r in parsed.collect()}
    assert not found[good] and not found[f" {good} "]
    assert all(malformed for line, malformed in found.items() if line.strip() != good), found


def test_reconciliation(spark):
    own = {"exact": 10_000, "close": 10_090, "far": 10_200, "none": 0}
    made = threads(spark, *[(name, name, "m", n) for name, n in own.items()])
    content = {name: [total(AT, 9_000, 1_000, 1_000)] for name in own}
    counters = rollouts.thread_counters(rollouts.deltas(rollouts.read_events(lines(spark, content)), made))
    assert rows(quality.reconcile(made, counters), "thread_id", "derived_total", "difference") == [("far", 10_000, 200)]
