"""Reports from a summary against reports from the facts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tests.helpers import catalog, facts, period

from tokenledger.operators import report, rollup

ZONES = ("UTC", "Asia/Kathmandu", "America/St_Johns")
GROUPINGS = ([], ["month"], ["agent", "token-kind"], ["month", "agent", "model", "token-kind"])


def made(spark, seed, n=300):
    rng = random.Random(seed)
    start = datetime(2026, 1, 25)
    return facts(
        spark,
        *[
            ((start + timedelta(seconds=rng.randrange(20 * 86400))).isoformat(), rng.choice(["claude", "codex"]), "s",
             rng.choice(["m", "n", "none"]), rng.choice(["input_nocache", "output", "cache_write_unknown"]),
             rng.randrange(1, 10**6), rng.choice(["fast", "normal"]))
            for _ in range(n)
        ],
    )


@pytest.fixture(scope="module")
def prices(spark):
    # A period that begins within a quarter of an hour.
    early = period("a", "2025-01-01", "2026-01-31T23:52:30Z", input_nocache="0.12345678", output="3", cache_write_5m="1")
    late = period("b", "2026-01-31T23:52:30Z", None, input_nocache="7.7", output="0.00000001")
    return catalog(
        spark,
        {"model_key": "m", "aliases": ["n"], "fast_multiplier": "1.125", "rates": [early, late], "credits_per_mtok": {"output": "4.5"}},
    )


def listed(rows):
    return sorted(map(str, rows.collect()))


def test_any_zone_and_grouping(spark, prices):
    one, two = made(spark, 1), made(spark, 2)
    # Facts around the change of prices and of months.
    edge = facts(spark, *[(f"2026-01-31T23:{m}", "codex", "s", "m", "output", 1000, "normal") for m in ("45:00", "52:29", "52:30", "59:59")])
    parts = [rollup.summarized(part, prices) for part in (one, two, edge)]
    appended = parts[0].unionByName(parts[1]).unionByName(parts[2]).persist()
    whole = one.unionByName(two).unionByName(edge).persist()
    merged = rollup.compacted(appended).persist()
    assert merged.groupBy(*rollup._KEYS).count().filter("count > 1").count() == 0
    for zone in ZONES:
        for group_by in GROUPINGS:
            wanted = listed(report.usage_report(whole, prices, group_by=group_by, timezone=zone))
            assert listed(rollup.report_from(appended, group_by=group_by, timezone=zone)) == wanted, (zone, group_by)
    assert listed(rollup.report_from(merged)) == listed(report.usage_report(whole, prices))
    for frame in (appended, whole, merged):
        frame.unpersist()


def test_windows_end_at_quarters(spark, prices):
    asked, at = made(spark, 3), lambda text: F.lit(text).cast("timestamp")
    summary = rollup.summarized(asked, prices)
    since, until = at("2026-01-30 12:45:00"), at("2026-02-03 00:00:00")
    inside = asked.filter((F.col("occurred_at_utc") >= since) & (F.col("occurred_at_utc") < until))
    assert listed(rollup.report_from(summary, since=since, until=until)) == listed(report.usage_report(inside, prices))
    with pytest.raises(Exception, match="quarter"):
        rollup.report_from(summary, since=at("2026-01-30 12:46:00")).collect()


def test_nothing(spark, prices):
    assert rollup.report_from(rollup.summarized(made(spark, 4, 1).limit(0), prices)).count() == 0
