"""Range joins: rows against the periods that cover them."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from tests.helpers import catalog, facts, period, rows

from tokenledger.operators import intervals, pricing

START = datetime(2020, 1, 1, tzinfo=timezone.utc)
PERIODS = "model string, begins timestamp, ends timestamp, id int"
ROWS = "name string, at timestamp, n int"


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def brute(rows_, periods):
    out = []
    for name, t, n in rows_:
        found = [
            p[3]
            for p in periods
            if name is not None and t is not None and p[0] == name and p[1] is not None and p[1] <= t
            and (p[2] is None or t < p[2])
        ]
        out += [(name, t, n, i) for i in found or [None]]
    return Counter(out)


def check(spark, rows_, periods):
    rows_ = [(name, at(t), n) for n, (name, t) in enumerate(rows_)]
    periods = [(model, at(a), at(b), i) for i, (model, a, b) in enumerate(periods)]
    joined = intervals.cover_join(
        spark.createDataFrame(rows_, ROWS), spark.createDataFrame(periods, PERIODS), {"name": "model"}, "at", "begins", "ends"
    )
    assert joined.columns == ["name", "at", "n", "model", "begins", "ends", "id"]
    utc = lambda t: t if t is None else t.astimezone(timezone.utc)
    got = Counter((r["name"], utc(r["at"]), r["n"], r["id"]) for r in joined.collect())
    assert got == brute(rows_, periods)
    return joined


def chain(model, bounds):
    """Periods that follow each other."""
    return [(model, a, b) for a, b in zip(bounds, [*bounds[1:], None], strict=True)]


def test_chains_gaps_and_edges(spark):
    rng = random.Random(1)
    bounds = sorted(rng.sample(range(100_000), 60))
    periods = chain("a", bounds) + [("b", 10, 20), ("b", 30, 40), ("c", 5, None), ("d", 7, 7), ("d", 9, 3), (None, 0, None)]
    periods += [("e", None, 50), ("e", None, None)]
    asked = [("a", t + d) for t in bounds for d in (-1, 0, 1)] + [("b", t) for t in range(0, 50, 3)]
    asked += [("c", t) for t in (0, 5, 10**9)] + [("d", t) for t in (3, 7, 9)] + [("e", 1), ("x", 1), (None, 1), ("a", None)]
    asked += [("a", -(10**9)), ("a", 10**9)]
    check(spark, asked, periods)


def test_crowded_cells_are_cut_again(spark):
    """Nearly all periods lie within a thousandth of the time that a few long ones span."""
    short = chain("a", list(range(500_000, 500_800)))[:-1]
    long = [("a", 0, 400_000), ("a", 600_000, 10**9), ("a", 10**9, None)]
    rng = random.Random(2)
    asked = [("a", rng.uniform(499_990, 500_810)) for _ in range(400)] + [("a", t) for t in (0, 399_999, 500_000, 600_000, 2 * 10**9)]
    check(spark, asked, short + long)


def test_periods_that_overlap_all_count(spark):
    rng = random.Random(3)
    periods = [("a", rng.randrange(1000), rng.choice([None, rng.randrange(1000)])) for _ in range(120)]
    periods += [("a", 500, 600)] * 30
    check(spark, [("a", rng.randrange(-10, 1100)) for _ in range(100)], periods)


def test_empty_sides(spark):
    check(spark, [("a", 1), (None, None)], [])
    check(spark, [], [("a", 1, 2)])


def test_index_stays_small(spark):
    """Any number of long, short, open and overlapping periods has a few cells for each."""
    rng = random.Random(4)
    spans = [(rng.randrange(10**6), rng.choice([1, 10**3, 10**8, None])) for _ in range(3000)]
    frame = spark.createDataFrame(
        [(i % 3, a, None if b is None else a + b) for i, (a, b) in enumerate(spans)], "k int, first long, last long"
    )
    cells = intervals._in_cells(frame, intervals._grid(frame, ["k"]), ["k"], "cell")
    assert cells.count() <= 3 * 3000


@pytest.fixture(scope="module")
def hundred_thousand(spark):
    """One model whose price changes every minute, 100,000 times."""
    begins = F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 60)
    return spark.range(100_000).select(
        F.lit("hot").alias("model"), begins.alias("begins"), (begins + F.expr("INTERVAL 1 MINUTE")).alias("ends"),
        F.col("id").cast("int").alias("id"),
    )


def test_one_model_of_a_hundred_thousand_periods(spark, hundred_thousand):
    asked = spark.range(200_000).select(
        F.when(F.col("id") >= 0, "hot").alias("name"),
        F.timestamp_seconds(F.lit(int(START.timestamp())) + F.pmod(F.xxhash64("id"), F.lit(6_000_000))).alias("at"),
    )
    joined = intervals.cover_join(asked, hundred_thousand, {"name": "model"}, "at", "begins", "ends")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "at_cell" in plan and "at_part" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    minute = F.floor((F.unix_timestamp("at") - F.lit(int(START.timestamp()))) / 60)
    assert joined.filter(F.col("id") == minute).count() == 200_000 == joined.count()


def test_prices_of_many_periods(spark):
    """A catalog beyond the bound prices as one below it does, period by period."""
    days = [(START + timedelta(days=i)).strftime("%Y-%m-%d") for i in range(31)]
    ends = [*days[1:], None]
    many = [period(f"r{i}", a, b, input_nocache=f"{i}.5", output="2") for i, (a, b) in enumerate(zip(days, ends, strict=True))]
    prices = catalog(
        spark,
        {"model_key": "m", "aliases": ["alias"], "fast_multiplier": "2", "rates": many, "credits_per_mtok": {"output": "4"}},
        {"model_key": "other", "aliases": [], "rates": many[5:6]},
    )
    assert prices.most_periods == 31 > intervals.CROWDED
    asked = facts(
        spark,
        *[(f"{day}T23:59:59", "codex", "s", name, kind, 1_000_000, mode)
          for day in [*days, "2019-12-31", "2030-01-01"] for name in ("m", "alias", "other", "none")
          for kind, mode in (("input_nocache", "fast"), ("output", "standard"), ("cache_read", "standard"))],
    )
    got = rows(pricing.lookup_period(asked, prices), "occurred_at_utc", "model_key", "token_kind", "resolved_key", "rate_id")
    for t, name, _, key, rate in got:
        i = (t.replace(tzinfo=timezone.utc) - START).days
        known = {"m": "m", "alias": "m", "other": "other"}.get(name)
        there = known and i >= 0 and (known == "m" or i == 5)
        assert key == known and rate == (f"r{min(i, 30)}" if there else None)
    priced = rows(pricing.price_facts(asked, prices), "occurred_at_utc", "model_key", "token_kind", "estimated_cost_usd", "credits")
    assert len(priced) == asked.count()
    for t, name, kind, usd, credit in priced:
        i = (t.replace(tzinfo=timezone.utc) - START).days
        there = i >= 0 and (name in ("m", "alias") or (name == "other" and i == 5)) and kind != "cache_read"
        want = None if not there else 2 if kind == "output" else (min(i, 30) + 0.5) * (2 if name != "other" else 1)
        assert (usd is None) == (want is None) and (want is None or float(usd) == want)
        assert (credit is None) == (not there or kind != "output" or name == "other")
