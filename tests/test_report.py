from decimal import Decimal
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F
from tests.helpers import catalog, facts, period, rows

from tokenledger.fixed_values import REPORT_DIMENSIONS, TOKEN_KINDS
from tokenledger.operators import facts as fact_ops
from tokenledger.operators import joins, pricing, report

PRICES = period(
    "a-1", "2026-01-01", None, input_nocache="5.0", cache_read="0.5", cache_write_5m="6.25", cache_write_1h="0", output="30.0"
)
A = {
    "model_key": "a",
    "aliases": ["a-alias"],
    "fast_multiplier": "2.5",
    "credits_per_mtok": {"input_nocache": "125", "output": "750"},
    "rates": [PRICES],
}
PLAIN = {"model_key": "b", "aliases": [], "rates": [{**PRICES, "rate_id": "b-1", "output": None}]}
MILLION = 1_000_000


@pytest.fixture
def prices(spark):
    return catalog(spark, A, PLAIN)


def one(spark, prices, model, kind, mode="normal", at="2026-02-01", tokens=MILLION):
    row = pricing.price_facts(facts(spark, (at, "claude", "s", model, kind, tokens, mode)), prices).first()
    return row.estimated_cost_usd, row.credits, row.pricing_status


def test_prices(spark, prices):
    assert one(spark, prices, "a", "input_nocache") == (Decimal(5), Decimal(125), "priced")
    assert one(spark, prices, "a-alias", "output", "fast") == (Decimal(75), Decimal(1875), "priced")
    assert one(spark, prices, "a", "cache_write_unknown") == (Decimal("6.25"), None, "lower_bound")
    assert one(spark, prices, "a", "cache_write_1h") == (Decimal(0), None, "priced")
    assert one(spark, prices, "b", "output") == (None, None, "unpriced")
    assert one(spark, prices, "b", "input_nocache", "fast") == (Decimal(5), None, "priced")
    assert one(spark, prices, "z", "output") == (None, None, "unpriced")
    assert one(spark, prices, "a", "output", at="2025-12-31") == (None, None, "unpriced")
    assert one(spark, prices, "a", "cache_read", tokens=1)[0] == Decimal("0.0000005")


def sample(spark):
    made = []
    for i in range(240):
        month = 1 + i % 4
        model = ("a", "a", "a-alias", "b", "z")[i % 5]
        agent = "codex" if i % 3 == 0 else "claude"
        kind = TOKEN_KINDS[i % 6]
        made.append((f"2026-{month:02d}-28 20:00:00", agent, f"s{i % 7}", model, kind, 1000 + i, ("fast", "normal")[i % 2]))
    return facts(spark, *made)


def test_every_subset_of_dimensions_has_the_same_totals(spark, prices):
    made = sample(spark)
    subsets = chain.from_iterable(combinations(REPORT_DIMENSIONS, n) for n in range(5))
    totals = {
        tuple(report.report_totals(report.usage_report(made, prices, group_by=dims)).first()) for dims in subsets
    }
    assert len(totals) == 1
    assert totals.pop()[0] == sum(1000 + i for i in range(240))


def test_report_of_two_windows_adds_up(spark, prices):
    made, middle = sample(spark), F.lit("2026-02-28 20:00:00").cast("timestamp")
    parts = [fact_ops.in_window(made, until=middle), fact_ops.in_window(made, since=middle)]
    halves = [report.usage_report(part, prices) for part in parts]
    whole = report.usage_report(made, prices)
    columns = whole.columns
    assert rows(halves[0].unionByName(halves[1]), *columns) == rows(whole, *columns)


def test_splitting_a_period_changes_nothing(spark, prices):
    first = {**PRICES, "effective_until": "2026-02-15T00:00:00Z"}
    second = {**PRICES, "rate_id": "a-2", "effective_from": "2026-02-15T00:00:00Z"}
    split = catalog(spark, {**A, "rates": [first, second]}, PLAIN)
    made, columns = sample(spark), report.usage_report(sample(spark), prices).columns
    assert rows(report.usage_report(made, split), *columns) == rows(report.usage_report(made, prices), *columns)


def test_row_status_is_the_worst(spark, prices):
    made = facts(
        spark,
        ("2026-02-01", "claude", "s", "a", "output", MILLION, "normal"),
        ("2026-02-01", "claude", "s", "z", "output", 7, "normal"),
        ("2026-02-01", "claude", "t", "a", "cache_write_unknown", MILLION, "normal"),
        ("2026-02-01", "claude", "t", "a", "output", MILLION, "normal"),
    )
    mixed = report.usage_report(made.filter("session_id = 's'"), prices, group_by=["agent"]).first()
    assert (mixed.estimated_cost_usd, mixed.priced_tokens, mixed.unpriced_tokens) == (Decimal(30), MILLION, 7)
    assert mixed.pricing_status == "unpriced" and mixed.month is None and mixed.model is None
    bounded = report.usage_report(made.filter("session_id = 't'"), prices, group_by=["agent"]).first()
    assert bounded.pricing_status == "lower_bound"


def test_months_and_order(spark, prices):
    made = facts(
        spark,
        ("2026-02-28 20:00:00", "codex", None, "b", "output", 1, "normal"),
        ("2026-02-28 20:00:00", "claude", None, "b", "output", 2, "normal"),
        ("2026-01-01 00:00:00", "codex", None, "B", "output", 3, "normal"),
    )
    shown = report.in_report_order(report.usage_report(made, prices, timezone="Asia/Tokyo"))
    assert [(r.month, r.agent, r.tokens) for r in shown.collect()] == [
        ("2026-01", "codex", 3),
        ("2026-03", "claude", 2),
        ("2026-03", "codex", 1),
    ]
    models = report.in_report_order(report.usage_report(made, prices, group_by=["model", "nonsense"]))
    assert [r.model for r in models.collect()] == ["B", "b"]


def test_no_facts(spark, prices):
    nothing = sample(spark).filter("false")
    ids = spark.createDataFrame([("s1",), ("s1",)], "session_id string")
    for dims in ((), REPORT_DIMENSIONS):
        assert report.usage_report(nothing, prices, group_by=dims).count() == 0
    assert tuple(report.report_totals(report.usage_report(nothing, prices)).first()) == (0, 0, 0, 0, 0)
    digest = report.measure_sessions(nothing, prices, ids)
    assert rows(digest, "scope", "session_id", "matched", "tokens") == [
        ("session", "s1", False, 0),
        ("total", None, False, 0),
    ]
    assert rows(report.source_quality_counts(nothing, ids), "source_quality", "facts") == [
        ("first_event_delta", 0),
        ("ok", 0),
    ]


def test_digest(spark, prices):
    made = sample(spark)
    ids = spark.createDataFrame([("s1",), ("s2",), ("nobody",), ("s1",)], "session_id string")
    digest = report.measure_sessions(made, prices, ids)
    sums = {r.session_id: r.tokens for r in digest.filter("scope = 'session'").collect()}
    alone = {s: sum(1000 + i for i in range(240) if i % 7 == int(s[1])) for s in ("s1", "s2")}
    assert sums == {**alone, "nobody": 0}
    assert digest.filter("scope = 'total'").first().tokens == sum(alone.values())
    by_rows = digest.filter("scope = 'session_row'").groupBy("session_id").sum("tokens")
    assert {r[0]: r[1] for r in by_rows.collect()} == alone
    matched = report.sessions_matched(made, ids)
    assert rows(matched, "session_id", "matched") == [("nobody", False), ("s1", True), ("s2", True)]


def test_large_side_is_joined_by_salted_shuffle(spark, prices):
    """The same answer with and without a broadcast, one key holding nearly all rows."""
    big = spark.range(5000).selectExpr("if(id % 50 = 0, id, 1) AS k", "id AS v")
    small = spark.createDataFrame([(1, 10), (1, 20), (50, 30)], "n bigint, w bigint")
    for how in ("inner", "left", "left_semi"):
        condition = None if how == "left_semi" else F.col("v") % 20 >= F.col("w")
        plain = joins.lookup(big, small, {"k": "n"}, how=how, condition=condition, broadcast=True)
        salted = joins.lookup(big, small, {"k": "n"}, how=how, condition=condition, broadcast=False)
        assert rows(plain, *plain.columns) == rows(salted, *plain.columns)


def test_size_check(spark, monkeypatch):
    frame = spark.range(100).selectExpr("repeat('x', 50) AS t")
    assert joins.fits_broadcast(frame)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 99)
    assert not joins.fits_broadcast(frame)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    assert not joins.fits_broadcast(frame)


def test_domain_violations(spark):
    good = ("2026-01-01", "claude", None, "a", "output", 0, "fast")
    made = facts(spark, good, ("2026-01-01", "other", None, "a", "x", -1, None), (None, *good[1:]))
    found = fact_ops.domain_violations(made)
    assert rows(found, "reason") == [
        ("invalid agent",), ("invalid mode",), ("invalid token_kind",), ("missing instant",), ("negative tokens",),
    ]
