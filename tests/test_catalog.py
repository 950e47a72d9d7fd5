import hashlib

import pytest
from pyspark.sql import functions as F
from tests.helpers import catalog, document, facts, period, rows

from tokenledger.operators import integrity, pricing
from tokenledger.plans.usage import load_catalog
from tokenledger.sources import catalog as catalogs

OLD = period("a-1", "2026-01-01T00:00:00Z", "2026-06-01T00:00:00Z", input_nocache="1.0", output="2.0")
NEW = period("a-2", "2026-06-01", None, input_nocache="3.0", output=None)
A = {"model_key": "a", "aliases": ["a-alias"], "fast_multiplier": "2.5", "rates": [OLD, NEW]}


def test_document_file(spark, tmp_path):
    path = tmp_path / "rates.json"
    path.write_text(document(A))
    read = load_catalog(spark, str(path))
    header = read.headers.first()
    assert header.sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    assert (header.catalog_version, header.usd_per_credit) == ("v-test", "0.04")
    assert read.models.count() == 1 and read.rates.count() == 10
    priced = read.rates.filter("usd_per_mtok IS NOT NULL")
    assert rows(priced, "rate_id", "rate_field") == [("a-1", "input_nocache"), ("a-1", "output"), ("a-2", "input_nocache")]


def test_invalid_documents_are_refused(spark, tmp_path):
    path = tmp_path / "rates.json"
    path.write_text(document(A, A))
    with pytest.raises(Exception, match="duplicate model: 1, such as a"):
        load_catalog(spark, str(path))
    path.write_text("{broken")
    with pytest.raises(Exception):
        load_catalog(spark, str(path))


def test_period_lookup(spark):
    moments = {
        "2025-12-31 23:59:59": None,
        "2026-01-01 00:00:00": "a-1",
        "2026-05-31 23:59:59.999999": "a-1",
        "2026-06-01 00:00:00": "a-2",
        "2030-01-01 00:00:00": "a-2",
    }
    made = [(at, "claude", "s", name, "output", 1, "normal") for at in moments for name in ("a", "a-alias", "z")]
    found = pricing.lookup_period(facts(spark, *made), catalog(spark, A)).select(
        F.date_format("occurred_at_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "model_key", "resolved_key", "rate_id"
    )
    for row in found.collect():
        expected = next(v for k, v in moments.items() if row.at.startswith(k) and len(k) in (19, 26))
        known = row.model_key != "z"
        assert (row.resolved_key, row.rate_id) == (("a", expected) if known else (None, None))


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"catalog_version": ""}, "missing catalog_version"),
        ({"schema_version": "2"}, "unsupported schema_version"),
        ({"schema_version": None}, "unsupported schema_version"),
        ({"currency": "EUR"}, "unsupported currency"),
        ({"unit": "per_ktok"}, "unsupported unit"),
    ],
)
def test_header(spark, change, reason):
    found = integrity.header_violations(catalog(spark, A, **change).headers)
    assert rows(found, "reason") == [(reason,)]


def entry(key="a", aliases=(), rates=(OLD, NEW), **more):
    return {"model_key": key, "aliases": list(aliases), "rates": list(rates), **more}


def rules(spark, *models):
    return rows(integrity.violations(catalog(spark, *models)), "rule", "subject")


def test_valid_catalogs(spark):
    assert rules(spark, A, entry("b", fast_multiplier=None, rates=[])) == []
    closed = period("a-3", "2026-06-01T00:00:00+00:00", "2026-07-01T00:00:00")
    assert rules(spark, entry(rates=[closed, OLD])) == []


def test_each_violation(spark):
    late = period("a-9", "2026-05-31T23:00:00Z", None)
    cases = [
        ([entry(None)], ("missing field", "- - missing model_key")),
        ([entry(rates=[{**OLD, "rate_id": None}])], ("missing field", "a - missing rate_id")),
        ([entry(rates=[{"rate_id": "x"}])], ("missing field", "a x missing effective_from")),
        ([entry(), entry()], ("duplicate model", "a")),
        ([entry(aliases=["a"])], ("alias collision", "a a")),
        ([entry(aliases=["b"]), entry("b")], ("alias collision", "a b")),
        ([entry(aliases=["x"]), entry("b", ["x"])], ("duplicate alias", "x")),
        ([entry(rates=[{**OLD, "output": "-1"}])], ("value", "a a-1 output negative")),
        ([entry(rates=[{**OLD, "output": "abc"}])], ("value", "a a-1 output not a decimal")),
        ([entry(rates=[{**OLD, "output": "0.0000000001"}])], ("value", "a a-1 output too fine")),
        ([entry(rates=[{**OLD, "output": "1e9"}])], ("value", "a a-1 output too large")),
        ([entry(rates=[{**OLD, "output": "NaN"}])], ("value", "a a-1 output not a decimal")),
        ([entry(fast_multiplier="1.0000001")], ("value", "a - fast_multiplier too fine")),
        ([entry(rates=[{**OLD, "output": "10000000"}])], ("value", "a a-1 output too large per token")),
        ([entry(rates=[{**OLD, "output": "0.123456789"}], fast_multiplier="1.125")], ("value", "a a-1 output too fine per token")),
        ([entry(rates=[{**OLD, "output": "900000"}], fast_multiplier="900000")], ("value", "a a-1 output too large per token")),
        ([entry(fast_multiplier="-2")], ("value", "a - fast_multiplier negative")),
        ([entry(credits_per_mtok={"output": "-3"})], ("value", "a - credits.output negative")),
        ([entry(rates=[{**OLD, "effective_from": "soon"}])], ("period bounds", "a a-1 unreadable effective_from")),
        ([entry(rates=[{**OLD, "effective_until": "2026-01-01"}])], ("period bounds", "a a-1 ends before it starts")),
        ([entry(rates=[late, OLD])], ("period overlap", "a a-1 a-9")),
        ([entry(rates=[NEW, period("a-3", "2027-01-01", None)])], ("period overlap", "a a-2 a-3")),
    ]
    for models, expected in cases:
        found = rules(spark, *models)
        assert expected in found, (expected, found)


def test_overlap_with_very_many_periods(spark):
    """One model with most periods; every hundredth starts a day before the one before it ends."""
    stamp = "date_format(timestamp '1970-01-01' + make_dt_interval({}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    made = spark.range(3000).selectExpr(
        "'c' AS catalog_id",
        f"""to_json(named_struct('model_key', 'hot', 'rates', array(named_struct(
          'rate_id', concat('r', id), 'effective_from', {stamp.format('int(id) * 10 - if(id % 100 = 99, 1, 0)')},
          'effective_until', {stamp.format('int(id) * 10 + 10')})))) AS entry""",
    )
    periods = catalogs.Catalog(None, catalogs.entries_from_lines(made))
    found = rows(integrity.period_overlaps(periods), "first_rate_id", "second_rate_id")
    assert found == sorted((f"r{i - 1}", f"r{i}") for i in range(99, 3000, 100))


def test_wide_and_fine_prices_are_exact(spark):
    prices = {"output": "2000000", "input_nocache": "0.123456789", "cache_read": "5"}
    made = catalog(spark, entry(fast_multiplier="1.125", rates=[period("r", "2020-01-01", None, output="2000000", cache_read="5")]),
                   entry("b", rates=[period("s", "2020-01-01", None, **prices)]))
    assert rows(integrity.violations(made), "rule") == []
    used = [("2026-01-01", "claude", "s", m, k, 1_000_000, mode) for m, k, mode in (
        ("a", "output", "normal"), ("a", "cache_read", "fast"), ("b", "input_nocache", "normal"))]
    priced = pricing.price_facts(facts(spark, *used), made)
    assert [str(c[0].normalize()) for c in rows(priced, "estimated_cost_usd")] == ["0.123456789", "5.625", "2E+6"]


@pytest.mark.parametrize("written, multiplier", [("1e9", None), ("0.0000000001", None), ("abc", None), ("900000", "900000")])
def test_inexact_prices_fail_instead_of_being_unpriced(spark, written, multiplier):
    made = catalog(spark, entry(fast_multiplier=multiplier, rates=[period("r", "2020-01-01", None, output=written)]))
    with pytest.raises(Exception, match="no exact"):
        pricing.price_facts(facts(spark, ("2026-01-01", "claude", "s", "a", "output", 1, "fast")), made).collect()


def test_credits_match_prices(spark):
    good = entry(credits_per_mtok={"input_nocache": "25", "output": "50"}, rates=[OLD])
    bad = entry("b", credits_per_mtok={"input_nocache": "30"}, rates=[OLD])
    found = integrity.credit_inconsistencies(catalog(spark, good, bad))
    assert rows(found, "model_key", "rate_field") == [("b", "input_nocache")]


def test_summary_and_history(spark):
    made = catalog(spark, entry("b"), A)
    assert rows(integrity.catalog_summary(made), "model_count", "model_key") == [(2, "a"), (2, "b")]
    assert rows(integrity.catalog_summary(catalog(spark)), "model_count", "model_key") == [(0, None)]
    names = spark.createDataFrame([("a-alias",), ("unknown",)], "queried string")
    history = integrity.rate_history(made, names).filter("rate_field = 'output'")
    assert rows(history, "model_key", "rate_id", "effective_until", "price") == [
        ("a", "a-1", "2026-06-01T00:00:00Z", "2.0"),
        ("a", "a-2", "(open)", "(unpriced)"),
    ]
