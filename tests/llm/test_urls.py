import random
import re

import pytest

from tests.llm import corpora
from tokenledger.llm import urls

URLS = [
    None,
    "",
    "no scheme",
    "https://Example.ORG/en/12?q",
    "https://a.example.org/es/1",
    "https://example.org",
    "http://x.com/de/1#t",
    "http://xcom/de/1",
    "http://x.com/fr/1://y.org/",
    "http://x.com.evil.net/fr/1",
    "http://blog.cheap-pills.example.net/en/1",
    "http://pillsbury.net/pills/1",
    "http://x.org:80/en/1",
    "http://org/",
    "http://é.org/\n/x",
]


def brute(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (found[1], found[2]) if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h + p), h + p, verdict)
        for verdict, h, p in urls.PREFIX_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    words = re.split("[^A-Za-z0-9]", host)
    return host, path, None, "block" if set(words) & set(urls.BLOCKED_WORDS) else "allow"


def pages(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "page_id long, url string")
    return frame.selectExpr("*", "'x' as host", "'x' as token", "'x' as name", "'x' as verdict", "'x' as place")


def test_equals_brute_force(spark):
    rules = urls.rule_frame(spark, urls.default_rules())
    got = corpora.collected(urls.judged(pages(spark, URLS + URLS), rules), "page_id")
    assert len(got) == 2 * len(URLS)
    for r in got:
        rule = None if str(r["rule"]).startswith("*") else r["rule"]
        assert (r["host"], r["path"], rule, r["verdict"]) == brute((URLS + URLS)[r["page_id"]]), URLS[r["page_id"] % len(URLS)]
    assert urls.judged(pages(spark, URLS).limit(0), rules).count() == 0


def test_only_rules_with_a_token_of_the_url_run(spark):
    rules = urls.rule_frame(spark, urls.default_rules())
    many = ["https://x.com/en/1"] * 50 + ["https://x.com/fr/1"]
    runs = {r["page_id"]: r["n_run"] for r in urls.judged(pages(spark, many), rules).collect()}
    # com/fr/ is filed under its rarer token.
    assert runs[0] == 0 and runs[50] == 1


def test_rules_without_tokens_are_refused(spark):
    with pytest.raises(ValueError, match="literal"):
        urls.rule_frame(spark, [urls.Rule("any", ".*", "block", 1, [])])


def test_rules_of_one_name_are_refused(spark):
    rules = [urls.prefix_rule("allow", "org", "/"), urls.prefix_rule("block", "org", "/")]
    with pytest.raises(ValueError, match="one name"):
        urls.rule_frame(spark, rules)


def test_ties_end_with_the_verdict(spark):
    """Rules of a frame made elsewhere may share a name; the same one decides in any order."""
    rows = [("x.org/", r"^x\.org/", verdict, 1, ["x", "org"]) for verdict in ("allow", "block")]
    for order in (rows, rows[::-1]):
        rules = spark.createDataFrame(order, "name string, pattern string, rule_verdict string, priority int, tokens array<string>")
        assert [r["verdict"] for r in urls.judged(pages(spark, ["http://x.org/a"]), rules).collect()] == ["block"]


def test_thousands_of_rules_and_long_urls(spark):
    """Prefixes, wildcards, ports and single pages, against all of them run on every url."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    hosts = [f"{rng.choice(words)}.{rng.choice(words)}.{rng.choice(['org', 'com', 'net'])}" for _ in range(300)]
    values = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', ':8080'])}/" + "/".join(rng.choices(words, k=rng.randrange(4))) for _ in range(250)]
    values += [f"https://{hosts[0]}/" + "/".join(rng.choices(words, k=20_000)), f"https://{hosts[1]}/a?" + "q" * 100_000]
    rules = {}
    for i in range(3000):
        host, word, other = rng.choice(hosts), rng.choice(words), rng.choice(words)
        verdict = rng.choice(["allow", "block"])
        made = rng.choice([
            urls.prefix_rule(verdict, host, f"/{word}/"),
            urls.prefix_rule(verdict, host.split(".", 1)[1], "/", 0),
            urls.Rule(f"any/{word}/*/{other}", rf"/{word}/(?:.*/)?{other}(?:/|$)", verdict, 2, [word, other]),
            urls.Rule(f"{host}:8080", rf"^{urls.java_quote(host)}:8080/", verdict, 1, [*host.split("."), "8080"]),
            urls.Rule(f"page{i}", rf"^{urls.java_quote(host)}/{word}$", verdict, 3, [*host.split("."), word]),
        ])
        rules.setdefault(made.name, made)
    assert len(rules) > 2000
    compiled = [(rule, re.compile(rule.pattern)) for rule in rules.values()]
    got = corpora.collected(urls.judged(pages(spark, values), urls.rule_frame(spark, list(rules.values()))), "page_id")
    decided = 0
    for r in got:
        place = r["host"] + r["path"]
        fits = [(rule.priority, len(rule.name), rule.name, rule.verdict) for rule, pattern in compiled if pattern.search(place)]
        assert (r["rule"], r["verdict"]) == (max(fits)[2:] if fits else (None, "allow")), values[r["page_id"]][:200]
        decided += bool(fits)
        # A url that has every word fetches every rule.
        assert r["n_run"] < len(rules) / 4 or len(place) > 50_000
    assert decided > 100
