"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path``, a verdict and the literal tokens that every match holds
whole. Tokens of rules are counted over all urls; a rule is filed under its rarest token. The tokens of a url
fetch the rules filed under them, and only those run their expression. Of the rules that fit, the one with the
highest priority decides, then the longest name, then the last name, then the last verdict and pattern; without
one, the default verdict.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated urls are
judged once and give equal rows; rules without a literal token are refused, as no token would fetch them, and so are
rules of one name, which a result could not tell apart; an empty table gives an empty result; columns other than page_id and url are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.operators.joins import lookup
from tokenledger.session import written


class Rule(NamedTuple):
    name: str
    pattern: str
    verdict: str
    priority: int
    tokens: list[str]


# A url's tokens, cut out of host and path. A token of a rule has to be such a token as a whole.
TOKEN = r"[A-Za-z0-9]+"

# Fixed values: (verdict, host, path) of the stated rules.
PREFIX_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Tokens of hosts that sell or flood, blocked where no stated rule decides.
BLOCKED_WORDS = ("casino", "farm", "gambling", "lottery", "payday", "pills", "poker", "porn", "torrent", "viagra", "warez", "xxx")


def prefix_rule(verdict: str, host: str, path: str, priority: int = 1) -> Rule:
    """The host and all its subdomains, urls whose path starts with ``path``."""
    whole = re.findall(TOKEN, host)
    # The last token of the path may go on in the url, unless a separator ends it.
    parts = re.findall(rf"{TOKEN}(?=[^A-Za-z0-9])", path)
    pattern = rf"^(?:[^/]*\.)?{java_quote(host)}{java_quote(path)}"
    return Rule(f"{host}{path}", pattern, verdict, priority, [*whole, *parts])


def host_word_rule(word: str) -> Rule:
    """Blocks hosts that have ``word`` between separators."""
    return Rule(f"*{word}*", rf"^(?:[^/]*[^A-Za-z0-9/])?{word}(?:[^A-Za-z0-9]|$)", "block", 0, [word])


def java_quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def default_rules() -> list[Rule]:
    return [*(prefix_rule(*rule) for rule in PREFIX_RULES), *map(host_word_rule, BLOCKED_WORDS)]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; ASCII letters lower-cased; never null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; never null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows; raises on a rule without a token, and on names that are given twice."""
    if bare := [rule.name for rule in rules if not rule.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    if twice := [name for name, n in Counter(rule.name for rule in rules).items() if n > 1]:
        raise ValueError(f"rules of one name: {twice}")
    return spark.createDataFrame(
        rules, "name string, pattern string, rule_verdict string, priority int, tokens array<string>"
    )


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit(f"({TOKEN})"), F.lit(1)))


def indexed(rules: DataFrame, places: DataFrame) -> DataFrame:
    """Rules with the one token each is filed under: the one in the fewest ``place``s, ties by the token."""
    of_rules = rules.select("name", F.explode("tokens").alias("token")).distinct()
    in_urls = places.select(F.explode(tokens_of(F.col("place"))).alias("url_token"))
    used = of_rules.select(F.col("token").alias("url_token")).distinct()
    # Only tokens of rules are counted, and they are counted before they are shuffled.
    counts = in_urls.join(used, "url_token", "left_semi").groupBy("url_token").agg(F.count(F.lit(1)).alias("n"))
    seen = of_rules.join(counts, F.col("token") == F.col("url_token"), "left")
    rarest = seen.groupBy("name").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rarest.join(rules.drop("tokens"), "name")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, the deciding rule and verdict of every page, and how many rules ran for its url."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Each host and path is judged once, however many pages share it.
    places = urls.select(F.concat("host", "path").alias("place")).distinct()
    tokens = places.select("place", F.explode(tokens_of(F.col("place"))).alias("url_token"))
    # Written, as it is measured before it is joined.
    index = written(indexed(rules, places))
    candidates = lookup(tokens, index, {"url_token": "token"}, how="inner")
    fits = F.regexp_like("place", F.col("pattern"))
    rank = F.struct("priority", F.length("name").alias("length"), "name", "rule_verdict", "pattern")
    best = F.max_by(F.struct("name", "rule_verdict"), F.when(fits, rank)).alias("best")
    decided = candidates.groupBy("place").agg(best, F.count(F.lit(1)).alias("n_run"))
    # Both sides are keyed by the place, which hardly repeats: null and malformed urls have no row here.
    joined = urls.withColumn("at", F.concat("host", "path")).join(decided, F.col("at") == F.col("place"), "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
        F.coalesce("n_run", F.lit(0)).alias("n_run"),
    )
