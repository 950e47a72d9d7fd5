"""Quality rules: failures are counted by host, shrunk by an empirical beta prior, and judge documents.

A document fails rules of its own (too short, too repetitive, too many symbols, too many repeated lines).
Failures are added up per host and rule. A host's rate is shrunk towards all hosts by a beta prior fitted to
the hosts' rates by moments, so a host with few documents is judged like the rest and not by its few. A host
whose shrunk rate of any rule is over ``max_rate`` is rejected, and its verdict goes back to its documents.

Defined cases: a null or empty text has no words and is too short; a null source counts as the host ``''``;
rows are judged one by one, so repeated rows stay repeated; an empty table gives an empty result; columns
other than doc_id, text and source are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import blank_words, computed
from tokenledger.operators.joins import fits_broadcast, lookup
from tokenledger.session import written

RULES = ("short", "repeats", "symbols", "lines")
# A host is rejected when the shrunk rate of a rule is over this.
MAX_RATE = 0.5
# Bounds of the prior's weight in documents: few hosts, or hosts all alike, say little about the spread.
MIN_WEIGHT, MAX_WEIGHT = 10.0, 10_000.0

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
# All bytes that are no first byte of a character, and white space.
_NO_CHARACTER = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\f"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur at least twice, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW - max(at, end)
            end = at + WINDOW
    return total


def measure(data: bytes | None) -> dict[str, int]:
    data = data or b""
    words = blank_words(data)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return {
        "n_words": len(words),
        "word_chars": len(data.translate(None, _NO_CHARACTER)),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


_COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measures_of(text: Column) -> Column:
    """A struct of counts per row."""
    return computed(measure, _COUNTS, text.cast("binary"))


def with_failures(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "fails_short": F.col("n_words") < 10,
            "fails_repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
            "fails_symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
            "fails_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        }
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, the counts of each document and a flag ``fails_<rule>`` for each rule."""
    host = F.coalesce(F.col("source"), F.lit("")).alias("host")
    counts = docs.select("doc_id", host, measures_of(F.col("text")).alias("counts"))
    return with_failures(counts.select("doc_id", "host", "counts.*"))


def host_rates(measures: DataFrame) -> DataFrame:
    """host, rule, n_docs, n_failed and the rate shrunk by the beta prior of the rule."""
    per_host = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(F.col(f"fails_{rule}").cast("long")).alias(rule) for rule in RULES),
    )
    pairs = ", ".join(f"'{rule}', {rule}" for rule in RULES)
    long = per_host.select("host", "n_docs", F.expr(f"stack({len(RULES)}, {pairs}) as (rule, n_failed)"))
    # The spread of the hosts' rates beyond what their document counts explain gives the prior's weight.
    rate = F.col("n_failed") / F.col("n_docs")
    moments = long.groupBy("rule").agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.var_pop(rate).alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("inverse_docs"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    excess = F.col("spread") - noise * F.col("inverse_docs")
    weight = F.when(excess > 0, noise / excess - 1).otherwise(MAX_WEIGHT)
    priors = moments.select(
        F.col("rule").alias("prior_rule"),
        "mean",
        F.least(F.greatest(weight, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT)).alias("weight"),
    )
    # The prior frame has one row per rule, a fixed number.
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return long.join(F.broadcast(priors), F.col("rule") == F.col("prior_rule")).select(
        "host", "rule", "n_docs", "n_failed", shrunk.alias("rate")
    )


def host_verdicts(rates: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: its worst shrunk rate and whether it is rejected."""
    return rates.groupBy("host").agg(F.max("rate").alias("host_rate")).withColumn(
        "host_rejected", F.col("host_rate") > max_rate
    )


def judged(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Counts and verdict of every document. The texts are read once; counts are written for both readers."""
    measures = written(measured(docs))
    hosts = written(host_verdicts(host_rates(measures), max_rate).withColumnRenamed("host", "verdict_host"))
    base_failed = F.col("fails_short") | F.col("fails_repeats")
    # Hosts measured to be few go to all tasks; for more, documents of a hot host are spread over salted keys.
    return lookup(measures, hosts, {"host": "verdict_host"}).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~F.col("host_rejected")).alias("kept"),
    )


def filtered(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that are kept, all columns as they are. Only the hosts' verdicts are written."""
    hosts = written(host_verdicts(host_rates(measured(docs)), max_rate).filter("host_rejected").select("host"))
    counts = measures_of(F.col("text"))
    passing = docs.filter((counts["n_words"] >= 10) & (100 * counts["n_repeat_words"] <= 20 * counts["n_words"]))
    small = F.broadcast(hosts) if fits_broadcast(hosts) else hosts
    # Too many hosts for that are shuffled, and adaptive execution splits a hot one, as no task needs all of it.
    return passing.join(small, F.coalesce(passing["source"], F.lit("")) == small["host"], "left_anti")
