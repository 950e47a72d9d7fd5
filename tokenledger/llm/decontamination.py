"""Benchmark decontamination: one Aho-Corasick automaton over all windows of test items, one scan per text.

Texts and items become lower-cased words (letters, digits and all characters outside ASCII) with single spaces
between them. Ten consecutive words of an item are a window; an item with fewer, but some, is one window. The
automaton holds every window between spaces, so matches are whole words. Words inside a match are hit, and
their places are mapped back to the original text.

The automaton goes to every task, so its size is bounded: windows are divided into parts of at most
``MAX_PATTERN_BYTES``, and the texts pass one automaton after the other, nearly always a single one.

Defined cases: null and empty texts and items have no words and no windows; repeated items are one item per
item_id; an item without an id marks words but is not listed; repeated documents are scanned as rows; empty
tables give an empty result or no hits; columns other than doc_id, text and item_id, text are not read, and
``without_hits`` keeps all columns of its input.
"""

from __future__ import annotations

import re
from typing import Any

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import alnum_words, computed, mapped, utf8

WINDOW = 10
# Bytes of distinct windows in one automaton, about a fiftieth of what it takes in memory.
MAX_PATTERN_BYTES = 8 * 1024 * 1024

# A word in the original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def windows_of(data: bytes | None) -> set[str]:
    words = [word.decode("latin-1") for word in alnum_words(data)]
    if not words:
        return set()
    return {" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))}


def _windows(rows: dict[str, list]) -> dict[str, list]:
    pairs = [(window, item) for item, data in zip(rows["item_id"], rows["data"], strict=True) for window in windows_of(data)]
    return {"window": [w for w, _ in pairs], "item_id": [i for _, i in pairs]}


def pattern_parts(benchmark: DataFrame) -> list[list[tuple[str, list[Any]]]]:
    """Windows with the items that hold them, in parts of bounded size."""
    found = mapped(
        benchmark,
        {"item_id": F.col("item_id").cast("string"), "data": utf8()},
        _windows,
        "window string, item_id string",
    )
    grouped = found.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    # One row at a time: the driver holds the part it builds and those it has built, each a bounded broadcast.
    parts: list[list[tuple[str, list[Any]]]] = [[]]
    size = 0
    for row in grouped.toLocalIterator():
        if size > MAX_PATTERN_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((row["window"], row["items"]))
        size += len(row["window"]) + sum(map(len, row["items"]))
    return parts


class Windows:
    """One part of the windows. The automaton is built once per worker process, not sent."""

    def __init__(self, patterns: list[tuple[str, list[Any]]]):
        self.patterns = patterns
        self.built: ahocorasick.Automaton | None = None

    def automaton(self) -> ahocorasick.Automaton:
        if self.built is None:
            self.built = ahocorasick.Automaton()
            for window, items in self.patterns:
                self.built.add_word(f" {window} ", (window.count(" ") + 1, len(window), items))
            self.built.make_automaton()
        return self.built

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words (first, end) and the ids of the items found."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.patterns or not words:
            return ranges, items
        text = f" {b' '.join(words).decode('latin-1')} "
        starts = None
        for end, (n_words, length, ids) in self.automaton().iter(text):
            if starts is None:
                starts = np.cumsum([1, *(len(word) + 1 for word in words)])
            # A match ends with the space behind its last word.
            first = int(np.searchsorted(starts, end - length))
            ranges.append((first, first + n_words))
            items.update(ids)
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def spans_of(data: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code points of the original text from the first to the last word of each range."""
    places = [match.span() for match in _WORD.finditer(data.decode("utf-8", "surrogateescape"))]
    return [{"start": places[first][0], "end": places[end - 1][1]} for first, end in ranges]


_RANGES = "array<struct<start: long, end: long>>"
_FOUND = f"n_words: long, ranges: {_RANGES}, items: array<string>, spans: {_RANGES}"


def found_in(text: Column, benchmark: DataFrame) -> Column:
    """A struct per row: n_words, hit words as ranges and as spans of the original text, and the items found."""
    context = benchmark.sparkSession.sparkContext
    found = F.lit(None).cast(f"struct<{_FOUND}>")
    for part in pattern_parts(benchmark):
        sent = context.broadcast(Windows(part))

        def scan(data: bytes | None, before: dict | None, sent=sent) -> dict:
            words = alnum_words(data)
            ranges, items = sent.value.hits(words)
            if before:
                ranges += [(r["start"], r["end"]) for r in before["ranges"]]
                items.update(before["items"])
            ranges = merged(ranges)
            return {
                "n_words": len(words),
                "ranges": [{"start": first, "end": end} for first, end in ranges],
                "items": sorted(items),
                "spans": spans_of(data, ranges) if ranges else [],
            }

        found = computed(scan, _FOUND, text.cast("binary"), found)
    return found


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and what was found in it, for every row."""
    found = docs.select("doc_id", found_in(F.col("text"), benchmark).alias("found"))
    return found.select("doc_id", "found.*")


def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, all columns kept."""
    return docs.filter(F.size(found_in(F.col("text"), benchmark)["ranges"]) == 0)


def digests(found: DataFrame) -> DataFrame:
    """Counts of hit words and items, and a digest of the sorted item ids."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
