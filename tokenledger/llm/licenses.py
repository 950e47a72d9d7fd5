"""License scans: patience alignment of texts with license notices.

Words that occur once in a stretch of text and once in a template are anchors. The longest subsequence of
anchors that rises in both is kept, and the gaps between its neighbours are aligned in the same way; where a
gap has no anchors, equal words at its two ends are matched. Coverage is the matched part of the template.

A template can only be covered to ``MIN_COVERAGE`` if the text has one of its probe words, those of more
positions than may go unmatched, so only stretches around probe words are aligned. The probe words are those
with the fewest occurrences over all templates and, among these, the longest. A stretch reaches as far as a
covered notice around its probe word can. Where notices follow each other closely it holds several, whose words
are no anchors; so if it has the words to cover more than was matched, narrower stretches are aligned, too: the
probe word stands at each of its places in the template, and slacks of several widths are left before and behind.

Defined cases: null and empty texts match nothing; of templates with equal coverage in a text the one with more
matched words is named, then the first in order; repeated rows are rows; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import cache
from itertools import product
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import alnum_words, computed

# Part of a template's words that has to be matched.
MIN_COVERAGE = 0.8
# A covered notice may have this many times the template's words between its first and last match.
STRETCH = 2

# Notices by which texts state their license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first place, whose second places rise (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, second) in enumerate(pairs):
        pile = bisect_left(tops, second)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(second)
            at.append(i)
        else:
            tops[pile], at[pile] = second, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, rising in both."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {text[i]: i for i in range(a, b) if in_text[text[i]] == 1}
        once = [(place[template[j]], j) for j in range(c, d) if in_template[template[j]] == 1 and template[j] in place]
        anchors = [(i, j) for j, i in rising([(j, i) for i, j in once])]
        if anchors:
            matched += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


class Template(NamedTuple):
    name: str
    words: list[bytes]
    probes: frozenset[bytes]
    # How many of each word, and how many words a narrower stretch leaves for others on one side.
    counts: Counter[bytes]
    slacks: list[int]


@cache
def prepared(templates: tuple[tuple[str, str], ...], min_coverage: float) -> tuple[Template, ...]:
    words = {name: alnum_words(text.encode()) for name, text in templates}
    used = Counter(word for own in words.values() for word in set(own))
    out = []
    for name, own in words.items():
        may_miss = len(own) - -(-len(own) * min_coverage // 1)
        probes: set[bytes] = set()
        for word in sorted(set(own), key=lambda w: (used[w], -len(w), w)):
            if sum(w in probes for w in own) > may_miss:
                break
            probes.add(word)
        slacks, slack = [0], max(1, int(may_miss))
        while slack <= len(own):
            slacks.append(slack)
            slack *= 2
        out.append(Template(name, own, frozenset(probes), Counter(own), slacks))
    return tuple(out)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def narrower(words: list[bytes], at: int, template: Template, least: int) -> tuple[int, list[tuple[int, int]]]:
    """The narrower stretch around the probe word at ``at`` that matches most, at least ``least`` words: where it
    begins, and its matches."""
    size, best = len(template.words), (at, [])
    for before, behind in sorted(product(template.slacks, repeat=2), key=sum):
        for place, word in enumerate(template.words):
            first, last = at - place - before, at - place + size + behind
            if word != words[at]:
                continue
            stretch = words[max(0, first) : last]
            # No more can match than the stretch has of the template's words.
            if (Counter(stretch) & template.counts).total() < least:
                continue
            matched = align(stretch, template.words)
            if len(matched) >= least:
                best, least = (max(0, first), matched), len(matched) + 1
            if least > size:
                return best
    return best


def scan(data: bytes | None, templates: tuple[Template, ...], min_coverage: float) -> list[dict]:
    """Every template that is covered, with its best stretch as words and as code points of the text."""
    words = alnum_words(data)
    present = set(words)
    found = []
    for order, template in enumerate(templates):
        if template.probes.isdisjoint(present):
            continue
        size, best = len(template.words), None
        end = -1
        for at, word in enumerate(words):
            # Stretches around neighbouring probe words are the same notice as long as they lie in the last one.
            if word not in template.probes or at < end:
                continue
            first = max(0, at - STRETCH * size)
            stretch = words[first : at + STRETCH * size]
            matched = align(stretch, template.words)
            least = max(len(matched) + 1, ceil(min_coverage * size))
            if least <= size and (Counter(stretch) & template.counts).total() >= least:
                start, narrow = narrower(words, at, template, least)
                if narrow:
                    first, matched = start, narrow
            if not best or len(matched) > len(best):
                best = [(first + i, j) for i, j in matched]
            if len(matched) >= min_coverage * size:
                end = first + matched[-1][0] + 1
        if best and len(best) >= min_coverage * size:
            found.append((len(best) / size, len(best), -order, template.name, best[0][0], best[-1][0]))
    if not found:
        return []
    places = [match.span() for match in _WORD.finditer(data.decode("utf-8", "surrogateescape"))]
    return [
        {"license": name, "coverage": coverage, "start": places[first][0], "end": places[last][1]}
        for coverage, _, _, name, first, last in sorted(found, reverse=True)
    ]


_FOUND = "licenses array<struct<license: string, coverage: double, start: long, end: long>>"


def licenses_in(text: Column, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> Column:
    """Per row an array of covered licenses, best first."""
    given = tuple(templates.items())

    def over(data: bytes | None) -> dict:
        return {"licenses": scan(data, prepared(given, min_coverage), min_coverage)}

    return computed(over, _FOUND, text.cast("binary"))["licenses"]


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, the best license, its coverage and place, and all covered licenses by name."""
    found = docs.select("doc_id", licenses_in(F.col("text"), templates, min_coverage).alias("licenses"))
    best = F.get("licenses", F.lit(0))
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        best["coverage"].alias("coverage"),
        best["start"].alias("start"),
        best["end"].alias("end"),
        F.array_join(F.col("licenses.license"), ",").alias("licenses"),
    )
