import difflib
import itertools
import random

from hypothesis import given
from hypothesis import strategies as st

from tests.llm import corpora
from tokenledger.llm import licenses


def scan(text, minimum=licenses.MIN_COVERAGE):
    given_ = tuple(licenses.TEMPLATES.items())
    return licenses.scan(text.encode(), licenses.prepared(given_, minimum), minimum)


@given(st.lists(st.integers(0, 30), unique=True, max_size=12))
def test_rising_is_a_longest_subsequence(values):
    pairs = list(enumerate(values))
    got = licenses.rising(pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(got))
    longest = max(
        len(c)
        for n in range(len(pairs) + 1)
        for c in itertools.combinations(pairs, n)
        if all(a[1] < b[1] for a, b in itertools.pairwise(c))
    )
    assert len(got) == longest


words = st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=14)


@given(words, words)
def test_alignment_rises_and_matches_equal_words(text, template):
    got = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in got)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(got))


@given(st.lists(st.integers(), unique=True, max_size=25), st.randoms())
def test_unique_words_are_aligned_as_well_as_can_be(template, rng):
    # With all words unique, patience alignment finds a longest common subsequence.
    text = [w for w in template if rng.random() < 0.8]
    rng.shuffle(text) if rng.random() < 0.3 else None
    best = [[0] * (len(template) + 1) for _ in range(len(text) + 1)]
    for i, x in enumerate(text):
        for j, y in enumerate(template):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    got = licenses.align([b"%d" % w for w in text], [b"%d" % w for w in template])
    assert len(got) == best[-1][-1] or not text or not template


def test_notices_are_found_where_they_are():
    for name, notice in licenses.TEMPLATES.items():
        text = f"{corpora.prose(1, 300)}\nÉ {notice}\n{corpora.prose(2, 300)}"
        found = scan(text)
        assert found[0]["license"] == name and found[0]["coverage"] == 1.0
        cut = text[found[0]["start"] : found[0]["end"]]
        assert difflib.SequenceMatcher(None, cut, notice).ratio() > 0.95


def test_changed_and_repeated_notices():
    text = corpora.prose(3, 50)
    assert scan(f"{text} Licensed under THE Apache-License version 2.0 {text}")[0]["license"] == "Apache-2.0"
    twice = "Released under the MIT License."
    assert [f["license"] for f in scan(f"{twice} {text} {twice}\n{twice}")] == ["MIT"]
    assert scan(f"the license of {text} was released under a cloud") == []
    assert scan("") == []


def test_notices_that_follow_each_other_are_found():
    for name, notice in licenses.TEMPLATES.items():
        size = len(notice.split())
        for copies in (2, 3, 5):
            for between in (0, 1, 3, size // 2, size, 2 * size):
                text = f"\n{corpora.prose(6, between)} ".join([notice] * copies)
                for before, behind in ((40, 40), (0, 40), (300, 0)):
                    whole = f"{corpora.prose(4, before)} {text} {corpora.prose(5, behind)}"
                    found = {f["license"]: f for f in scan(whole)}
                    assert found[name]["coverage"] == 1.0, (name, copies, between)
                    cut = whole[found[name]["start"] : found[name]["end"]]
                    assert cut.split()[0].strip('("') == notice.split()[0]


def test_changed_notices_that_follow_each_other_are_found():
    rng = random.Random(12)
    for name, notice in licenses.TEMPLATES.items():
        words_ = notice.split()
        for _ in range(100):
            changed = list(words_)
            for _ in range(rng.randrange(1, 1 + max(1, len(words_) // 10))):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], ["other"], [changed[at], "more"]])
            prose, one = corpora.prose(7, 60), " ".join(changed)
            alone = {f["license"]: f["coverage"] for f in scan(f"{prose} {one} {prose}")}
            twice = {f["license"]: f["coverage"] for f in scan(f"{prose} {one} {one} {prose}")}
            assert name not in alone or twice.get(name, 0) >= licenses.MIN_COVERAGE, one


def test_probe_words_lose_no_covered_notice():
    rng = random.Random(9)
    given_ = tuple(licenses.TEMPLATES.items())
    for template in licenses.prepared(given_, licenses.MIN_COVERAGE):
        for _ in range(200):
            keep = -(-len(template.words) * 8 // 10)
            left = rng.sample(template.words, keep)
            assert template.probes & set(left)


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    got = corpora.collected(licenses.scanned(docs))
    assert len(got) == 13 and all(r["license"] is None for r in got)
    assert licenses.scanned(corpora.empty(spark)).count() == 0
