import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import corpora
from tokenledger.llm import packing


def naive(sizes, sources, clusters, capacity):
    """The tightest compatible bin by looking at all of them."""
    bins, placed = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [
            (capacity - used, i)
            for i, (used, s, c) in enumerate(bins)
            if capacity - used >= max(size, 1) and (source is None or source not in s) and (cluster is None or cluster not in c)
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([0, set(), set()])
        placed.append((i, bins[i][0]))
        bins[i][0] += size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return placed


piece = st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4]))


@settings(deadline=None, max_examples=200)
@given(st.lists(piece, max_size=40))
def test_best_fit_equals_naive_search(pieces):
    pieces.sort(key=lambda p: -p[0])
    columns = [list(column) for column in zip(*pieces, strict=True)] or [[], [], []]
    assert packing.best_fit(*columns, 20) == naive(*columns, 20)


def check(pieces, docs, capacity):
    """No bin is overfull, overlaps or holds a conflict, and every token is in one piece."""
    sources = {i: source for i, _, source in docs}
    tokens, bins = defaultdict(int), defaultdict(list)
    for p in pieces:
        tokens[p["doc_id"]] += p["n_tokens"]
        if p["bin_id"] is not None:
            bins[p["bin_id"]].append(p)
    assert tokens == {i: len((text or "").split()) for i, text, _ in docs}
    for held in bins.values():
        held.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in held] == [sum(q["n_tokens"] for q in held[:i]) for i in range(len(held))]
        assert sum(p["n_tokens"] for p in held) <= capacity
        own = [sources[p["doc_id"]] for p in held if sources[p["doc_id"]] is not None]
        assert len(own) == len(set(own))
    return bins


def test_bins_of_many_groups(spark):
    rng = random.Random(6)
    docs = [(i, corpora.prose(i % 70, rng.randrange(0, 90)) or None, rng.choice([None, "hot", "hot", f"s{i % 40}"])) for i in range(500)]
    frame = corpora.documents(spark, *docs)
    whole = check(corpora.collected(packing.packed(frame, capacity=64)), docs, 64)
    split = check(corpora.collected(packing.packed(frame, capacity=64, group_rows=50)), docs, 64)
    assert len(whole) <= len(split)


def test_groups_of_distinct_rows_are_packed_whole(spark):
    rng = random.Random(7)
    docs = [(i, corpora.prose(i, rng.randrange(1, 60)), rng.choice([None, f"s{i % 90}"])) for i in range(1500)]
    groups = defaultdict(list)
    sources = {i: source for i, _, source in docs}
    for p in packing.packed(corpora.documents(spark, *docs), capacity=64, group_rows=100).collect():
        groups[p["bin_id"] >> 32].append((p["doc_id"], p["n_tokens"], p["bin_id"] & 0xFFFFFFFF, p["offset"]))
    assert max(len(rows) for rows in groups.values()) > 100
    for rows in groups.values():
        rows.sort(key=lambda r: (-r[1], r[0]))
        columns = [r[1] for r in rows], [sources[r[0]] for r in rows], [None] * len(rows)
        assert [r[2:] for r in rows] == naive(*columns, 64)


def test_named_clusters_conflict(spark):
    docs = corpora.documents(spark, *((i, corpora.prose(i, 10), None) for i in range(6))).selectExpr("*", "doc_id % 3 as c")
    bins = defaultdict(list)
    for p in packing.packed(docs, capacity=100, cluster="c").collect():
        bins[p["bin_id"]].append(p["doc_id"] % 3)
    assert sorted(sorted(held) for held in bins.values()) == [[0, 1, 2], [0, 1, 2]]


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    got = corpora.collected(packing.packed(docs, capacity=1000))
    assert sum(p["n_tokens"] for p in got) == sum(len((r["text"] or "").encode().split()) for r in docs.collect())
    assert [p["bin_id"] for p in got if p["doc_id"] in (1, 2, 3)] == [None] * 3
    assert len([p for p in got if p["doc_id"] == 6]) == 60
    # A group that equal rows make too large is packed in runs.
    same = corpora.documents(spark, *[(1, "a b c", None)] * 50)
    assert len(corpora.collected(packing.packed(same, group_rows=20))) == 50
    assert packing.packed(corpora.empty(spark)).count() == 0
