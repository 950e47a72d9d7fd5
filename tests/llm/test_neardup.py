import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import corpora
from tokenledger.llm import components, neardup


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, percent):
    """Component ids by comparing all pairs."""
    sets = {i: shingle_set(text) for i, text in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(8)
    docs, base = [], [corpora.prose(i, 120).split() for i in range(4)]
    for i in range(240):
        words = list(base[i % 4])
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
        docs.append((1000 - i, " ".join(words)))
    shared = corpora.prose(77, 60)
    docs += [(2000 + i, f"{shared} {corpora.prose(500 + i, 60)}") for i in range(40)]
    docs += [(3000 + i, shared.upper()) for i in range(20)]
    docs += [(4000, "a b"), (4001, "A  b"), (4002, "a b c"), (4003, None), (4004, " \n")]
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_all_pairs(spark, percent):
    docs = corpus()
    got = corpora.collected(neardup.grouped(corpora.documents(spark, *docs), percent))
    expected = brute(docs, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(text)) for i, text in docs}


def test_blocks_of_a_bucket_are_all_compared(spark, monkeypatch):
    # Few sketches at once, so that buckets are divided into many pairs of blocks.
    monkeypatch.setattr(neardup, "BLOCK", 7)
    docs = corpus()
    got = neardup.grouped(corpora.documents(spark, *docs), 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(docs, 85)


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(1)
    for n in (40, 400, 1500, 20_000):
        for similarity in (0.7, 0.85, 0.95):
            common = int(n * 2 * similarity / (1 + similarity))
            both = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
            x, y = np.unique(both[:n]), np.unique(both[n - common :])
            (a, k), (b, m) = neardup.odd_sketch(x), neardup.odd_sketch(y)
            differ = int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
            could = neardup.could_link(np.array([differ]), np.array([k + m]), np.array([len(x) + len(y)]), 0.85)[0]
            assert could == (similarity > 0.8), (n, similarity)


def pairs_of_sets(rng, union, similarity, n):
    """Sets at the similarity or just over it, by the shingles of their union."""
    common = -(-union * round(similarity * 100) // 100)
    for _ in range(n):
        both = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
        own = common + (union - common) // 2
        yield np.sort(both[:own]), np.sort(np.concatenate([both[:common], both[own:]]))


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_lose_no_links(percent):
    rng = np.random.default_rng(percent)
    for similarity in (percent / 100, 0.9):
        for union in (5, 10, 20, 40, 100, 200, 300, 1000, 2200, 2400, 3000, 6000):
            rows = []
            for x, y in pairs_of_sets(rng, union, similarity, 2000 if union <= 1000 else 400):
                (a, k), (b, m) = neardup.sketches(x), neardup.sketches(y)
                rows.append((a, b, k + m, len(x) + len(y)))
            one, two = (np.frombuffer(b"".join(r[i] for r in rows), np.uint64).reshape(len(rows), -1) for i in (0, 1))
            sums = (np.array([r[i] for r in rows]) for i in (2, 3))
            assert neardup.passing(one, two, *sums, percent / 100).all(), (similarity, union)


@pytest.mark.parametrize("union", [40, 160, 640, 2560, 5120])
def test_samples_decide_at_every_size(union):
    """The odd sketch of samples alone drops what is clearly below the threshold and keeps what is at it."""
    rng = np.random.default_rng(union)
    for similarity, kept in ((0.65, 0.0), (0.8, 1.0)):
        got = []
        for x, y in pairs_of_sets(rng, union, similarity, 150):
            (a, k), (b, m) = neardup.odd_sketch(x), neardup.odd_sketch(y)
            differ = int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
            reached = len(set((x >> np.uint64(54)).tolist()) | set((y >> np.uint64(54)).tolist()))
            got.append(neardup.could_link(*(np.array([v]) for v in (differ, k + m, len(x) + len(y))), 0.8, np.array([reached]))[0])
        assert np.mean(got) == kept


def short_pairs(percent, n, per_union=(10, 21, 45)):
    """Texts in pairs just at the threshold or over it, in a few distinct shingles."""
    docs = []
    for i in range(n):
        union = per_union[i % len(per_union)]
        common = -(-union * percent // 100)
        own = (union - common) // 2
        # Words of a shared middle make common shingles; words put before or behind it make own ones.
        middle = [f"m{i}x{j}" for j in range(common + 4)]
        docs.append((2 * i, " ".join([f"a{i}x{j}" for j in range(own)] + middle)))
        docs.append((2 * i + 1, " ".join(middle + [f"b{i}x{j}" for j in range(union - common - own)])))
    return docs


def test_short_texts_at_the_threshold_are_linked(spark):
    docs = short_pairs(85, 600, (20, 40, 100))
    sets = {i: shingle_set(text) for i, text in docs}
    assert all(100 * len(sets[i] & sets[i + 1]) >= 85 * len(sets[i] | sets[i + 1]) for i in range(0, 1200, 2))
    got = neardup.grouped(corpora.documents(spark, *docs), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i, _ in docs}


def test_bands_meet_as_often_as_they_should():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 230, dtype=np.uint64) * np.uint64(2)
        x, y = np.unique(both[:210]), np.unique(both[20:])
        met += int((neardup.bands_of(x) == neardup.bands_of(y)).sum())
    similarity = 190 / 230
    assert abs(met / 60 / neardup.BANDS - similarity**neardup.ROWS) < 0.06


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 299), (299, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    got = corpora.collected(neardup.grouped(docs))
    # One row per document, and one for each row without an id.
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, None, None]
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert (by_id[4], by_id[5], by_id[6], by_id[7]) == (4, 4, 6, 6)
    assert all(r["kept"] for r in got if r["doc_id"] in (None, 1, 2, 3))
    assert neardup.grouped(corpora.empty(spark)).count() == 0

    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "9", "None", "None"]
    assert neardup.deduplicated(corpora.empty(spark)).count() == 0


def test_pipeline_stage_keeps_one_of_each_short_pair(spark):
    docs = short_pairs(80, 900)
    expected = set(brute(docs, 80).values())
    assert expected == set(range(0, 1800, 2))
    got = corpus_pipeline.near_duplicates(spark, corpora.documents(spark, *docs), "")
    assert {r["doc_id"] for r in got.collect()} == expected
