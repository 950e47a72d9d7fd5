import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import corpora
from tokenledger.llm import lexical

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    """Rows of (item_id, rank, doc_id, score), every document scored."""
    held = [(i, Counter(words(text))) for i, text in docs]
    n_docs = sum(bool(count) for _, count in held)
    n_terms = sum(sum(count.values()) for _, count in held)
    df = Counter(t for _, count in held for t in count)
    out = []
    for item_id, text in items:
        asked = Counter(words(text))
        scores = []
        for i, count in held:
            score = 0
            for t, repeats in asked.items():
                if tf := count[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * sum(count.values()) * n_docs) // n_terms
                    score += repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:top], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def check(spark, docs, items, top=20):
    found = lexical.ranked(
        corpora.documents(spark, *docs), spark.createDataFrame(items, "item_id long, text string"), top
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in found.collect()]
    assert order(got) == order(brute(docs, items, top))
    return got


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(vocabulary)]
    odds = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, " ".join(rng.choices(common, odds, k=rng.choice([0, 3, 10, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(n // 3)]  # copies
    items = [(i, " ".join(rng.choices(common, odds, k=rng.choice([1, 4, 30])))) for i in range(25)]
    return rng.sample(docs, len(docs)), items


@pytest.mark.parametrize("block, read, batch", [(16_384, 64, 200_000), (17, 1, 200_000), (50, 2, 40)])
def test_equals_brute_force(spark, monkeypatch, block, read, batch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "FIRST_READ", read)
    monkeypatch.setattr(lexical, "BATCH_TERMS", batch)
    monkeypatch.setattr("tokenledger.llm.texts.BATCH_ROWS", 16)
    docs, items = corpus(block, 300)
    rows = check(spark, docs, items)
    assert rows


def test_bounds_hold_at_every_depth():
    """Blocks answered alone, with and without scores known from elsewhere: all that may be among the best is exact."""
    rng = np.random.default_rng(4)
    for seed in range(60):
        n_docs, n_terms = int(rng.integers(1, 80)), int(rng.integers(1, 12))
        there = rng.random((n_docs, n_terms)) < rng.choice([0.05, 0.5, 1.0])
        docs, terms = np.nonzero(there)
        values = rng.integers(1, rng.choice([2, 5, 1000]), len(docs))
        block = lexical.Block(terms, docs, values, np.arange(n_docs), np.ones(n_docs, bool))
        weights = rng.integers(0, 4, n_terms)
        whole = np.zeros(n_docs, np.int64)
        np.add.at(whole, docs, values * weights[terms])
        known = rng.integers(1, 2000, rng.integers(0, 6))
        top = int(rng.integers(1, 8))
        got, scores = block.best(block.lists(np.arange(n_terms), weights), top, known, read=1 + seed % 3)
        assert (whole[got] == scores).all()
        every = np.concatenate([known, whole])
        least = max(1, np.sort(every)[-top]) if len(every) >= top else 1
        assert set(np.nonzero(whole >= least)[0]) <= set(got.tolist())


def test_reads_stop_early():
    """A document that leads in every list ends the reads, however long the lists are."""
    n = 50_000
    docs = np.tile(np.arange(n), 2)
    values = np.concatenate([np.append(10**6, np.arange(n - 1, 0, -1)), np.append(10**6, np.arange(1, n))])
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return super().__getitem__(key)

    block = lexical.Block(np.repeat([0, 1], n), docs, values, np.arange(n), np.ones(n, bool))
    lists = [(d.view(Counted), v) for d, v in block.lists(np.array([0, 1]), np.array([1, 1]))]
    got, scores = block.best(lists, 1, np.zeros(0, np.int64))
    assert got.tolist() == [0] and scores.tolist() == [2 * 10**6]
    assert sum(reads) < 1000


def test_ties_nulls_and_repeats(spark):
    docs = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (-4, "A,b!"), (9, None), (8, ""), (7, "-- \n"), (6, "é日本 a")]
    items = [(1, "a"), (1, "a"), (None, "É é日本"), (2, None), (3, "..."), (4, "b B b unseen"), (5, "a b c")]
    for top in (1, 3, 20):
        check(spark, docs, items, top)


def test_awkward_tables(spark):
    docs = corpora.awkward(spark)
    items = spark.createDataFrame([(1, "one TWO x"), (2, corpora.prose(1, 400))], "item_id long, text string")
    items = items.selectExpr("*", *(f"'x' as `{c}`" for c in "doc_id rank score number terms n".split()))
    wide = docs.selectExpr("*", *(f"'x' as `{c}`" for c in "item_id rank score number terms n".split() if c not in docs.columns))
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in lexical.ranked(wide, items).collect()]
    assert order(got) == order(brute(plain, [(r["item_id"], r["text"]) for r in items.collect()]))
    assert lexical.ranked(wide.limit(0), items).count() == 0
    assert lexical.ranked(wide, items.limit(0)).count() == 0
