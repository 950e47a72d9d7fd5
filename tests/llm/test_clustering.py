import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tokenledger.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, dimension=64):
    """Rows of the result, by plain rounds over Python's whole numbers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dimension and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in vector]))
    name = lambda row: hashlib.sha256(f"3:{'' if row[0] is None else row[0]}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda row: (name(row), row[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for done in range(rounds + 1):
        found = [nearest(v) for _, v in kept]
        if done < rounds:
            for i in range(len(centroids)):
                members = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == i]
                if members:
                    centroids[i] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    inertia = [sum(d for d, at in found if at == i) for i in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [
        (vec_id, at, d, inertia[at], sum(inertia), hashes[at]) for (vec_id, _), (d, at) in zip(kept, found, strict=True)
    ]


def check(spark, rows, k=8, rounds=10, dimension=64, parts=3):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)
    model = clustering.fitted(vectors, k, rounds, dimension)
    got = [tuple(r) for r in clustering.clustered(model).collect()]
    assert Counter(got) == Counter(brute(rows, k, rounds, dimension))
    return model


def clouds(seed, n, dimension, centers, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centers, dimension))
    points = middles[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dimension))
    return [(i, [float(x) for x in point]) for i, point in enumerate(points)]


@pytest.mark.parametrize("block", [4096, 30])
def test_equals_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", block)
    monkeypatch.setattr("tokenledger.llm.texts.BATCH_ROWS", 16)
    check(spark, clouds(1, 400, 64, 8, 0.7))


def test_only_expired_gaps_are_scanned(spark):
    """In clouds that lie apart, most vectors are scanned once."""
    model = check(spark, clouds(2, 600, 8, 6, 0.05), k=6, dimension=8)
    assert model.scans[0] == 600 and sum(model.scans[-5:]) < 300
    assert len(model.scans) == 11


def test_heaps_follow_any_centroids():
    """Assignments, sums and sizes after random moves are those of a scan of all vectors."""
    rng = np.random.default_rng(3)
    for seed in range(30):
        n, k, dimension = int(rng.integers(1, 200)), int(rng.integers(1, 6)), int(rng.integers(1, 4))
        vectors = rng.integers(-20, 20, (n, dimension))
        centroids = rng.integers(-20, 20, (k, dimension))
        heaps = clustering.Heaps.started(vectors, centroids)
        drift = np.zeros(k)
        for _ in range(6):
            moved = centroids + rng.integers(-2, 3, (k, dimension)) * (rng.random((k, 1)) < 0.6)
            steps = np.sqrt(np.square(moved - centroids).sum(axis=1))
            drift = drift + steps + [max((s for j, s in enumerate(steps) if j != i), default=0) for i in range(k)]
            centroids = moved
            heaps = clustering.Heaps.read(heaps.row(0, 0), dimension)
            heaps.expire(vectors, centroids, drift)
            want = clustering.distances(vectors, centroids).argmin(axis=1)
            assert (heaps.clusters() == want).all(), seed
            assert (heaps.sums == [vectors[want == i].sum(axis=0) for i in range(k)]).all()


def test_ties_repeats_and_few_vectors(spark):
    rng = random.Random(5)
    grid = [(i, [float(rng.randrange(3)), float(rng.randrange(3))]) for i in range(120)]
    check(spark, grid + grid[:40] + [(None, [1.0, 1.0]), (None, [1.0, 1.0]), (None, [0.0, 2.0])], dimension=2)
    check(spark, [(1, [0.5, 0.5])] * 30, dimension=2)
    check(spark, [(1, [0.5, -0.5]), (2, [100.0, 3.0])], dimension=2)
    check(spark, [(7, [0.0003, -0.0003])], dimension=2)


def test_rows_that_are_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(10 + i, [i / 7, -i / 3]) for i in range(30)]
    check(spark, bad + good, k=3, dimension=2, parts=1)
    vectors = spark.createDataFrame([(i, v, 0) for i, v in bad], SCHEMA)
    for rows in (vectors, vectors.limit(0)):
        out = clustering.clustered(clustering.fitted(rows, dimension=2))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert out.count() == 0


def test_vectors_too_large_to_measure_keep_their_rows(spark):
    good = [(i, [i / 7, 60_000.0 if i % 9 == 0 else -i / 3]) for i in range(30)]
    large = [(100, [1e30, 0.0]), (101, [0.0, -1e5])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in good + large], SCHEMA)
    wide = vectors.selectExpr("*", *(f"'x' as `{c}`" for c in "block ids data seeds cluster distance n hash".split()))
    got = [tuple(r) for r in clustering.clustered(clustering.fitted(wide, k=3, dimension=2)).collect()]
    assert Counter(r for r in got if r[0] < 100) == Counter(brute(good, 3, 10, 2))
    assert sorted(r for r in got if r[0] >= 100) == [(i, *[None] * 5) for i in (100, 101)]


def test_rounds_do_not_shuffle_vectors(spark):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in clouds(6, 50, 4, 3, 0.5)], SCHEMA)
    model = clustering.fitted(vectors, k=3, dimension=4)
    assert "Exchange" not in model.state._jdf.queryExecution().executedPlan().toString()
