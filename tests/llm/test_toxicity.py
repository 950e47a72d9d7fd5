import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corpora
from tokenledger.llm import toxicity

SLURS = ["grumbo", "zarfle", "quidnit"]


def corpus(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = corpora.prose(i, 60).split()
        harm = i % 5 == 0
        for _ in range(rng.choice([1, 2, 6]) if harm else 0):
            words.insert(rng.randrange(60), rng.choice(SLURS))
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or harm:
            labels.append((i, int(harm)))
    return docs, labels


def test_catches_toxic_documents_and_orders_them(spark):
    docs, labels = corpus()
    frame = corpora.documents(spark, *docs)
    model = toxicity.fitted(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.scored(frame, model).collect()}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i, _ in docs)
    counts = {i: sum(text.count(slur) for slur in SLURS) for i, text in docs}
    mean = [np.mean([got[i]["severity"] for i in got if counts[i] == k]) for k in (0, 1, 6)]
    assert mean[0] < 0.3 < mean[1] < mean[2] <= 3


def test_thresholds_are_ordered_and_share_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    cuts = np.array([-0.5, 0.7, 2.0])
    grade = (x * 1.5 + rng.logistic(size=3000) > cuts[:, None]).sum(axis=0)
    model = toxicity.Ordinal.fit(np.arange(3000), np.zeros(3000, np.int64), x, grade, 1, 4)
    assert abs(model.weights[0] - 1.5) < 0.15
    assert np.allclose(model.thresholds, cuts, atol=0.2)
    assert (np.diff(model.thresholds) > 0).all()
    assert abs(model.chances(0.3).sum() - 1) < 1e-12


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (5, 1), (None, 1), (99, 1), (6, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = corpora.collected(toxicity.scored(docs, toxicity.fitted(docs, known)))
        assert len(got) == 13
        assert all(0 <= r["severity"] <= 3 for r in got)
    assert not any(r["toxic"] for r in toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0))).collect())
    empty = corpora.empty(spark)
    assert toxicity.scored(empty, toxicity.fitted(empty, labels)).count() == 0


def test_severity_equals_brute_force(spark):
    docs, labels = corpus(200)
    model = toxicity.fitted(corpora.documents(spark, *docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weights, cuts = dict(zip(model.index, model.ordinal.weights, strict=True)), model.ordinal.thresholds
    for _, text in docs:
        words = text.lower().encode().split()
        words += [w[: toxicity.BEGINNING] + b"*" for w in words if len(w) > toxicity.BEGINNING]
        score = sum(weights[w] * math.log(1 + words.count(w)) for w in set(words) if w in weights)
        at_most = [1 / (1 + math.exp(-(cut - score))) for cut in cuts] + [1.0]
        chances = [b - a for a, b in zip([0.0, *at_most], at_most, strict=False)]
        got = model.severity(text.encode())
        assert got["severity"] == pytest.approx(sum(k * p for k, p in enumerate(chances)), abs=1e-9)
        assert got["toxic"] == (1 - chances[0] > model.cut)
        assert got["grade"] == (1 + max(range(3), key=lambda k: chances[k + 1]) if got["toxic"] else 0)


def test_the_cut_is_the_best_one():
    rng = np.random.default_rng(1)
    for _ in range(50):
        chances, toxic = np.round(rng.random(40), 1), rng.random(40) < 0.3
        toxic[0] = True

        def f1(cut, chances=chances, toxic=toxic):
            said = chances > cut
            return 2 * (said & toxic).sum() / (said.sum() + toxic.sum())

        assert f1(toxicity.best_cut(chances, toxic)) == max(f1(c) for c in np.arange(-0.05, 1.0, 0.1))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_labels(spark):
    """Fitted to three quarters of the labels, toxic documents of the others are told apart, in all grades."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learned = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(4)) != 0
    got = toxicity.scored(docs, toxicity.fitted(docs, labels.filter(learned)))
    asked = labels.filter(~learned & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    rows = got.join(asked, "doc_id").collect()
    caught = sum(r["toxic"] and r["label"] == 1 for r in rows)
    recall, precision = caught / sum(r["label"] == 1 for r in rows), caught / sum(r["toxic"] for r in rows)
    # 0.895 each when this was written, of 344 toxic documents to learn from.
    assert recall >= 0.87 and precision >= 0.87, (recall, precision)
    assert {r["grade"] for r in rows} == {0, 1, 2, 3}
