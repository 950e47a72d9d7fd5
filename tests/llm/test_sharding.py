import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm import corpora
from tokenledger.llm import sharding


def size(text):
    return len((text or "").encode()) + 1


def check(rows, docs, shards, slack):
    """All rows are there once, slots are gapless, and bytes are near equal."""
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), size(text)) for i, text in docs)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    assert set(by_shard) <= set(range(shards))
    for held in by_shard.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    total = sum(size(text) for _, text in docs)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by_shard[k]) - total / shards) <= slack
    return by_shard


def test_near_equal_bytes(spark):
    rng = random.Random(5)
    docs = [(i, corpora.prose(i, rng.choice([0, 3, 30, 300]))) for i in range(800)]
    rows = sharding.sharded(corpora.documents(spark, *docs)).collect()
    by_shard = check(rows, docs, 8, 2 * max(size(text) for _, text in docs))
    # The order is one over all shards: text keys do not overlap.
    keyed = sharding.sharded(corpora.documents(spark, *docs)).withColumn("k", sharding.text_key(F.col("text")))
    ends = keyed.groupBy("shard").agg(F.min("k"), F.max("k")).orderBy("shard").collect()
    assert all(a[2] <= b[1] for a, b in zip(ends, ends[1:], strict=False))
    assert len(by_shard) == 8


def test_a_hot_text_is_divided_and_light_copies_stay_together(spark):
    hot = "x" * 500
    docs = [(i, hot) for i in range(3000)] + [(5000 + i, corpora.prose(i // 3, 20)) for i in range(3000)]
    rows = sharding.sharded(corpora.documents(spark, *docs)).collect()
    check(rows, docs, 8, 2000)
    texts = dict(docs)
    homes = defaultdict(set)
    for r in rows:
        if texts[r["doc_id"]] != hot:
            homes[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(shards) > 1 for shards in homes.values()) <= 7


def test_full_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    docs = [(i, "hot" if i % 3 else corpora.prose(i, 5)) for i in range(900)]
    check(sharding.sharded(corpora.documents(spark, *docs)).collect(), docs, 8, 60)


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    out = sharding.sharded(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(out.collect(), plain, 8, sum(size(text) for _, text in plain))
    assert sharding.sharded(corpora.empty(spark)).count() == 0
    same = [(1, "a")] * 40
    check(sharding.sharded(corpora.documents(spark, *same)).collect(), same, 8, 80)


def test_buckets_are_bounded_by_bytes(spark, monkeypatch):
    """A few rows hold most bytes: they are not sorted together, and all laws hold."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(sharding, "TASK_BYTES", 40_000)
    rng = random.Random(8)
    docs = [(i, corpora.prose(i, 2000 if i % 20 == 0 else rng.randrange(5))) for i in range(300)]
    docs += [(1000 + i, "y" * 15_000) for i in range(20)]
    out = sharding.sharded(corpora.documents(spark, *docs))
    check(out.collect(), docs, 8, 40_000)
    assert out.rdd.getNumPartitions() >= sum(size(text) for _, text in docs) // 40_000


def test_cuts_are_those_of_exact_counts(spark):
    """Each splitter is as near to its target as any place of the order within the tolerance allows."""
    rng = random.Random(9)
    docs = [(i, corpora.prose(i, rng.choice([1, 30, 300]))) for i in range(500)] + [(900 + i, "same " * 200) for i in range(60)]
    frame = corpora.documents(spark, *docs).select(
        sharding.text_key(F.col("text")).alias("text_key"), sharding.id_key(F.col("doc_id")).alias("id_key"),
        sharding.size_of(F.col("text")).alias("size"),
    )
    cuts = sharding.splitters(frame, 8, 0.0)
    rows = sorted(tuple(r) for r in frame.collect())
    total = sum(r[2] for r in rows)
    for i, cut in enumerate(cuts, 1):
        target = total * i // 8
        below = sum(r[2] for r in rows if r[:2] < cut)
        # No place between two rows is nearer, but for texts of several rows, which are cut only where they hold it.
        edges, ends = [0], defaultdict(int)
        for text, _, n in rows:
            ends[text] += n
        for text in sorted(ends):
            edges.append(edges[-1] + ends[text])
        assert abs(below - target) <= min(abs(edge - target) for edge in edges)
