"""Centroid clustering: Lloyd's rounds in whole numbers, where heaps of bounds tell which vectors to look at again.

Vectors are turned into whole numbers and written once, in blocks of BLOCK_ROWS (:func:`blocks`), bucketed by block.
Beside them a small table holds the state of each block, bucketed alike, so that a round joins the two without a
shuffle and writes nothing but states. A state has, for each cluster, a heap of (key, vector). The key is the gap
between the distances to the second nearest and to the nearest centroid when the vector was last scanned, plus the
drift that the cluster had accumulated by then: how far, in all rounds so far, its own centroid and the fastest other
one have moved. While the accumulated drift stays below the key, no other centroid can have come nearer; only vectors
whose gap has expired are popped, scanned against all centroids and pushed again. Sums and sizes of the clusters are
kept per block and change only by vectors that move; added up over the blocks they give the next centroids, which is
all that reaches the driver (k * dimension numbers a round).

Distances and means are exact: distances are whole numbers below 2**63, ties go to the smaller cluster number, and a
gap counts as expired a little early (MARGIN), so rounding of square roots decides nothing.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out; a vector
with a component beyond +-2**LARGEST_BITS, whose squared distances may not fit 64 bits, keeps its row with null
results and takes no part; repeated rows are vectors; a null vec_id is hashed as an empty one; equal start hashes are
ordered by components; fewer vectors than k make fewer clusters; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.session import shared_dir, written

K = 8
ROUNDS = 10
DIMENSION = 64
SCALE = 1024
SEED = 3
LARGEST_BITS = 26
# Vectors per block, and blocks per bucket (one file), about.
BLOCK_ROWS = 4096
BUCKET_BLOCKS = 256
MAX_BUCKETS = 100_000
# Roots of whole numbers below 2**60 are off by less than 2**-21; all rounds together stay far below this.
MARGIN = 1e-3

BLOCKS = "block long, ids array<long>, data binary, seeds array<struct<hash:string,vector:array<long>>>"
STATE = "block long, sizes array<int>, members binary, keys binary, sums array<long>, scanned long"


def whole_vectors(column: pa.ListArray, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components as whole numbers in doubles) of a list column."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.nonzero(sizes == dimension)[0]
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    # Nulls become NaN, which is not finite.
    values = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)
    finite = np.isfinite(values).all(axis=1)
    return rows[finite], np.floor(values[finite] * SCALE)


def start_hash(vec_id: int | None) -> str:
    return hashlib.sha256(f"{SEED}:{'' if vec_id is None else vec_id}".encode()).hexdigest()


def blocks(vectors: DataFrame, k: int = K, dimension: int = DIMENSION) -> DataFrame:
    """Blocks of vectors, and of each block the ``k`` that are first by their start hash.

    A block's number is made of its task and its place there. ``data`` is null for the ids of vectors that are too
    large to be measured.
    """
    block_rows = BLOCK_ROWS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        n_blocks, held, n_held, large = 0, [], 0, []

        def block() -> pa.RecordBatch:
            ids = [i for part, _ in held for i in part]
            data = np.concatenate([part for _, part in held])
            small = np.int16 if not data.size or np.abs(data).max() < 2**15 else np.int32
            hashes = [start_hash(i) for i in ids]
            chosen = heapq.nsmallest(k, range(len(ids)), key=lambda i: (hashes[i], data[i].tolist()))
            seeds = [{"hash": hashes[i], "vector": data[i].astype(np.int64).tolist()} for i in chosen]
            return row(ids, data.astype(small).tobytes(), seeds)

        def row(ids: list, data: bytes | None, seeds: list) -> pa.RecordBatch:
            nonlocal n_blocks
            n_blocks += 1
            return pa.RecordBatch.from_pylist([{"block": first + n_blocks, "ids": ids, "data": data, "seeds": seeds}], schema)

        schema = pa.schema(
            [
                ("block", pa.int64()),
                ("ids", pa.list_(pa.int64())),
                ("data", pa.binary()),
                ("seeds", pa.list_(pa.struct([("hash", pa.string()), ("vector", pa.list_(pa.int64()))]))),
            ]
        )
        for batch in batches:
            rows, values = whole_vectors(batch.column("embedding"), dimension)
            ids = batch.column("vec_id").take(pa.array(rows)).to_pylist()
            fits = (np.abs(values) <= 2**LARGEST_BITS).all(axis=1)
            large += [i for i, fit in zip(ids, fits, strict=True) if not fit]
            held.append(([i for i, fit in zip(ids, fits, strict=True) if fit], values[fits]))
            n_held += int(fits.sum())
            if n_held >= block_rows:
                yield block()
                held, n_held = [], 0
            if len(large) >= block_rows:
                yield row(large, None, [])
                large = []
        if n_held:
            yield block()
        if large:
            yield row(large, None, [])

    return vectors.select("vec_id", "embedding").mapInArrow(packed, BLOCKS)


def _unpacked(data: bytes, n: int, dimension: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * n * dimension else np.int32
    return np.frombuffer(data, kind).reshape(n, dimension).astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, one column per centroid."""
    return np.stack([np.square(vectors - centroid).sum(axis=1) for centroid in centroids], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, gap) of each vector; of equally near centroids the first."""
    squared = distances(vectors, centroids)
    cluster = squared.argmin(axis=1)
    if len(centroids) == 1:
        return cluster, np.full(len(vectors), np.inf)
    two = np.sqrt(np.partition(squared, 1, axis=1)[:, :2].astype(np.float64))
    return cluster, two[:, 1] - two[:, 0] - MARGIN


class Heaps:
    """The state of one block: a heap of (key, vector) per cluster, sums and sizes of the clusters."""

    def __init__(self, heaps: list[list[tuple[float, int]]], sums: np.ndarray):
        self.heaps, self.sums = heaps, sums

    @classmethod
    def started(cls, vectors: np.ndarray, centroids: np.ndarray) -> Heaps:
        cluster, gaps = nearest(vectors, centroids)
        heaps, sums = [], []
        for k in range(len(centroids)):
            members = np.nonzero(cluster == k)[0]
            heap = list(zip(gaps[members].tolist(), members.tolist(), strict=True))
            heapq.heapify(heap)
            heaps.append(heap)
            sums.append(vectors[members].sum(axis=0))
        return cls(heaps, np.array(sums))

    def expire(self, vectors: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> int:
        """Rescans what ``drift``, accumulated per cluster, may have changed; how many vectors that were."""
        popped, homes = [], []
        for k, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[k]:
                popped.append(heapq.heappop(heap)[1])
                homes.append(k)
        if not popped:
            return 0
        cluster, gaps = nearest(vectors[popped], centroids)
        for i, home, k, gap in zip(popped, homes, cluster.tolist(), gaps.tolist(), strict=True):
            heapq.heappush(self.heaps[k], (gap + drift[k], i))
            if k != home:
                self.sums[home] -= vectors[i]
                self.sums[k] += vectors[i]
        return len(popped)

    def row(self, block: int, scanned: int) -> dict:
        entries = [entry for heap in self.heaps for entry in heap]
        return {
            "block": block,
            "sizes": [len(heap) for heap in self.heaps],
            "members": np.array([i for _, i in entries], np.int32).tobytes(),
            "keys": np.array([key for key, _ in entries], np.float64).tobytes(),
            "sums": self.sums.ravel().tolist(),
            "scanned": scanned,
        }

    @classmethod
    def read(cls, row: dict, dimension: int) -> Heaps:
        entries = list(
            zip(np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["members"], np.int32).tolist(), strict=True)
        )
        ends = np.cumsum(row["sizes"]).tolist()
        heaps = [entries[end - size : end] for end, size in zip(ends, row["sizes"], strict=True)]
        return cls(heaps, np.array(row["sums"], np.int64).reshape(-1, dimension))

    def clusters(self) -> np.ndarray:
        out = np.zeros(sum(map(len, self.heaps)), np.int64)
        for k, heap in enumerate(self.heaps):
            out[[i for _, i in heap]] = k
        return out


_STATE_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("sizes", pa.list_(pa.int32())),
        ("members", pa.binary()),
        ("keys", pa.binary()),
        ("sums", pa.list_(pa.int64())),
        ("scanned", pa.int64()),
    ]
)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table of the shared folder whose joins on the block need no shuffle."""
    spark = df.sparkSession
    path = shared_dir(spark)
    name = f"clustering_{path.rsplit('/', 1)[-1]}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def _assigned(data: DataFrame, state: DataFrame | None, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state of each block after its vectors were assigned to ``centroids``."""
    dimension = centroids.shape[1]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                vectors = _unpacked(row["data"], row["n"], dimension)
                if "keys" in row:
                    heaps = Heaps.read(row, dimension)
                    scanned = heaps.expire(vectors, centroids, drift)
                else:
                    heaps = Heaps.started(vectors, centroids)
                    scanned = row["n"]
                yield pa.RecordBatch.from_pylist([heaps.row(row["block"], scanned)], _STATE_SCHEMA)

    rows = data.select("block", F.size("ids").alias("n"), "data")
    if state is not None:
        rows = rows.join(state.drop("scanned").hint("shuffle_hash"), "block")
    return rows.mapInArrow(assigned, STATE)


def _sums(state: DataFrame, k: int, dimension: int) -> tuple[list[int], list[list[int]], int]:
    """Sizes and sums of the clusters and the number of scans, over all blocks."""
    added = (
        state.select(F.posexplode("sums").alias("place", "value"))
        .groupBy("place")
        .agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("value"))
        .collect()
    )
    flat = {row["place"]: int(row["value"]) for row in added}
    sizes = state.select("scanned", *(F.get("sizes", F.lit(i)).cast("long").alias(f"k{i}") for i in range(k)))
    row = sizes.agg(F.sum("scanned").alias("scanned"), *(F.sum(f"k{i}").alias(f"k{i}") for i in range(k))).first()
    return [row[f"k{i}"] for i in range(k)], [[flat[i * dimension + j] for j in range(dimension)] for i in range(k)], row["scanned"]


class Clustering:
    """Final centroids, the frame of blocks and their states, and how many vectors each assignment scanned."""

    def __init__(self, blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, scans: list[int]):
        self.blocks, self.state, self.centroids, self.scans = blocks, state, centroids, scans


def fitted(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION) -> Clustering:
    """``rounds`` rounds over ``vectors`` (vec_id, embedding), and one more assignment."""
    spark = vectors.sparkSession
    packed = written(blocks(vectors, k, dimension))
    sizes = packed.filter(F.col("data").isNotNull())
    first = sizes.select(F.inline("seeds")).orderBy("hash", "vector").limit(k).collect()
    if not first:
        return Clustering(packed, None, np.zeros((0, dimension), np.int64), [])
    centroids = np.array([row["vector"] for row in first], np.int64)
    n_blocks = sizes.count()
    parallel = min(n_blocks, spark.sparkContext.defaultParallelism)
    buckets = min(MAX_BUCKETS, max(parallel, -(-n_blocks // BUCKET_BLOCKS)))
    data = _bucketed(sizes.select("block", "ids", "data").repartition(buckets, "block"), buckets)
    drift = np.zeros(len(centroids))
    state, scans = None, []
    for done in range(rounds + 1):
        state = _bucketed(_assigned(data, state, centroids, drift), buckets)
        n, sums, scanned = _sums(state, len(centroids), dimension)
        scans.append(scanned)
        if done < rounds:
            moved = np.array(
                [[s // n[i] for s in sums[i]] if n[i] else centroids[i].tolist() for i in range(len(centroids))], np.int64
            )
            steps = np.sqrt(np.square(moved - centroids).sum(axis=1).astype(np.float64))
            others = [max((s for j, s in enumerate(steps) if j != i), default=0.0) for i in range(len(steps))]
            drift = drift + steps + np.array(others)
            centroids = moved
    return Clustering(packed, data.join(state.hint("shuffle_hash"), "block"), centroids, scans)


def _members(model: Clustering) -> DataFrame:
    """vec_id, cluster, distance."""
    centroids = model.centroids
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                vectors = _unpacked(row["data"], len(row["ids"]), centroids.shape[1])
                clusters = Heaps.read(row, centroids.shape[1]).clusters()
                apart = np.square(vectors - centroids[clusters]).sum(axis=1)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(clusters, pa.int32()), pa.array(apart)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = model.state.select("block", "ids", "data", "sizes", "members", "keys", "sums")
    return rows.mapInArrow(members, "vec_id long, cluster int, distance long")


def clustered(model: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    blank = "cast(null as int) cluster", "cast(null as long) distance"
    large = model.blocks.filter(F.col("data").isNull()).select(F.explode("ids").alias("vec_id")).selectExpr("vec_id", *blank)
    spark = model.blocks.sparkSession
    if model.state is None:
        members, totals, hashes = large, {}, {}
    else:
        found = written(_members(model))
        members = found.union(large)
        totals = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
        hashes = {
            i: hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
            for i, centroid in enumerate(model.centroids.tolist())
        }
    rows = [(i, int(totals.get(i, 0)), int(sum(totals.values())), sha) for i, sha in hashes.items()]
    # One row per cluster.
    ends = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(ends), "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
