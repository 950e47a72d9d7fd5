"""Best-fit packing of documents into token sequences, with conflicts.

A bin holds ``capacity`` tokens and carries bitmaps of the sources and duplicate clusters in it; no two pieces
of one source or cluster share a bin. Pieces come largest first. Open bins are ordered by residual, and the
search starts at the tightest bin the piece fits into and goes on to its successors until one is compatible.

A document longer than a bin is cut into full bins and a rest. Bins are made within groups of about
``GROUP_ROWS`` documents, to which a hash deals them, so groups are packed side by side in bounded memory. A
group that is larger than chance makes it, as equal rows do, is packed in runs of ``most_rows`` rows.

Defined cases: a text without tokens, null texts included, has a row without a bin; a null source or cluster
conflicts with nothing; ties go to the least document id, text hash and oldest bin; repeated rows are packed
like others (they conflict by source or cluster); an empty table gives an empty result; columns other than
doc_id, text, source and the named cluster are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import blank_words, computed, utf8
from tokenledger.session import written

CAPACITY = 2048
GROUP_ROWS = 8192


def _bits(values: list) -> list[int]:
    """One bit for each value that occurs more than once; a value that is alone cannot conflict."""
    counts = Counter(value for value in values if value is not None)
    order = {value: i for i, value in enumerate(v for v, n in counts.items() if n > 1)}
    return [1 << order[value] if value in order else 0 for value in values]


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order of pieces."""
    source_bits, cluster_bits = _bits(sources), _bits(clusters)
    held: list[list[int]] = []  # bitmaps of sources and clusters
    order: list[tuple[int, int]] = []  # (residual, bin)
    placed = []
    for size, source, cluster in zip(sizes, source_bits, cluster_bits, strict=True):
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & source or held[order[at][1]][1] & cluster):
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
        else:
            residual, number = capacity, len(held)
            held.append([0, 0])
        held[number][0] |= source
        held[number][1] |= cluster
        placed.append((number, capacity - residual))
        if residual > size:
            insort(order, (residual - size, number))
    return placed


def most_rows(group_rows: int) -> int:
    """The rows of a group that are packed at once: the mean and eight standard deviations of what a hash deals."""
    return group_rows + 8 * (isqrt(group_rows) + 1)


_PIECES = "doc_id long, piece int, n_tokens long, bin_id long, offset long"


def _packer(capacity: int, most: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Groups come in order, and a group's rows may go over several batches.
        group, rows, bins = None, [], 0

        def run() -> pd.DataFrame:
            nonlocal bins
            out = []
            rests = []
            for doc_id, n_tokens, source, cluster in rows:
                full, rest = divmod(n_tokens, capacity)
                for piece in range(full):
                    out.append((doc_id, piece, capacity, (group << 32) + bins, 0))
                    bins += 1
                if rest:
                    rests.append((rest, doc_id, full, source, cluster))
            rests.sort(key=lambda r: -r[0])
            placed = best_fit([r[0] for r in rests], [r[3] for r in rests], [r[4] for r in rests], capacity)
            for (rest, doc_id, piece, _, _), (number, offset) in zip(rests, placed, strict=True):
                out.append((doc_id, piece, rest, (group << 32) + bins + number, offset))
            bins += max((number for number, _ in placed), default=-1) + 1
            rows.clear()
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "n_tokens", "bin_id", "offset"])
            return frame.astype({"doc_id": "Int64", "piece": "int32"})

        for batch in batches:
            columns = (batch[name].tolist() for name in ("pack_group", "doc_id", "n_tokens", "source", "cluster"))
            for of, doc_id, n_tokens, source, cluster in zip(*columns, strict=True):
                if rows and (of != group or len(rows) == most):
                    yield run()
                if of != group:
                    group, bins = of, 0
                doc_id, cluster = (None if pd.isna(x) else int(x) for x in (doc_id, cluster))
                rows.append((doc_id, int(n_tokens), source, cluster))
        if rows:
            yield run()

    return pack


def measured(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens (words between white space) and cluster: the named column, or else a hash of the
    lower-cased words, so that copies are a cluster."""

    def measure(data: bytes | None) -> dict:
        words = blank_words(data)
        digest = xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63) if words else None
        return {"n_tokens": len(words), "digest": digest}

    found = computed(measure, "n_tokens: long, digest: long", utf8())
    own = F.col(cluster).cast("long") if cluster else F.col("m.digest")
    kept = docs.select("*", found.alias("m")) if cluster else docs.select("doc_id", "source", found.alias("m"))
    return kept.select(
        "doc_id", "source", F.col("m.n_tokens").alias("n_tokens"), F.col("m.digest").alias("digest"), own.alias("cluster")
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id and offset in the bin."""
    sizes = written(measured(docs, cluster))
    groups = max(1, -(-sizes.count() // group_rows))
    dealt = sizes.filter("n_tokens > 0").withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(groups)))
    # Nothing but narrow rows is shuffled. Long documents first, then by id, within each group.
    dealt = dealt.repartition("pack_group").sortWithinPartitions("pack_group", F.desc("n_tokens"), "doc_id", "digest")
    columns = ("pack_group", "doc_id", "n_tokens", "source", "cluster")
    bins = dealt.select(*columns).mapInPandas(_packer(capacity, most_rows(group_rows)), _PIECES)
    none = F.lit(None).cast("long")
    without = sizes.filter("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), "n_tokens", none.alias("bin_id"), none.alias("offset"))
    return bins.unionAll(without)
