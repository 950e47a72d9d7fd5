"""Ranked lexical search: the best documents of each query by an integer score, found by NRA.

Terms are lower-cased words of ASCII letters, digits and characters outside ASCII; a document's score adds, for each
term of the query with its repeats, the term's weight times its impact (:func:`impacts`), all in whole numbers.

1. Queries are cut into terms and written. They are answered in batches of at most about BATCH_TERMS terms, whose
   words are all that is sent to executors.
2. One pass over whole texts keeps, for each document, its length and the counts of the batch's terms, written narrow.
   Lengths and numbers of documents per term are added up from that over all documents.
3. Each task reads its share of these rows in blocks of documents, sorts a block's postings by term and falling impact
   (:class:`Block`), and answers every query of the batch by sequential reads of these lists, without looking any
   score up at random (no random access, NRA): a document's lower bound is what was read of it, its upper bound
   adds, for lists in which it was not met, the impact at which these stand. Reading goes on until every document
   that may still be among the best has equal bounds, so that membership, ties and scores are final. The best scores
   of earlier blocks of the task let later blocks stop earlier.
4. The best of each task meet in one ranking per query. A block is bounded, so memory is, and no list is ever whole
   in one place; copies of a document or a term in all documents make no difference.

Defined cases: a null text or one without terms has no terms, and as a document counts nowhere; a query without terms,
or without a document above 0, has no rows; each row of the queries is a query of its own, also where ids are null
or repeated; each row of the documents is a document of its own, and a null doc_id comes before all others among equal
scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.llm.texts import alnum_words, mapped, utf8
from tokenledger.session import written

TOP = 20
# Terms (with repeats) of the queries that are answered together, about.
BATCH_TERMS = 200_000
# A block ends with the document that fills either.
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 2_000_000
# Postings of each list in the first round of reads; each round reads twice as many.
FIRST_READ = 64

FOUND = "number long, doc_id long, score long"


def weight(n_docs: int, n_holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of a term that occurs ``tf`` times in a document of ``n`` terms."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Block:
    """Lists of postings of some documents, by falling impact; ``ids`` holds anything where an id is null."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, values: np.ndarray, ids: np.ndarray, has_id: np.ndarray):
        order = np.lexsort((docs, -values, terms))
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(starts[1:], len(order))
        self.starts, self.docs, self.values = starts, docs[order], values[order]
        self.ids, self.has_id = ids, has_id

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, contributions) of the terms that occur."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return [
            (self.docs[self.starts[i] : self.ends[i]], self.values[self.starts[i] : self.ends[i]] * w)
            for i, term, w in zip(at.tolist(), terms.tolist(), weights.tolist(), strict=True)
            if len(self.terms) and self.terms[i] == term
        ]

    def best(
        self, lists: list[tuple[np.ndarray, np.ndarray]], top: int, known: np.ndarray, read: int = FIRST_READ
    ) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the ``top`` best, with the scores ``known`` elsewhere."""
        n_docs = len(self.ids)
        lower = np.zeros(n_docs, np.int64)
        met = np.zeros((len(lists), n_docs), bool)
        alive = np.arange(n_docs)
        is_alive = np.ones(n_docs, bool)
        at = [0] * len(lists)
        while True:
            # What a document not met in a list can still get from it.
            rest = np.array([held[i] if i < len(held) else 0 for i, (_, held) in zip(at, lists, strict=True)], np.int64)
            reached = lower[alive]
            upper = reached + (rest.sum() - rest @ met[:, alive])
            scores = np.concatenate([known, reached])
            least = max(1, int(np.partition(scores, -top)[-top])) if len(scores) >= top else 1
            possible = upper >= least
            is_alive[alive[~possible]] = False
            alive, reached, upper = alive[possible], reached[possible], upper[possible]
            if (reached == upper).all():
                return alive, reached
            for i, (docs, held) in enumerate(lists):
                block = slice(at[i], at[i] + read)
                there = docs[block]
                wanted = is_alive[there]
                lower[there[wanted]] += held[block][wanted]
                met[i, there[wanted]] = True
                at[i] = min(at[i] + read, len(docs))
            read *= 2


def _ordered(ids: np.ndarray, has_id: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, has_id, -scores))[:top]


def _vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the counts of ``terms`` in whole texts."""

    def counted(batch: dict[str, list]) -> dict[str, list]:
        n, held, counts = [], [], []
        for text in batch["text"]:
            words = alnum_words(text)
            found = Counter(map(terms.get, words))
            found.pop(None, None)
            n.append(len(words))
            held.append(list(found))
            counts.append(list(found.values()))
        return {"doc_id": batch["doc_id"], "n": n, "terms": held, "counts": counts}

    columns = {"doc_id": F.col("doc_id").cast("long"), "text": utf8()}
    return mapped(docs, columns, counted, "doc_id long, n long, terms array<int>, counts array<int>")


def _found(
    vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int
) -> DataFrame:
    """The best documents of each task's share for ``queries``, number -> (terms, weights)."""
    block_docs, block_postings, first_read = BLOCK_DOCS, BLOCK_POSTINGS, FIRST_READ

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = n_postings = 0

        def block() -> Block:
            ids, has_id, docs, terms, values = (np.concatenate(column) for column in zip(*held, strict=True))
            return Block(terms, docs, values, ids, has_id)

        for batch in batches:
            ids, terms = batch.column("doc_id"), batch.column("terms")
            sizes = np.asarray(terms.value_lengths())
            docs = np.repeat(np.arange(len(sizes)), sizes)
            tf = np.asarray(batch.column("counts").flatten()).astype(np.int64)
            n = np.asarray(batch.column("n"))
            values = impacts(tf, n[docs], n_docs, n_terms)
            held.append(
                (np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), docs + n_held, np.asarray(terms.flatten()), values)
            )
            n_held += len(sizes)
            n_postings += len(docs)
            if n_held >= block_docs or n_postings >= block_postings:
                yield block()
                held, n_held, n_postings = [], 0, 0
        if held:
            yield block()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {number: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for number in queries}
        for block in blocks(batches):
            for number, (terms, weights) in queries.items():
                ids, has_id, scores = kept[number]
                docs, more = block.best(block.lists(terms, weights), top, scores, first_read)
                if len(docs):
                    ids = np.concatenate([ids, block.ids[docs]])
                    has_id = np.concatenate([has_id, block.has_id[docs]])
                    scores = np.concatenate([scores, more])
                    order = _ordered(ids, has_id, scores, top)
                    kept[number] = ids[order], has_id[order], scores[order]
        for number, (ids, has_id, scores) in kept.items():
            if len(scores):
                columns = [pa.array([number] * len(scores), pa.int64()), pa.array(ids, mask=~has_id), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "score"])

    return vectors.mapInArrow(best, FOUND)


def _batch(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """number, doc_id, score: the best of each task for the ``items`` of one batch."""
    counts = {row["number"]: Counter(row["terms"]) for row in items.select("number", "terms").collect()}
    terms = {term: i for i, term in enumerate(sorted({term for count in counts.values() for term in count}))}
    vectors = written(_vectors(docs, {term.encode(): i for term, i in terms.items()}))
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = {row["term"]: weight(sums["docs"], row["n"]) for row in holding}
    queries = {}
    for number, count in counts.items():
        used = sorted((terms[term], n * weights[terms[term]]) for term, n in count.items() if terms[term] in weights)
        queries[number] = tuple(np.array([pair[i] for pair in used], np.int64) for i in (0, 1))
    return _found(vectors, queries, sums["docs"], max(sums["terms"], 1), top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) its ``top`` best documents."""

    def cut(batch: dict[str, list]) -> dict[str, list]:
        return {"item_id": batch["item_id"], "terms": [[w.decode() for w in alnum_words(text)] for text in batch["text"]]}

    kind = items.schema["item_id"].dataType.simpleString()
    terms = mapped(items, {"item_id": F.col("item_id"), "text": utf8()}, cut, f"item_id {kind}, terms array<string>")
    numbered = written(terms.withColumn("number", F.monotonically_increasing_id()))
    total = numbered.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_batches = -(-total // BATCH_TERMS) or 1
    batch = F.pmod(F.xxhash64("number"), F.lit(n_batches))
    found = None
    for i in range(n_batches):
        part = _batch(docs, numbered.filter(batch == i), top)
        found = part if found is None else found.union(part)
    in_order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= top)
    return best.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
