"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): all thresholds share the weights w, and they are ordered because
each is the one before plus an exponential. x holds log(1 + count) of the ``FEATURES`` words, and beginnings of words,
whose occurrence in labelled documents says most about the label (a likelihood ratio). The expected severity is the sum of
k * P(grade = k).

Labels say toxic or not, so the grades to learn are made: a toxic document has grade 1 to 3 by the share of its words
that are telling, those much more frequent in toxic documents, a third of the toxic documents of the sample each;
others have grade 0. They order toxic documents by how densely they are toxic, and by nothing that people judged.

From which chance on a document is toxic is learned too: each of FOLDS parts of the sample gets its chances from a fit to
the others, and the cut is the middle of the chances at which all labels are told apart best (F1). A document
below the cut has grade 0, another the likeliest of the other grades.

The regression is fitted to a bounded sample of about ``SAMPLE_ROWS`` labelled documents, chosen by a hash of
the id, and at most ``FEATURES`` numbers of each reach the driver. All documents are scored whole.

Defined cases: null and empty texts have no features and get the severity of a text without any; labels
without a document, and null labels, are not used; of repeated labels of an id the greatest counts; without
labels, or with labels of one kind, the severity is 0; repeated rows are rows; an empty table gives an empty
result; columns other than doc_id, text and doc_id, toxic are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import alnum_words, computed, mapped, utf8
from tokenledger.session import written

SAMPLE_ROWS = 20_000
FEATURES = 1024
# A word is told by a label in at least so many documents, and telling with such log odds.
LEAST_DOCS, TELLING = 3, 2.0
# Bytes (UTF-8) that the beginning of a longer word has.
BEGINNING = 6
GRADES = 4
# Parts of the labelled documents that are left out in turn, to learn the cut.
FOLDS = 4
# A fit ends when CHECKED steps lower the loss by less than TOLERANCE of it.
STEPS, CHECKED, TOLERANCE = 2000, 50, 1e-4
LEARNING_RATE, PENALTY = 0.2, 1e-4


def features_of(words: list[bytes]) -> Counter:
    """Counts of words and of the beginnings of longer words, so that unseen forms of a word count for it."""
    counts = Counter(words)
    for word, n in list(counts.items()):
        if len(word) > BEGINNING:
            counts[word[:BEGINNING] + b"*"] += n
    return counts


def _documents_with(rows: dict[str, list]) -> dict[str, list]:
    found: dict[bytes, list[int]] = {}
    for data, toxic in zip(rows["data"], rows["toxic"], strict=True):
        for feature in features_of(alnum_words(data)):
            found.setdefault(feature, [0, 0])[toxic] += 1
    words = [feature.decode("latin-1") for feature in found]
    return {"word": words, "clean": [n for n, _ in found.values()], "toxic": [n for _, n in found.values()]}


def telling_words(sample: DataFrame) -> list[tuple[str, float]]:
    """The words and beginnings with the greatest likelihood ratio, FEATURES at most, with their log odds for toxic documents."""
    columns = {"data": utf8(), "toxic": F.col("toxic")}
    words = mapped(sample, columns, _documents_with, "word string, clean long, toxic long")
    words = words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).first()
    n_clean, n_toxic = totals["clean"] or 0, totals["toxic"] or 0
    if not n_clean or not n_toxic:
        return []
    a, b = F.col("toxic"), F.col("clean")

    def part(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    share = (a + b) / (n_clean + n_toxic)
    ratio = (
        part(a, share * n_toxic)
        + part(b, share * n_clean)
        + part(n_toxic - a, (1 - share) * n_toxic)
        + part(n_clean - b, (1 - share) * n_clean)
    )
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_clean - b + 0.5))
    top = words.filter(a + b >= LEAST_DOCS).select("word", ratio.alias("ratio"), odds.alias("odds"))
    top = top.orderBy(F.desc("ratio"), "word").limit(FEATURES)
    return [(r["word"], r["odds"]) for r in top.collect()]


def counts_of(words: list[bytes], index: dict[bytes, int]) -> dict[int, int]:
    return {index[feature]: n for feature, n in features_of(words).items() if feature in index}


class Ordinal:
    """Weights shared by ordered thresholds, for grades 0 to len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def chances(self, score: float) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - score, -50, 50)))
        return np.diff(below, prepend=0.0, append=1.0)

    @classmethod
    def fit(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, grades: int):
        """Gradient descent (with momentum and scaled steps) on the penalised likelihood of sparse rows."""
        n, cuts = len(grade), grades - 1
        params = np.zeros(n_features + cuts)
        shares = np.cumsum(np.bincount(grade, minlength=grades) + 1)[:-1] / (n + grades)
        start = np.log(shares / (1 - shares))
        params[n_features] = start[0]
        params[n_features + 1 :] = np.log(np.maximum(np.diff(start), 1e-3))
        first, second = np.zeros_like(params), np.zeros_like(params)
        last = np.inf
        for step in range(1, STEPS + 1):
            weights, raw = params[:n_features], params[n_features:]
            thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
            score = np.bincount(row, value * weights[column], minlength=n)
            edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
            high, low = (1 / (1 + np.exp(-np.clip(edges[grade + k] - score, -50, 50))) for k in (1, 0))
            chance = np.maximum(high - low, 1e-12)
            if step % CHECKED == 0:
                loss = PENALTY / 2 * (weights @ weights) - np.log(chance).mean()
                if last - loss < TOLERANCE * loss:
                    break
                last = loss
            d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
            to_score = (d_high - d_low) / n
            to_threshold = np.bincount(np.minimum(grade, cuts - 1), -d_high * (grade < cuts), minlength=cuts) / n
            to_threshold += np.bincount(np.maximum(grade - 1, 0), d_low * (grade > 0), minlength=cuts) / n
            tail = np.cumsum(to_threshold[::-1])[::-1]
            gradient = np.concatenate(
                [
                    np.bincount(column, value * to_score[row], minlength=n_features) + PENALTY * weights,
                    [tail[0]],
                    tail[1:] * np.exp(raw[1:]),
                ]
            )
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            # Smaller steps later on settle what larger ones swing around.
            params -= LEARNING_RATE / (1 + step / 100) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        raw = params[n_features:]
        return cls(params[:n_features], np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


class Model:
    def __init__(self, words: list[str], ordinal: Ordinal | None, cut: float = 0.5):
        self.index = {word.encode("latin-1"): i for i, word in enumerate(words)}
        self.ordinal, self.cut = ordinal, cut

    def severity(self, data: bytes | None) -> dict:
        if self.ordinal is None:
            return {"severity": 0.0, "grade": 0, "toxic_chance": 0.0, "toxic": False}
        counts = counts_of(alnum_words(data), self.index)
        score = sum(self.ordinal.weights[i] * np.log1p(n) for i, n in sorted(counts.items()))
        chances = self.ordinal.chances(float(score))
        toxic_chance = float(1 - chances[0])
        toxic = toxic_chance > self.cut
        return {
            "severity": float(chances @ np.arange(len(chances))),
            "grade": 1 + int(chances[1:].argmax()) if toxic else 0,
            "toxic_chance": toxic_chance,
            "toxic": toxic,
        }


def best_cut(chances: np.ndarray, toxic: np.ndarray) -> float:
    """The chance above which documents are best called toxic: the one of greatest F1, in the middle of the gap."""
    order = np.argsort(-chances, kind="stable")
    chances, toxic = chances[order], toxic[order]
    caught = np.cumsum(toxic)
    f1 = 2 * caught / (np.arange(1, len(toxic) + 1) + toxic.sum())
    # Equal chances cannot be told apart.
    f1[:-1][chances[:-1] == chances[1:]] = -1
    at = int(f1.argmax())
    return float((chances[at] + (chances[at + 1] if at + 1 < len(chances) else chances[at] - 1)) / 2)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = int(min(1.0, rows / max(1, known.count())) * (1 << 20))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share)
    sample = docs.select(F.col("doc_id"), F.col("text")).join(chosen, "doc_id")
    # The bounded sample is read several times; documents are not.
    sample = written(sample.select("doc_id", "text", "toxic"))
    found = telling_words(sample)
    if not found:
        return Model([], None)
    words = [word for word, _ in found]
    index = {word.encode("latin-1"): i for i, word in enumerate(words)}
    telling = {i for i, (_, odds) in enumerate(found) if odds >= TELLING}

    def features(data: bytes | None) -> dict:
        all_words = alnum_words(data)
        counts = counts_of(all_words, index)
        share = sum(n for i, n in counts.items() if i in telling) / max(1, len(all_words))
        places = sorted(counts)
        return {"places": places, "counts": [counts[i] for i in places], "share": share}

    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    made = sample.select(
        computed(features, "places: array<int>, counts: array<int>, share: double", utf8()).alias("f"),
        (F.col("toxic") == 1).alias("toxic"),
        fold.alias("fold"),
    )
    gathered = made.select("f.*", "toxic", "fold").collect()
    row = np.repeat(np.arange(len(gathered)), [len(r["places"]) for r in gathered])
    column = np.array([i for r in gathered for i in r["places"]], np.int64)
    value = np.log1p(np.array([n for r in gathered for n in r["counts"]], float))
    toxic, fold = (np.array([r[name] for r in gathered], kind) for name, kind in (("toxic", bool), ("fold", int)))
    share = np.array([r["share"] for r in gathered])
    cuts = np.quantile(share[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = toxic * (1 + (share[:, None] >= cuts).sum(axis=1))

    def fit(learned: np.ndarray) -> Ordinal:
        inside, place = learned[row], np.cumsum(learned) - 1
        return Ordinal.fit(place[row[inside]], column[inside], value[inside], grade[learned], len(words), GRADES)

    # Each document's chance by a fit to the other folds, unless labels of one kind are all in one of them.
    chances = np.zeros(len(toxic))
    whole = fit(np.ones(len(toxic), bool))
    for k in range(FOLDS):
        learned = fold != k
        model = fit(learned) if 0 < toxic[learned].sum() < learned.sum() else whole
        scores = np.bincount(row, value * model.weights[column], minlength=len(toxic))
        chances[~learned] = [1 - model.chances(score)[0] for score in scores[~learned]]
    return Model(words, whole, best_cut(chances, toxic))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected severity, grade, chance of being toxic, and whether the document is taken to be."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def over(data: bytes | None) -> dict:
        return sent.value.severity(data)

    found = docs.select(
        "doc_id", computed(over, "severity: double, grade: int, toxic_chance: double, toxic: boolean", utf8()).alias("s")
    )
    return found.select("doc_id", "s.*")
