"""Language ID by word-first backoff.

Known words score their log frequency in each language. An unseen word falls back to its character n-grams,
the longest first: the first length of which the model knows some decides, by their mean log frequency. Scores
of all words and the languages' shares add up; the score is the probability of the best language.

The model is fitted to a bounded sample: about ``SAMPLE_ROWS`` labelled rows of each language, chosen by a hash
of their text. It keeps the ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams that occur most, and of each language as
many of its own as its equal share of these numbers, so that large languages push out no small one. Of more than
``MAX_LANGUAGES`` labels those with the most rows are learned (of equally many the first in order), the others count
as unlabelled. So the model has a bounded size at any size of the corpus, and is broadcast. Prediction reads whole
texts and nothing but texts; words that are no words of the model are looked into once for a whole batch.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if there is
nothing to learn from; of equally likely languages the first in order is named; rows without a language are
not learned from; a null doc_id counts as the empty text in the hash that holds rows out; repeated rows are
rows; an empty table gives an empty result; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.llm.texts import computed_together, mapped
from tokenledger.session import written

SAMPLE_ROWS = 4000
MAX_WORDS, MAX_GRAMS = 40_000, 60_000
MAX_LANGUAGES = 200
LONGEST_GRAM = 5
SMOOTHING = 0.5
# Words without a row of their own that a worker remembers before it forgets those not met of late.
REMEMBERED = 100_000

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; what else a run holds (such as a raised digit) is no part of its word."""
    return _WORD.findall(text.lower()) if text else []


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams(word: str, length: int) -> list[str]:
    """n-grams of a word between spaces; single letters stand alone."""
    if length == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + length] for i in range(len(padded) - length + 1)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sampled(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """About ``rows`` rows of each language, chosen by a hash of the text, and the rows of each language."""
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counted = most.collect()
    counts = {r["lang"]: r["n"] for r in sorted(counted, key=lambda r: r["lang"])}
    if not counts:
        return labelled, counts
    limits = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, rows / n) * (1 << 20)))))
    return labelled.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < limits[F.col("lang")]), counts


def _count_words(rows: dict[str, list]) -> dict[str, list]:
    found: dict[str, Counter] = defaultdict(Counter)
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        found[lang].update(filter(None, map(letters, words_of(text))))
    flat = [(lang, word, n) for lang, counts in found.items() for word, n in counts.items()]
    return {"lang": [x[0] for x in flat], "word": [x[1] for x in flat], "n": [x[2] for x in flat]}


def _count_grams(rows: dict[str, list]) -> dict[str, list]:
    found: Counter = Counter()
    for lang, word, n in zip(rows["lang"], rows["word"], rows["n"], strict=True):
        for length in range(1, LONGEST_GRAM + 1):
            for gram in grams(word, length):
                found[lang, length, gram] += n
    return {
        "lang": [x[0] for x in found],
        "length": [x[1] for x in found],
        "word": [x[2] for x in found],
        "n": list(found.values()),
    }


class Model:
    """Log frequencies of words and n-grams per language; unseen words are scored once and remembered."""

    def __init__(self, counts: dict[str, int], words: list[tuple], units: list[tuple], totals: dict[tuple[str, int], int]):
        self.languages = list(counts)
        place = {lang: i for i, lang in enumerate(self.languages)}
        n = np.array(list(counts.values()), float)
        self.prior = np.log(n / n.sum()) if len(n) else n
        self.rows: dict[str, np.ndarray] = {}
        self.grams: dict[str, np.ndarray] = {}
        self._fill(self.rows, [(lang, 0, word, k) for lang, word, k in words], totals, place)
        self._fill(self.grams, units, totals, place)
        self._fresh()

    def _fill(self, into: dict, rows: list[tuple], totals: dict[tuple[str, int], int], place: dict[str, int]) -> None:
        kinds: dict[str, int] = {}
        for lang, length, unit, k in rows:
            if unit not in into:
                into[unit] = np.zeros(len(place))
                kinds[unit] = length
            into[unit][place[lang]] += k
        distinct = Counter(kinds.values())
        for unit, counts in into.items():
            length = kinds[unit]
            all_of = np.array([totals.get((lang, length), 0) for lang in self.languages], float)
            into[unit] = np.log((counts + SMOOTHING) / (all_of + SMOOTHING * (distinct[length] + 1)))

    def _fresh(self) -> None:
        # Row 0 is for runs without a letter; they are no words.
        self.index = {word: i for i, word in enumerate(self.rows, 1)}
        self.known = len(self.index)
        self.matrix = np.zeros((self.known + 1 + 4096, len(self.languages)))
        if self.rows:
            self.matrix[1 : self.known + 1] = np.stack(list(self.rows.values()))
        self.places = {gram: i for i, gram in enumerate(self.grams)}
        self.gram_matrix = np.stack(list(self.grams.values())) if self.grams else np.zeros((0, len(self.languages)))
        self.used, self.lately = self.known + 1, set()

    def _forget(self) -> None:
        """Frees the rows of words that were not met since this was last done, or of all if these are many."""
        kept = self.lately if 2 * len(self.lately) <= REMEMBERED else set()
        remembered = {run: self.matrix[self.index[run]].copy() for run in kept}
        self._fresh()
        for run, row in remembered.items():
            self._remember(run, row)

    def _remember(self, run: str, row: np.ndarray) -> None:
        if self.used >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.used] = row
        self.index[run] = self.used
        self.used += 1

    def backoff(self, word: str) -> list[int]:
        """Places of the n-grams that score an unseen word."""
        places = self.places
        for length in range(LONGEST_GRAM, 0, -1):
            if found := [places[gram] for gram in grams(word, length) if gram in places]:
                return found
        return []

    def _learn(self, runs: list[str]) -> None:
        """Rows for runs without one, all n-grams of all of them at once."""
        unseen, flat, starts = [], [], []
        for run in runs:
            word = letters(run)
            if not word:
                self.index[run] = 0
            elif word in self.index:
                self.index[run] = self.index[word]
            elif found := self.backoff(word):
                unseen.append(run)
                starts.append(len(flat))
                flat += found
            else:
                self._remember(run, np.zeros(len(self.languages)))
        if unseen:
            sums = np.add.reduceat(self.gram_matrix[flat], starts, axis=0)
            sizes = np.diff([*starts, len(flat)])
            for run, row in zip(unseen, sums / sizes[:, None], strict=True):
                self._remember(run, row)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words_of(text) for text in texts]
        met = {run for runs in cut for run in runs}
        if self.used > self.known + 1 + REMEMBERED:
            self._forget()
        self._learn(sorted(met.difference(self.index)))
        self.lately |= met.difference(self.rows)
        row = self.index.__getitem__
        found = []
        for runs in cut:
            places = list(map(row, runs))
            if not self.languages or not any(places):
                found.append((UNKNOWN, 0.0))
                continue
            total = self.matrix[places].sum(axis=0) + self.prior
            chances = np.exp(total - total.max())
            found.append((self.languages[int(total.argmax())], float(1 / chances.sum())))
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fitted(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of rows with text and lang. What reaches the driver is bounded by the model's size."""
    labelled = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample, counts = sampled(labelled, rows)
    # Labels beyond the bound have no limit, so no row of theirs is in the sample.
    columns = {"lang": F.col("lang"), "text": F.col("text")}
    words = mapped(sample, columns, _count_words, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    columns = {name: F.col(name) for name in ("lang", "word", "n")}
    units = mapped(words, columns, _count_grams, "lang string, length int, word string, n long")
    units = written(units.groupBy("lang", "length", "word").agg(F.sum("n").alias("n")))

    def most(frame: DataFrame, by: list[str], limit: int) -> DataFrame:
        top = frame.groupBy(*by).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), *by).limit(limit)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), *by))
        own = frame.withColumn("rank", rank).filter(F.col("rank") <= limit // max(1, len(counts)))
        # At most twice the limit.
        kept = top.select(*by).union(own.select(*by)).distinct()
        return frame.join(F.broadcast(kept), by, "left_semi")

    # A word seen once is no better known than its n-grams.
    word_rows = most(words, ["word"], MAX_WORDS).filter("n > 1").select("lang", "word", "n").collect()
    unit_rows = most(units, ["length", "word"], MAX_GRAMS).select("lang", "length", "word", "n").collect()
    totals = {(r["lang"], 0): r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals |= {(r["lang"], r["length"]): r["n"] for r in units.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    return Model(counts, [tuple(r) for r in word_rows], [tuple(r) for r in unit_rows], totals)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def over(texts: list[str | None]) -> list[dict]:
        return [{"lang_pred": lang, "score": score} for lang, score in sent.value.predict_all(texts)]

    found = docs.select("doc_id", computed_together(over, "lang_pred: string, score: double", F.col("text")).alias("p"))
    return found.select("doc_id", "p.*")
