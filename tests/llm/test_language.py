import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm import corpora
from tokenledger.llm import language

SYLLABLES = {"aa": ["ka", "ki", "ko"], "bb": ["té", "tú", "ña"], "cc": ["schu", "ver", "ung"]}


def text(lang, seed, n=12):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(n))


def test_words_first_then_grams(spark):
    rows = [(i, text(lang, i), "s", lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    model = language.fitted(corpora.documents(spark, *rows))
    assert model.languages == ["aa", "bb", "cc"]
    assert all(model.predict(text(lang, 1000 + i))[0] == lang for lang in SYLLABLES for i in range(20))
    # A word that was never seen goes by its longest known n-grams.
    unseen = "schuverungverschuung"
    assert unseen not in model.rows and model.predict(unseen)[0] == "cc"
    known = next(iter(model.rows))
    first = model.matrix[model.index[known]]
    assert (first == model.rows[known]).all()
    for value in (None, "", "12 ² !", "_"):
        assert model.predict(value) == ("und", 0.0)
    assert model.predict("日本")[0] in model.languages


def test_forgetting_keeps_predictions(spark, monkeypatch):
    rows = [(i, text(lang, i), "s", lang) for i, lang in enumerate(list(SYLLABLES) * 10)]
    model = language.fitted(corpora.documents(spark, *rows))
    texts = [text(lang, 50 + i) + f" {lang}q{'x' * i}" for lang in SYLLABLES for i in range(10)]
    before = [model.predict(x) for x in texts]
    monkeypatch.setattr(language, "REMEMBERED", 2)
    assert [model.predict(x) for x in texts] == before


def brute(rows, text):
    """(language, score) by the method's rules, from labelled (lang, text) rows; every row is in the sample."""
    langs = sorted({lang for lang, _ in rows})
    words = {lang: Counter(w for at, t in rows if at == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in langs}
    units = {lang: {n: Counter() for n in range(1, 6)} for lang in langs}
    for lang in langs:
        for word, k in words[lang].items():
            for n in range(1, 6):
                around = word if n == 1 else f" {word} "
                for i in range(len(around) - n + 1):
                    units[lang][n][around[i : i + n]] += k
    known = {word for lang in langs for word, k in words[lang].items() if k > 1}

    def log(k, total, distinct):
        return math.log((k + 0.5) / (total + 0.5 * (distinct + 1)))

    def score(word, lang):
        if word in known:
            k = words[lang][word]
            return log(k if k > 1 else 0, sum(words[lang].values()), len(known))
        for n in range(5, 0, -1):
            around = word if n == 1 else f" {word} "
            there = {gram for at in langs for gram in units[at][n]}
            found = [gram for gram in (around[i : i + n] for i in range(len(around) - n + 1)) if gram in there]
            if found:
                return sum(log(units[lang][n][g], sum(units[lang][n].values()), len(there)) for g in found) / len(found)
        return 0.0

    asked = re.findall(r"[^\W\d_]+", text.lower())
    n = {lang: sum(at == lang for at, _ in rows) for lang in langs}
    totals = {lang: math.log(n[lang] / len(rows)) + sum(score(w, lang) for w in asked) for lang in langs}
    best = max(langs, key=lambda lang: totals[lang])
    return best, 1 / sum(math.exp(t - totals[best]) for t in totals.values())


def test_equals_brute_force(spark):
    rows = [(i, text(lang, i, 6), "s", lang) for i, lang in enumerate(list(SYLLABLES) * 12)] + [(99, "ka ka té schu", "s", "bb")]
    model = language.fitted(corpora.documents(spark, *rows))
    labelled = [(row[3], row[1]) for row in rows]
    asked = [text(lang, 500 + i, 3) for lang in SYLLABLES for i in range(15)]
    asked += ["kaki schuverung", "té x日 qqq", "kakaka", "ungung Schu", " ".join(text(lang, 7) for lang in SYLLABLES)]
    for value, (lang, score) in zip(asked, model.predict_all(asked), strict=True):
        want, chance = brute(labelled, value)
        assert lang == want and score == pytest.approx(chance, abs=1e-9), value


def test_each_language_keeps_its_share(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_WORDS", 12)
    monkeypatch.setattr(language, "MAX_GRAMS", 30)
    large = [(i, text("aa", i % 7, 40), "s", "aa") for i in range(60)]
    small = [(100 + i, "ungung ungung schuver schuver", "s", "cc") for i in range(2)]
    model = language.fitted(corpora.documents(spark, *large, *small))
    assert {"ungung", "schuver"} <= set(model.rows) and len(model.rows) <= 24
    assert model.predict("schuver")[0] == "cc"


def test_labels_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = [(i, text(lang, i), "s", lang) for i, lang in enumerate(["aa", "aa", "aa", "bb", "bb", "cc", "cc"])]
    model = language.fitted(corpora.documents(spark, *rows, (9, "schu", "s", "dd")))
    assert model.languages == ["aa", "bb"]
    assert corpora.collected(language.predicted(corpora.documents(spark, *rows), model))[-1]["lang_pred"] in ("aa", "bb")


def test_words_met_of_late_stay(spark, monkeypatch):
    rows = [(i, text(lang, i), "s", lang) for i, lang in enumerate(list(SYLLABLES) * 10)]
    model = language.fitted(corpora.documents(spark, *rows))
    monkeypatch.setattr(language, "REMEMBERED", 8)
    model.predict("xka")
    for i in range(40):
        model.predict(f"xka {'y' * (i + 1)}té")
        assert model.used <= model.known + 1 + 8 + 2


def test_held_out_is_the_checksum(spark):
    frame = spark.range(50).select("id", language.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in frame.collect())


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    got = corpora.collected(language.predicted(docs, language.fitted(docs)))
    assert len(got) == 13
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language.fitted(corpora.empty(spark))
    assert {r["lang_pred"] for r in language.predicted(docs, nothing).collect()} == {"und"}
    assert language.predicted(corpora.empty(spark), nothing).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fitted(docs.filter(~held_out))
    got = language.predicted(docs, model).join(docs.filter(held_out).select("doc_id", "lang"), "doc_id")
    share = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
