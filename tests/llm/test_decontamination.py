import hashlib
import random
import re

from tests.llm import corpora
from tokenledger.llm import decontamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(len(own), 10)
        windows = [own[i : i + size] for i in range(len(own) - size + 1)] if own else []
        for i in range(len(words) - size + 1):
            if any(words[i : i + size] == window for window in windows):
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus():
    rng = random.Random(2)
    vocabulary = ["ab", "b", "é", "7", "ß日", "cc"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 14])))) for i in range(1, 12) if i != 4]
    items += [(4, None), (20, " !! "), (5, items[0][1])]
    docs = [(i, "".join(w + rng.choice([" ", "-", ", ", "\n"]) for w in rng.choices(vocabulary, k=40))) for i in range(60)]
    docs += [(100 + i, f"X {text.upper()}. y") for i, text in items if text]
    return docs, items


def frames(spark, docs, items):
    return corpora.documents(spark, *docs), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    frame, benchmark = frames(spark, docs, items)
    expected = {i: brute(text, items) for i, text in docs}
    for most in (decontamination.MAX_PATTERN_BYTES, 100):
        # A small bound makes many automata.
        monkeypatch.setattr(decontamination, "MAX_PATTERN_BYTES", most)
        got = decontamination.digests(decontamination.scanned(frame, benchmark)).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == expected
    assert len(decontamination.pattern_parts(benchmark)) > 1


def test_spans_are_places_in_the_original(spark):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    text = "É intro:  ALPHA, beta-gamma\ndelta epsilon; zeta eta theta iota (kappa) end"
    frame, benchmark = frames(spark, [(1, text)], items)
    span = decontamination.scanned(frame, benchmark).first()["spans"][0]
    assert text[span["start"] : span["end"]] == "ALPHA, beta-gamma\ndelta epsilon; zeta eta theta iota (kappa"


def test_awkward_rows(spark):
    docs = corpora.awkward(spark)
    items = spark.createDataFrame([(1, "one two"), (None, "line"), (2, None), (1, "two")], "item_id long, text string")
    got = corpora.collected(decontamination.digests(decontamination.scanned(docs, items)))
    assert len(got) == 13
    assert {r["doc_id"] for r in got if r["contaminated"]} == {4, 5, 9}
    assert [(r["n_hit"], r["n_items"]) for r in got if r["doc_id"] == 9] == [(3, 0)]
    kept = decontamination.without_hits(docs, items)
    assert kept.columns == docs.columns and kept.count() == 9
    assert decontamination.without_hits(docs, items.limit(0)).count() == 13
    assert decontamination.scanned(corpora.empty(spark), items).count() == 0
