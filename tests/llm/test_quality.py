import random
import re

from tests.llm import corpora
from tokenledger.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(hit),
    }


def test_counts_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n ", "é日 a b", "a b c d e f a b c d e f g"]
    texts += ["".join(rng.choice(["a ", "b ", "c#", "\n", "é ", "\x0b"]) for _ in range(60)) for _ in range(200)]
    for text in texts:
        assert quality.measure(text.encode() if text is not None else None) == brute(text)


def test_hosts_are_shrunk_and_judge_their_documents(spark):
    good, bad = corpora.prose(1, 30), " ".join([*(f"x{i}" + "#" * 9 for i in range(9)), corpora.prose(5, 20)])
    rows = [(i, good, f"host{i % 20}") for i in range(400)]
    rows += [(1000 + i, f"{corpora.prose(i, 12)} {'###### ' * 30}" if i % 10 else corpora.prose(i, 30), "spam") for i in range(200)]
    rows += [(2000, bad, "tiny")]
    got = {r["doc_id"]: r for r in corpora.collected(quality.judged(corpora.documents(spark, *rows)))}
    assert all(got[i]["kept"] for i in range(400))
    # A clean document of a host where almost all fail goes with its host; a host of one bad document stays.
    assert not got[1000]["base_failed"] and not got[1000]["kept"]
    assert got[2000]["kept"]


def test_awkward_rows(spark):
    got = corpora.collected(quality.judged(corpora.awkward(spark)))
    assert len(got) == 13
    assert [r["n_words"] for r in got if r["doc_id"] in (1, 2, 3, 4)] == [0, 0, 0, 2, 2]
    assert quality.judged(corpora.empty(spark)).count() == 0
    kept = quality.filtered(corpora.awkward(spark))
    assert kept.columns == corpora.awkward(spark).columns
    # Most documents of the host "a" are too short, and it goes.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["6", "7", "8", "8"]
    assert quality.filtered(corpora.empty(spark)).count() == 0
