import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import corpora
from tokenledger.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = [chat.START, chat.SEP, chat.NEXT, chat.END, *chat.RESERVED]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text):
    """Backslashes after the first character of a control string become one more."""
    out, i = "", 0
    while i < len(text):
        end = i + 1
        while end < len(text) and text[end] == "\\":
            end += 1
        mark = next((m for m in MARKS if text[i] in "<[" and text.startswith(m[1:], end)), None)
        if mark:
            out += text[i:end] + "\\" + mark[1:]
            i = end + len(mark) - 1
        else:
            out += text[i]
            i += 1
    return out


def brute(rows):
    """conv_id -> (n_turns, string, text under the mask), turn by turn."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    by_id = lambda r: (r[0] is not None, r[0] or 0)
    for conv_id, held in itertools.groupby(sorted(rows, key=by_id), key=lambda r: r[0]):
        text, loss, last, turns = "", "", None, []
        for _, _, role, said in sorted(held, key=order):
            role, said = role or "", said or ""
            if last == role:
                text += chat.NEXT + escaped(said)
            else:
                text += (chat.END if turns else "") + chat.START + escaped(role) + chat.SEP + escaped(said)
            loss += said if role == "assistant" else ""
            turns.append((role, said))
            last = role
        out[conv_id] = (turns, text + chat.END, loss)
    return out


def check(spark, rows, turns=None):
    turns = turns if turns is not None else spark.createDataFrame(rows, SCHEMA)
    made = chat.formatted(turns).select("*", chat.turns_of(F.col("formatted")).alias("turns")).collect()
    digests = {r["conv_id"]: r.asDict() for r in chat.digests(chat.formatted(turns)).collect()}
    wanted = brute(rows)
    assert len(made) == len(wanted) == len(digests)
    for r in made:
        said, text, loss = wanted[r["conv_id"]]
        assert r["formatted"] == text
        assert [tuple(t) for t in r["turns"]] == said and r["n_turns"] == len(said)
        data = text.encode()
        spans = [data[s["start"] : s["end"]].decode() for s in r["loss_spans"]]
        assert spans == [escaped(t) for role, t in said if role == "assistant"]
        assert digests[r["conv_id"]] == {
            "conv_id": r["conv_id"],
            "n_turns": len(said),
            "turns_sha256": sha("".join(f"{role}\n{t}\n" for role, t in said)),
            "loss_chars": len(loss),
            "loss_sha256": sha(loss),
            "formatted_chars": len(text),
        }


def test_texts_that_look_like_marks(spark):
    rng = random.Random(3)
    parts = [*MARKS, *(m[1:] for m in MARKS), "<", "[", "\\", "\\\\", "é", "日本 ", "\n", "𝄞", "user", ""]
    rows = [
        (c, t, rng.choice(["user", "assistant", "tool<|im_sep|>", "a\nb"]), "".join(rng.choices(parts, k=rng.randrange(9))))
        for c in range(60)
        for t in range(rng.randrange(1, 7))
    ]
    check(spark, rows)


@pytest.mark.parametrize("gap", [1, 50])
def test_long_conversations_join_their_pieces(spark, gap):
    rng = random.Random(gap)
    rows = [(1, t * gap - 200, rng.choice(["user", "assistant"]), f"é{t}") for t in range(700)]
    rows += [(3, t * 64, "assistant", "same role in every piece") for t in range(4)] + [(2, 5, "user", "short")]
    check(spark, rows)


def test_long_ids_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tokenledger.operators.joins.BROADCAST_ROWS", 0)
    check(spark, [(c, t * 40, "user" if t % 2 else "assistant", f"{c} {t}") for c in range(5) for t in range(5)])


def test_awkward_rows(spark):
    long = corpora.prose(1, 60_000)
    rows = [
        (None, None, None, None),
        (None, 100, "user", "of no id"),
        (None, 0, "user", "of no id"),
        (1, None, "user", "no number"),
        (1, None, "assistant", None),
        (1, 0, None, "no role"),
        (2, 1, "user", "tie"),
        (2, 1, "assistant", "tie"),
        (2, 1, "user", "tie"),
        (3, 0, "assistant", ""),
        (4, 0, "assistant", long),
        (4, 64, "assistant", long),
        (-5, -100, "user", "negative"),
    ]
    turns = spark.createDataFrame(rows, SCHEMA)
    wide = turns.selectExpr("*", *(f"'x' as `{c}`" for c in "part turns long_id piece pieces low n formatted _salt".split()))
    check(spark, rows, wide)
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


def test_stays_in_the_jvm(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = chat.digests(chat.formatted(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
