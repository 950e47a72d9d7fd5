"""Small corpora with the awkward rows that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named like results or like what operators use inside.
CLASHES = (
    "kept host size shard slot counts s data component_id n_words node a b band values ranges spans items cluster "
    "piece bin_id _shard _at found quality m p v w gone row verdict_host lang_pred toxic license"
).split()

WORDS = "the of and to in that was with for this".split()


def prose(seed, n, words=None):
    rng = random.Random(seed)
    return " ".join((words or []) [i] if words and i < len(words) else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(900)}x" for i in range(n))


def documents(spark, *rows):
    """Rows of (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """Nulls in any column, blank, short and very long texts, repeated rows and ids, clashing columns."""
    long = prose(1, 60_000)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t\n ", "en", "a", 5),
        (4, "one two", "en", "a", 7),
        (4, "one two", "en", "a", 7),
        (5, "one two", "en", None, 7),
        (None, prose(2, 30), "en", "a", 1),
        (None, prose(2, 30), None, "a", 1),
        (6, long, "en", "b", len(long)),
        (7, long, "en", "b", len(long)),
        (8, prose(3, 40), "de", "b", 1),
        (8, prose(4, 40), "de", "b", 1),
        (9, "line\nline\nline\n日本 é ²   x", "en", "b", 1),
    ]
    wide = spark.createDataFrame(rows, SCHEMA)
    return wide.selectExpr("*", *(f"'x' as `{name}`" for name in CLASHES))


def empty(spark):
    return awkward(spark).limit(0)


def collected(frame, key="doc_id"):
    return sorted((r.asDict(True) for r in frame.collect()), key=lambda r: str(r[key]))
