"""Cases that all corpus operators must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="s"):
    """Documents with ids from 0 in the order of the texts."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows, one id with two texts, a long text, clashing columns."""
    r = random.Random(5)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "der", "né"]) + str(r.randint(0, 99)) for _ in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (None, "no id here at all"), (None, None), (7, "twice the same row\nb\nc\nd"),
        (7, "twice the same row\nb\nc\nd"), (8, "first text of eight"), (8, "second text of eight"), (9, "\x00\x01\x02 控制 \U0001f600"),
    ]
    extra = ", label string, score int, kept int, at int, n int, rep long, component long, key string"
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, 0, "x", 1, 2, 3, 4, 5, 6, "k") for i, t in rows], DOCS + extra)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(r: random.Random, n: int, size: int = 3000) -> str:
    return " ".join(f"w{r.randint(0, size)}" for _ in range(n))
