"""Substring dedup against a plain loop and SQL; the automaton against all substrings."""

from __future__ import annotations

import random
import re
from itertools import pairwise

import pytest
from conftest import SMALL, duck_rows, rows
from helpers import DOCS, documents, empty, odd, words
from pyspark.sql import functions as F

from visitcast.llm import substring_dedup as sd


def brute(docs, span):
    """(doc_id, text) of each row to (n_words, n_removed, kept)."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, split, strict=True):
        for a in range(len(w) - span + 1):
            x = tuple(w[a : a + span])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {p for a in range(len(w) - span + 1) if first[tuple(w[a : a + span])] < key(i) for p in range(a, a + span)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def got(df, **k):
    return {r.doc_id: (r._n_words, r._n_removed, r.text) for r in sd.dedup(df, **k).collect()}


def corpus(r, n):
    """Texts with copies, near copies, shared passages in other surroundings, circles and edges of windows."""
    passages = [words(r, r.choice([8, 12, 13, 30, 60]), 500).split() for _ in range(8)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.2:
            w = r.choice(texts).split()
        elif kind < 0.3:
            w = (words(r, r.choice([1, 2, 5]), 3).split() * 40)[: r.randint(5, 90)]
        else:
            w = words(r, r.randint(0, 80), 500).split()
        for _ in range(r.choice([0, 1, 1, 3])):
            p = r.choice(passages)
            a = r.randint(0, 3)
            at = r.randint(0, len(w))
            w[at:at] = p[a : len(p) - r.randint(0, 3)]
        for _ in range(r.choice([0, 0, 1, 2])):
            if w:
                w[r.randrange(len(w))] = r.choice(["X", "x", "new"])
        texts.append(r.choice([" ", "\n", "  \t"]).join(w) + r.choice(["", " "]))
    return texts


@pytest.mark.parametrize("k", [{}, {"shard_words": 20}, {"shard_words": 200, "stream_words": 40, "rows": 0}])
def test_equal_to_brute_force(spark, k):
    """Whole shards, keys dealt window by window, salted streams and shuffled sides give the same rows."""
    r = random.Random(11)
    texts = corpus(r, 120)
    want = {i: x for i, x in enumerate(brute(list(enumerate(texts)), 12))}
    assert sum(x[1] > 0 for x in want.values()) > 30
    assert got(documents(spark, texts), span=12, gram=4, **k) == want


def test_order_of_rows_does_not_matter(spark):
    r = random.Random(12)
    texts = corpus(r, 60)
    docs = [(r.randint(-50, 50), t) for t in texts]
    docs = list({i: (i, t) for i, t in docs}.values())
    r.shuffle(docs)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(7)
    assert got(df, span=10, gram=3) == {i: x for (i, _), x in zip(docs, brute(docs, 10), strict=True)}


def test_automaton():
    """Every window of three words of every sequence, and no other, under its smallest id."""
    r = random.Random(13)
    for _ in range(200):
        runs = [(r.randint(0, 5), [r.choice("abc") for _ in range(r.randint(0, 9))]) for _ in range(r.randint(0, 5))]
        least = {}
        for i, w in runs:
            for a in range(len(w) - 2):
                x = tuple(w[a : a + 3])
                least[x] = min(least.get(x, i), i)
        automaton = sd.Automaton(runs)
        text, owner = [r.choice("abcd") for _ in range(20)], r.randint(0, 6)
        hit = [a for a in range(18) if least.get(tuple(text[a : a + 3]), 9) < owner]
        spans = automaton.spans(text, owner, 3)
        assert {p for a, b in spans for p in range(a, b)} == {p for a in hit for p in range(a, a + 3)}
        assert all(a[1] < b[0] for a, b in pairwise(spans))
        assert len(automaton.link) <= 2 * sum(len(w) for _, w in runs) + 1


def test_fragments_hold_every_window_once(spark):
    r = random.Random(14)
    texts = [words(r, n, 9) for n in (0, 11, 12, 13, 40, 200)] + ["a " * 100, "a b " * 60]
    at: dict = {}
    for f in sd.fragments(documents(spark, texts), 12, 4).collect():
        at.setdefault(f._k, []).extend(range(f["at"], f["at"] + f.n))
        assert f.n <= 9
    assert {k: sorted(v) for k, v in at.items()} == {i: list(range(len(t.split()) - 11)) for i, t in enumerate(texts) if len(t.split()) >= 12}


def test_hot_passage_in_other_surroundings(spark):
    """A passage in every document is a reference once; every later place of it goes."""
    r = random.Random(15)
    passage = words(r, 60, 900)
    texts = [f"{words(r, 30, 10**6)} {passage} {words(r, 30, 10**6)}" for _ in range(150)]
    found = got(documents(spark, texts), stream_words=2000)
    assert found[0][1] == 0 and all(found[i][1] == 60 and len(found[i][2].split()) == 60 for i in range(1, 150))


def test_case_counts_and_clean_documents_stay(spark):
    r = random.Random(16)
    one = words(r, 70, 900)
    found = got(documents(spark, [one, one.upper(), words(r, 49, 9), words(r, 300, 900)]))
    assert [found[i][1] for i in range(4)] == [0, 0, 0, 0]


def test_odd_rows(spark):
    df = odd(spark)
    out = sd.dedup(df).collect()
    assert len(out) == 12 and all(r.key == "k" and r._n_removed == 0 for r in out)
    assert sum(r.text is None for r in out) == 2 and all(r._n_words == 0 for r in out if not (r.text or "").strip())
    assert sd.dedup(empty(spark)).count() == 0
    text = words(random.Random(17), 80, 900)
    rows_ = [(5, text), (5, text), (5, "a " + text), (None, text), (None, text + " b"), (3, "q " + text)]
    twins = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows_], DOCS)
    assert sorted((r._n_words, r._n_removed, r.text) for r in sd.dedup(twins).collect()) == sorted(brute(rows_, 50))
    with pytest.raises(ValueError):
        sd.dedup(df, span=5, gram=5)


def test_long_text(spark):
    long = words(random.Random(18), 120_000, 10**6)
    found = got(documents(spark, [long, "x " + long + " y"]))
    assert found[0][1] == 0 and found[1] == (120_002, 120_000, "x y")


def test_no_group_is_collected_by_key(spark):
    """Keys and classes are aggregated by their smallest and largest id, never listed."""
    cut = sd.fragments(documents(spark, ["a b c d e f"] * 3), 3, 2)
    plan = cut.groupBy("m").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "collect" not in plan


def test_equal_to_sql(spark, duck):
    assert rows(sd.op13_substring_dedup(spark, SMALL)) == duck_rows(duck, sd.ORACLE_SQL)
