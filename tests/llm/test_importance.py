"""Importance resampling against a plain loop and SQL, and the bracket against a sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest import SMALL, duck_rows, rows
from helpers import documents, empty, odd, words
from pyspark.sql import functions as F

from visitcast.llm import importance


def features(text, order, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    """docs: (doc_id, text) with distinct ids."""
    found = [(i, *features(t, order, buckets)) for i, t in docs]
    s, t = Counter(c for _, _, f in found for c in f), Counter(c for x in target for c in features(x, order, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda c: math.floor(1000 * math.log((t[c] + 1) * (all_s + buckets) / ((s[c] + 1) * (all_t + buckets))))
    out = {}
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out[i] = (n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    fit = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i is None, i))
    rank = {i: k + 1 for k, i in enumerate(fit[: percent * len(fit) // 100])}
    return {i: (*v[1:], rank.get(i)) for i, v in out.items()}


def got(df):
    return {r.doc_id: (r._ir_features, r._ir_weight, r._ir_score, r._ir_rank) for r in df.collect()}


@pytest.mark.parametrize("k", [{}, {"order": 3, "buckets": 64, "percent": 37, "least": 5, "seed": 7}, {"percent": 100}, {"percent": 0}])
def test_equal_to_brute_force(spark, k):
    r = random.Random(1)
    texts = [words(r, r.choice([0, 3, 19, 20, 21, 60]), 200) + r.choice(["", " Né-控控 X9", "\n\x00A_B"]) for _ in range(300)]
    target = [words(r, 30, 40) for _ in range(20)] + [None]
    want = brute(list(enumerate(texts)), target, **k)
    named = {"least_words" if n == "least" else n: v for n, v in k.items()}
    assert got(importance.resample(documents(spark, texts), documents(spark, target), **named)) == want


def test_chunks():
    """Words and runs don't depend on where a long text is cut."""
    r = random.Random(2)
    text = (words(r, 400, 50) + " né" + "x" * 90 + " ü--ß ").encode() * 3
    for order in (1, 2, 4):
        whole = list(importance.hashed(text, order, 997))
        assert len(whole) == 1
        for chunk in (1, 7, 64, 1000):
            parts = list(importance.hashed(text, order, 997, chunk))
            assert sum(n for n, _ in parts) == whole[0][0]
            assert Counter(np.concatenate([c for _, c in parts]).tolist()) == Counter(whole[0][1].tolist())


@pytest.mark.parametrize("accuracy", [1, 10_000])
@pytest.mark.parametrize("scores", ["spread", "ties", "equal"])
def test_cutoff_is_that_of_a_sort(spark, accuracy, scores):
    """A coarse sketch widens its bracket until the counts outside prove it; ties are cut by id."""
    r = random.Random(accuracy)
    n = 2000
    value = {"spread": lambda: r.randint(-(10**6), 10**6), "ties": lambda: r.choice([1, 1, 1, 2, 9]), "equal": lambda: 4}[scores]
    data = [(i, value(), i, 50) for i in range(n)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, _ir_score long, _ir_row long, _ir_words long").repartition(5)
    order = sorted(data, key=lambda x: (-x[1], x[0]))
    for percent in (1, 33, 100):
        wanted = percent * n // 100
        score, doc_id, _ = importance.cutoff(df, wanted, percent / 100, accuracy)
        assert (doc_id, score) == order[wanted - 1][:2]
        ranks = {x.doc_id: x._ir_rank for x in importance.drawn(df, percent, 20, accuracy).collect()}
        assert ranks == {x[0]: k + 1 if k < wanted else None for k, x in enumerate(order)}


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    """Sketches that miss the place are found out by the counts."""
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").alias("_ir_score"), F.col("id").alias("_ir_row"), F.lit(50).alias("_ir_words"))
    real, calls = F.percentile_approx, []

    def wrong(column, places, accuracy):
        calls.append(1)
        return F.transform(real(column, places, accuracy), lambda x: x * 0 + len(calls))

    monkeypatch.setattr(importance.F, "percentile_approx", wrong)
    assert importance.cutoff(df, 300, 0.3, 100)[0] == 700 and len(calls) > 1


def test_odd_rows(spark):
    df = odd(spark).withColumn("_ir_rank", F.lit("clash"))
    out = importance.resample(df, documents(spark, ["first text of eight", None]), least_words=1, percent=50, keep_text=True)
    found = out.collect()
    assert len(found) == 12 and all(r.key == "k" for r in found)
    assert sorted(r._ir_rank for r in found if r._ir_rank) == list(range(1, sum(r._ir_words >= 1 for r in found) // 2 + 1))
    assert all((r._ir_features, r._ir_weight, r._ir_rank) == (0, 0, None) for r in found if not (r.text or "").strip())
    a, b = [r for r in found if r.doc_id == 7]
    assert a._ir_score == b._ir_score
    assert importance.resample(empty(spark), empty(spark)).count() == 0
    assert got(importance.resample(documents(spark, ["a b c"] * 3), empty(spark), least_words=1)) == brute([(i, "a b c") for i in range(3)], [], least=1)


def test_settings_return(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    importance.bucket_counts(documents(spark, ["a b"]))
    assert spark.conf.get(name) == before


def test_equal_to_sql(spark, duck):
    assert rows(importance.op11_importance_resampling(spark, SMALL)) == duck_rows(duck, importance.ORACLE_SQL)
