"""Fill-in-middle against a plain loop, SQL and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from conftest import SMALL, duck_rows, rows
from helpers import documents, empty, odd
from pyspark.sql import functions as F

from visitcast.llm import fill_middle


def brute(doc_id, text, seed=1, rate=90, first=20, marks=("<P>", "<S>", "<M>")):
    text, p, s, m = text or "", *marks
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, s + suf + p + pre + m + mid) if h4 % 100 < first else (n, "psm", a, b - a, p + pre + s + suf + m + mid)


def got(df, **k):
    out = fill_middle.transform(df, **k).withColumn("back", fill_middle.restored(F.col("_fim_output"), F.col("_fim_form"), k.get("marks", fill_middle.MARKS)))
    return out.collect()


@pytest.mark.parametrize("k", [{}, {"seed": 7, "rate": 50, "suffix_first": 60}, {"rate": 100, "suffix_first": 100}, {"rate": 0}, {"marks": ("<fim_prefix>", "<$1>", "<\\mid>")}])
def test_equal_to_brute_force(spark, k):
    r = random.Random(3)
    letters = "ab \n\r\t<>PSM$\\é控\U0001f600́"
    texts = ["".join(r.choices(letters, k=r.choice([0, 1, 2, 5, 255, 256, 257, 600]))) for _ in range(300)] + ["<P>", "a<S>b", "x<M>", "<", ">", "\\E$1"]
    marks = k.get("marks", ("<P>", "<S>", "<M>"))
    want = {i: brute(i, t, k.get("seed", 1), k.get("rate", 90), k.get("suffix_first", 20), marks) for i, t in enumerate(texts)}
    for row in got(documents(spark, texts), **k):
        assert (row._fim_n, row._fim_form, row._fim_prefix, row._fim_middle, row._fim_output) == want[row.doc_id]
        assert row.back == texts[row.doc_id] == row.text


def test_long_text(spark):
    """A text of millions of units, surrogate pairs among them, is cut without a deep stack."""
    text = ("word \U0001f600\n" * 400_000) + "end"
    (row,) = got(documents(spark, [text]))
    assert (row._fim_n, row._fim_form, row._fim_prefix, row._fim_middle, row._fim_output) == brute(0, text) and row.back == text


def test_odd_rows(spark):
    df = odd(spark).withColumn("_fim_n", F.lit("clash"))
    rows_ = got(df)
    assert len(rows_) == 12
    for row in rows_:
        assert (row._fim_n, row._fim_form, row._fim_prefix, row._fim_middle, row._fim_output) == brute(row.doc_id, row.text)
        assert row.back == (row.text or "") and row.key == "k"
    assert not got(empty(spark))


def test_marks_that_could_overlap(spark):
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<P>", "<S>", "<M>"), ("<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.transform(empty(spark), marks=marks)


def test_one_scan(spark):
    plan = fill_middle.transform(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_equal_to_sql(spark, duck):
    assert rows(fill_middle.op12_fill_in_middle(spark, SMALL)) == duck_rows(duck, fill_middle.ORACLE_SQL)
