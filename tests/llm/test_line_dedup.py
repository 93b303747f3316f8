"""Line dedup against SQL and a plain loop."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL, duck_rows, rows
from helpers import documents, empty, odd
from pyspark.sql import functions as F

from visitcast.llm import line_dedup


def brute(texts):
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_equal_to_brute_force(spark, broadcast_rows):
    r = random.Random(2)
    texts = ["\n".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(1, 12))) for _ in range(80)] + ["a\na\na\na\na", "\n\n\n\n", "x\ny"]
    got = line_dedup.dedup(documents(spark, texts), broadcast_rows=broadcast_rows).orderBy("doc_id").collect()
    assert [g.text for g in got] == brute(texts)
    assert all(g._n_removed == len(t.split("\n")) - (len(g.text.split("\n")) if g._n_removed < len(t.split("\n")) else 0) for g, t in zip(got, texts, strict=True))


def test_equal_to_sql(spark, duck):
    assert rows(line_dedup.op3_line_dedup(spark, SMALL)) == duck_rows(duck, line_dedup.ORACLE_SQL)


def test_odd_rows(spark):
    df = odd(spark)
    got = line_dedup.dedup(df)
    assert got.count() == 12 and got.columns[: len(df.columns)] == df.columns
    assert rows(got.filter("doc_id = 7").select("text")) == rows(df.filter("doc_id = 7").select("text"))
    assert got.filter(F.col("text").isNull() & (F.col("_n_lines") == 0)).count() == 2
    assert line_dedup.dedup(empty(spark)).count() == 0
