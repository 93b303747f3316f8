"""The pipeline: each stage on what its predecessor kept, against the SQL of its operator."""

from __future__ import annotations

import duckdb
from conftest import SMALL, duck_rows, rows
from helpers import empty, odd

import corpus_pipeline as p
from visitcast.llm import decontaminate, line_dedup, minhash, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    cols = "d.doc_id, d.text, d.lang, d.source, d.n_chars"
    sql = {
        "quality_rules": f"WITH {quality_rules._sql('docs')} SELECT doc_id, text, lang, source, n_chars FROM judged WHERE kept",
        "line_dedup": f"WITH {line_dedup._sql('docs')} SELECT doc_id, text, lang, source, CASE WHEN n_removed > 0 THEN length(text) ELSE n_chars END AS n_chars FROM deduped",
        "minhash_near_dedup": f"WITH RECURSIVE {minhash._sql('docs', 5, 80)} SELECT {cols} FROM docs d JOIN grouped USING (doc_id) WHERE kept",
        "benchmark_decontamination": f"WITH {decontaminate._sql('docs')} SELECT {cols} FROM docs d WHERE doc_id NOT IN (SELECT doc_id FROM leaked)",
    }
    assert [n for n, _ in p.STAGES] == [*sql, "sentencepiece"]
    for name, stage in p.STAGES[:-1]:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        c.sql(f"CREATE OR REPLACE VIEW docs AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        docs = stage(spark, docs, SMALL)
        assert docs.columns == COLUMNS
        assert rows(docs) == duck_rows(c, sql[name]), name
    last = p.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()} and last.filter("NOT round_trip").count() == 0
    assert rows(p.run(spark, SMALL)) == rows(last)


def test_odd_and_empty(spark, tmp_path):
    for name, docs in (("odd", odd(spark)), ("empty", empty(spark))):
        for k, (_, stage) in enumerate(p.STAGES):
            docs = stage(spark, docs, SMALL)
            docs.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
