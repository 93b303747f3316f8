"""Corpus pipeline over `documents`: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

All stages but the last return the columns of `documents`; the last returns the
ids of every text in place of the text. ORACLE_SQL is None: SQL can't express the
tokenizer. tests/llm holds the stages against brute force, and the first four
against the SQL of their operators.

Odd rows, in every stage: an empty table gives an empty one; columns beyond those of
`documents` pass through all stages but the last; repeated rows and ties are treated
as the docstrings below say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitcast.llm import decontaminate, line_dedup, minhash, quality_rules, sentencepiece_codec
from visitcast.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.

    Null, empty and short texts go; a null language or source is a group of its own; repeated rows stay or go together.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines of repeated three-line windows; n_chars follows the text.

    Null and empty texts and texts of fewer than three lines stay as they are; of equal windows the first place stays.
    """
    cut = line_dedup.dedup(docs)
    return cut.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles.

    The one of the smallest doc_id stays. Null and empty texts and rows without doc_id are linked with nothing and stay;
    of rows that repeat a doc_id one stays.
    """
    return minhash.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`.

    Null and empty texts hold none; items without a token match nothing; repeated rows stay or go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, token_ids and whether the ids decode to the text.

    A null text has null ids and 0 tokens, an empty one no ids; repeated rows are encoded each.
    """
    found = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), keep_text=False)
    return found.selectExpr("doc_id", "lang", "source", "n_chars", "_n_tokens AS n_tokens", "_token_ids AS token_ids", "_round_trip AS round_trip")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
