"""What the joins of the visits carry and how often they are made, and that the results stay."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from visitcast.operators import cleaning
from visitcast.plans import bindings as b
from visitcast.plans import queries as jobs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(df) -> int:
    """How often the plan reads the lines."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


@pytest.mark.parametrize("name", ["visit_dedup", "visit_features", "history_dense", "history_sparse", "merge_features", "patient_sentences"])
def test_visits_move_keys(spark, name):
    """No column of the lines but their keys is read."""
    plan = _plan(jobs.QUERIES[name](spark, SMALL))
    assert "l_partkey" in plan and not [c for c in b.LINE[3:] if c in plan]


def test_lines_equal_in_their_keys_are_equal_visits(spark):
    """Why KEYS do for the order: nothing of a visit differs between lines of the same keys."""
    v = b.visits(spark, SMALL)
    assert set(v.columns) & set(b.LINE) == set(b.KEYS)
    assert v.distinct().groupBy(*b.KEYS).count().filter("count > 1").count() == 0


def test_raw_visits_joined_once(spark, monkeypatch):
    """Codes, blocks and districts come from the dimensions, so that one reading of the lines makes the cleaned visits."""
    made = {}
    monkeypatch.setattr(jobs, "once", lambda spark, key, make: made.setdefault(key, make()))
    jobs.QUERIES["clean_visits"](spark, SMALL)
    (tables,) = made.values()
    assert _lines(tables["clean-visits"]) == 1 and not [c for c in b.LINE if c in tables["clean-visits"].columns]


def test_texts_given_or_gathered(spark):
    """Tables of all texts and addresses give what is gathered from the visits gives."""
    raw = b.raw_visits(spark, SMALL).filter(F.col("l_orderkey") % 5 == 0).localCheckpoint()
    where = b.points(spark, SMALL).join(b.addresses(spark, SMALL), "c_custkey").select("address", "lon", "lat")
    names = b.table(spark, SMALL, "region").select(F.col("r_name").alias("district"))
    args = (raw, b.icd(spark, SMALL), b.blocks(spark), where, b.polygons(spark), names, b.KEYS, b.CITY)
    texts, places = b.dirty(spark, SMALL).select(F.col("raw").alias("disease_raw")), b.addresses(spark, SMALL).select(F.col("address").alias("current_address"))
    got = rows(cleaning.clean_visits(*args, texts=texts, places=places))
    assert got and got == rows(cleaning.clean_visits(*args))


@pytest.mark.parametrize("name", ["word2vec_patients", "embedding_features", "patients_as_of", "embedding_as_of"])
def test_visits_of_patients_are_stored(spark, name):
    """What reads the visits several times reads them as they were written once, not their joins."""
    assert _lines(jobs.QUERIES[name](spark, SMALL)) == 0


def test_dealt_by_patient_once(spark):
    """Codes, states and days of a patient meet where they were dealt to: no vector is shuffled for them."""
    moved = [x for x in _plan(jobs.QUERIES["patients_as_of"](spark, SMALL)).splitlines() if "Exchange hashpartitioning(patient_id" in x]
    assert len(moved) == 2 and all("REPARTITION_BY_COL" in x for x in moved)


def test_forest_reads_stored_visits(spark):
    """The wide table with vectors takes its counts, too, from the visits as they were written once."""
    assert _lines(jobs._wide(spark, SMALL, jobs._word_vectors(spark, SMALL), filled=True)) == 0


@pytest.mark.parametrize("name", ["curve", "r2_by_series", "wide_table", "weekday_target"])
def test_more_visits_move_keys(spark, name):
    """As test_visits_move_keys, for the queries on the history."""
    plan = _plan(jobs.QUERIES[name](spark, SMALL))
    assert "l_partkey" in plan and not [c for c in b.LINE[3:] if c in plan]


@pytest.mark.parametrize("name", ["curve", "patient_sentences", "r2_by_series", "merge_features", "visit_features", "history_sparse", "wide_table"])
def test_lines_not_dealt_by_supplier(spark, monkeypatch, name):
    """Where tables are too large to be broadcast of themselves, the lines meet few suppliers where they are read; many are shuffled."""
    monkeypatch.setattr(b, "SENT", b.SENT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(l_suppkey" not in _plan(jobs.QUERIES[name](spark, SMALL))
        b.SENT = 0
        assert "hashpartitioning(l_suppkey" in _plan(jobs.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_visits_with_few_or_many_suppliers(spark, monkeypatch):
    few = rows(b.visits(spark, SMALL).filter("l_orderkey % 7 = 0"))
    monkeypatch.setattr(b, "SENT", 0)
    assert few and few == rows(b.visits(spark, SMALL).filter("l_orderkey % 7 = 0"))


def _shuffled(df, by: str) -> list[set[str]]:
    """The columns of each shuffle by a column."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    found = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(" + by + r"#\d+L?, ", df._jdf.queryExecution().explainString(mode))
    return [{c.split("#")[0].strip() for c in cols.split(",")} for cols in found]


@pytest.mark.parametrize("name", ["patient_sentences", "r2_by_series", "merge_features", "visit_features", "history_sparse", "wide_table"])
def test_shuffles_carry_what_cannot_be_had_later(spark, name):
    """Lines go to their orders with their keys alone; visits go to their patients without gender and age."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = jobs.QUERIES[name](spark, SMALL)
        assert set(b.KEYS) in _shuffled(df, "l_orderkey")
        dealt = _shuffled(df, "patient_id")
        assert dealt and all({"patient_id", *b.KEYS} <= d and not {"gender", "age", "registered_address"} & d for d in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_described_as_joined(spark):
    """Gender and age found from the patient are those of the customer's key."""
    v = b.visits(spark, SMALL).join(b.table(spark, SMALL, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    unlike = ~F.col("gender").eqNullSafe(b._gender("o_custkey")) | ~F.col("age").eqNullSafe((F.col("o_custkey") % 90 + 1).cast("int"))
    assert v.count() and not v.filter(unlike).count()
