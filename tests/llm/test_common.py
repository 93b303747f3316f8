"""Shared pieces: sampling, size-checked joins, scratch tables."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from helpers import documents, odd
from pyspark.sql import functions as F

from visitcast.llm import common


def test_sampled_is_the_smallest_hashes(spark):
    df = documents(spark, [f"t{i}" for i in range(3000)]).select("doc_id", "text")
    for rows in (0, 1, 500, 2999, 5000):
        whole = df.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(rows)
        got = common.sampled(df, rows, "doc_id")
        assert {r.doc_id for r in got.collect()} == {r.doc_id for r in whole.collect()} and got.count() == min(rows, 3000)
    assert common.sampled(df.limit(0), 10, "doc_id").count() == 0


def test_small_is_checked(spark):
    df = spark.range(100)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(common.small(df, 100)) and "ResolvedHint" not in plan(common.small(df, 99))


def test_without_takes_rows_by_id_and_text(spark):
    docs = odd(spark)
    bad = common.keyed(docs).filter("text = 'first text of eight' OR text = 'no id here at all'")
    for rows in (0, 10):
        left = common.without(docs, bad, rows)
        assert left.columns == docs.columns and left.count() == 10
        assert left.filter("doc_id = 8").count() == 1 and left.filter("doc_id IS NULL").count() == 1


def test_written_survives_its_source(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/a")
    kept = common.written(spark.read.parquet(f"{tmp_path}/a"), "test")
    for p in (tmp_path / "a").iterdir():
        p.unlink()
    assert kept.count() == 10


def test_shared_dir_is_the_sessions():
    """The cluster's folder is read from the session; only where it is unset is another made."""
    session = SimpleNamespace(conf={"spark.checkpoint.dir": "file:///tmp/of-the-cluster/"}, sparkContext=None)
    assert common.shared_dir(session) == "file:///tmp/of-the-cluster"
    bare = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(applicationId="none", master="local[2]", getCheckpointDir=lambda: None))
    assert common.shared_dir(bare).startswith("file:///") and common.shared_dir(bare) == common.shared_dir(bare)
    bare.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(bare)


def test_scratch_is_cleared(spark):
    kept = common.written(spark.range(10), "test")
    path = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and common.clear_scratch(spark) > 0
    assert not path.exists() and common.clear_scratch(spark) == 0


def test_spread_deals_small_scans(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    scan = spark.read.parquet(f"{tmp_path}/one")
    assert common.spread(scan).count() == 10 and common.spread(spark.range(10)) is not None
    assert common.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
