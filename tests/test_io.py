"""Sources and sinks: parts of a database table, months of the wide table."""

from __future__ import annotations

import random
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from visitcast.sources import io

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def database(spark, tmp_path):
    def make(df, name="T"):
        url = f"jdbc:derby:{tmp_path}/db;create=true"
        df.write.format("jdbc").options(url=url, dbtable=name, driver=DRIVER).save()
        return url

    return make


def _sizes(df) -> list[int]:
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_skewed_key_with_nulls(spark, database):
    """Parts within twice the mean although most keys are small; rows without a key come once."""
    r = random.Random(1)
    data = [(None if r.random() < 0.05 else int(r.paretovariate(0.6) * 10), i) for i in range(4000)]
    url = database(spark.createDataFrame(data, "id long, v long"))
    even = io.read_table(spark, url, "T", ('"id"', 0, max(x for x, _ in data if x), 8), driver=DRIVER)
    assert max(_sizes(even)) > 3500  # equal widths put nearly all into one part
    got = io.read_spread(spark, url, "T", '"id"', 8, driver=DRIVER)
    assert got.rdd.getNumPartitions() == 8 and max(_sizes(got)) < 2 * 4000 / 8
    assert sorted((x.id is None, x.id or 0, x.v) for x in got.collect()) == sorted((a is None, a or 0, b) for a, b in data)
    part = io.read_spread(spark, url, "T", '"id"', 8, sample='MOD("v", 5) = 0', driver=DRIVER)
    assert part.count() == 4000 and max(_sizes(part)) < 2.5 * 4000 / 8


def test_keys_of_other_kinds(spark, database):
    r = random.Random(2)
    df = spark.createDataFrame([(date(2020, 1, 1 + r.randint(0, 27)), r.choice("abcdefgh") + "'x", i) for i in range(600)], "d date, t string, v long")
    url = database(df)
    for key in ('"d"', 'CAST("t" AS VARCHAR(40))'):
        got = io.read_spread(spark, url, "T", key, 4, driver=DRIVER)
        assert 2 <= got.rdd.getNumPartitions() <= 4 and sorted(x.v for x in got.collect()) == list(range(600))
    with pytest.raises(ValueError):
        io._literal(b"x")


def test_one_value_and_none(spark, database):
    url = database(spark.range(50).select(F.lit(7).alias("id"), F.col("id").alias("v")), "A")
    assert sorted(_sizes(io.read_spread(spark, url, "A", '"id"', 4, driver=DRIVER))) == [50]
    url = database(spark.range(5).select(F.lit(None).cast("int").alias("id"), F.col("id").alias("v")), "B")
    assert io.read_spread(spark, url, "B", '"id"', 4, driver=DRIVER).count() == 5


def _months(spark, path):
    return {r.month: (r.n, r.s) for r in spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}


def test_months_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/wide"
    df = spark.createDataFrame([(date(2020, 1 + i % 2, 1 + i % 28), i) for i in range(100)] + [(None, 5)], "date date, v long")
    io.save_wide(df, path)
    first = _months(spark, path)
    assert set(map(str, first)) == {"2020-01", "2020-02", "None"}
    new = df.filter("month(date) = 2").withColumn("v", F.lit(1).cast("long"))
    for _ in range(2):  # a repeated write changes nothing more
        io.save_wide(new, path)
        got = _months(spark, path)
        assert {str(k): v for k, v in got.items()} == {str(k): v for k, v in first.items()} | {"2020-02": (50, 50)}
    io.save_wide(df.limit(0), path)
    assert _months(spark, path) == got
    assert rows(spark.read.parquet(path).filter("month = '2020-02'").select("date", "v")) == rows(new)


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/wide"
    df = spark.createDataFrame([(date(2020, 1, 1), 1), (date(2020, 2, 1), 2)], "date date, v long")
    io.save_wide(df, path)
    broken = df.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("broken")).cast("long")).otherwise(9))
    with pytest.raises(Exception, match="broken"):
        io.save_wide(broken, path)
    assert {str(k): v for k, v in _months(spark, path).items()} == {"2020-01": (1, 1), "2020-02": (1, 2)}
