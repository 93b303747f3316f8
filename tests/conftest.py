"""A Spark session for all tests, and DuckDB over the small test tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(x):
    """A value in the form that both engines share."""
    if isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return round(x, 4)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(df) -> list[tuple]:
    """Rows of a Spark DataFrame, columns by name, sorted."""
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(c, sql: str) -> list[tuple]:
    found = c.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
