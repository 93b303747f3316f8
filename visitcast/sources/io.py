"""Sources and sinks: database tables in, cleaned and wide tables and curves as Parquet."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampType


def read_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; partition (column, lower, upper, parts) splits the scan over that many connections."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()


def _literal(value: object) -> str:
    """A bound as SQL text that databases share; keys are numbers, dates or texts."""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal, date, str)):
        raise ValueError(f"keys of type {type(value).__name__} can't be split")
    if isinstance(value, datetime):
        return f"CAST('{value:%Y-%m-%d %H:%M:%S.%f}' AS TIMESTAMP)"
    if isinstance(value, date):
        return f"CAST('{value}' AS DATE)"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def key_bounds(spark: SparkSession, url: str, table: str, key: str, parts: int, sample: str | None = None, accuracy: int = 10_000, **options: str) -> list[object]:
    """At most parts - 1 rising values of the key that cut the table's rows into about equal parts.

    A probe reads the key column alone. `sample`, a condition in the database's SQL such as
    "MOD(ID, 97) = 0", makes it a sample; the parts are then even as far as the sample is.
    Equal bounds are one, so a value that fills several parts is read by one connection.
    """
    where = f" WHERE {sample}" if sample else ""
    keys = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT {key} AS k FROM {table}{where}) probe", **options).load()
    keys = keys.toDF("k").filter("k IS NOT NULL")
    if isinstance(keys.schema["k"].dataType, (NumericType, DateType, TimestampType)):
        places = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        found = keys.agg(F.percentile_approx("k", places, F.lit(accuracy)).alias("q")).first().q if parts > 1 else []
    else:  # texts have no quantile sketch: the ends of ranges sorted by a sampling exchange
        ends = keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).orderBy("p").collect()
        found = [r.k for r in ends][1:]
    return sorted(set(found or []))


def read_spread(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, sample: str | None = None, **options: str) -> DataFrame:
    """A database table in parts of about equal numbers of rows, whatever the key's distribution.

    The bounds come from key_bounds(); each part is one condition on the key, the first takes the rows
    without a key as well, so that every row is read once. `key` is written as the database wants it
    (quoted if need be). A table without keys is read in one part.
    """
    bounds = [_literal(x) for x in key_bounds(spark, url, table, key, parts, sample, **options)]
    if not bounds:
        return read_table(spark, url, table, **options)
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    conditions = [f"{key} < {bounds[0]} OR {key} IS NULL", *inner, f"{key} >= {bounds[-1]}"]
    return spark.read.jdbc(url, table, predicates=conditions, properties={k: str(v) for k, v in options.items()})


def save_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_clean(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def save_wide(df: DataFrame, path: str, day: str = "date") -> None:
    """Partitioned by month; by day would make a tiny file for each. Rows without a date are a month of their own.

    Months that df holds replace what the table has of them, all others stay. Spark writes the new files
    beside the table and puts the months in place when all tasks have ended, so a write that fails changes
    nothing and one that is repeated changes nothing more. A large month is split over several tasks.
    """
    months = df.withColumn("month", F.date_format(day, "yyyy-MM")).hint("rebalance", "month")
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def save_curve(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
