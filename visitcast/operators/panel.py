"""Dense panel, merge of the feature tables, history of the days before, target.

Defined results: rows of feature tables whose keys are null or not in the panel are left
out; repeated districts and diseases are one; without days, districts or diseases the panel is
empty; days before the first one are null in the history.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTS = ("visit_amount", "death_amount", "emergency_amount")


def panel(spark: SparkSession, start: date, end: date, districts: DataFrame, diseases: DataFrame) -> DataFrame:
    """Every date from start to end with every district and disease; the two lists are dimensions."""
    return panel_over(spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end")), districts, diseases)


def span(df: DataFrame, day: str) -> DataFrame:
    """start, end: the first and last day of a table, one row."""
    return df.agg(F.min(day).alias("start"), F.max(day).alias("end"))


def panel_over(days: DataFrame, districts: DataFrame, diseases: DataFrame) -> DataFrame:
    """panel() from `start` to `end` of a one-row table, without reading it first."""
    dates = days.select(F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date"))
    lists = districts.select("district").distinct().agg(F.sort_array(F.collect_list("district")).alias("_a")), diseases.select("disease").distinct().agg(F.sort_array(F.collect_list("disease")).alias("_b"))
    # Two one-row tables: the panel itself arises in parallel from the exploded lists.
    return dates.join(F.broadcast(lists[0])).join(F.broadcast(lists[1])).repartition("date").select("date", F.explode("_a").alias("district"), "_b").select("date", "district", F.explode("_b").alias("disease"))


def merge_features(base: DataFrame, visits: DataFrame | None = None, air: DataFrame | None = None, deaths: DataFrame | None = None, weather: DataFrame | None = None, emergency: DataFrame | None = None, embedding: DataFrame | None = None) -> DataFrame:
    """base with the given tables left-joined: by date, district and disease, or date and district.

    The tables by date and district are put together first, on the keys that they are grouped by already, so that
    the panel, larger by the number of diseases, is shuffled for them once. Whether a table is small enough to
    broadcast is known once it is aggregated, so that is left to adaptive execution.
    """
    out = base
    for t in (visits, embedding):
        if t is not None:
            out = out.join(t, ["date", "district", "disease"], "left")
    daily = [t for t in (air, deaths, weather, emergency) if t is not None]
    if not daily:
        return out
    return out.join(reduce(lambda a, b: a.join(b, ["date", "district"], "full_outer"), daily), ["date", "district"], "left")


def fill_counts(df: DataFrame, counts: tuple[str, ...] = COUNTS, value: int = 0) -> DataFrame:
    """Counts of days without rows are 0; means and shares stay null."""
    return df.fillna(value, [c for c in counts if c in df.columns])


def add_history(df: DataFrame, cols: list[str], days: int = 7, dense: bool = True, keys: tuple[str, ...] = ("district", "disease"), block: int = 56) -> DataFrame:
    """df with <col>_lag1 ... _lag<days>: the values of the days before.

    dense: right only if every key has every date. Time is cut into blocks of `block` days, each
    with a copy of the `days` days before it, so that a series is many windows and tasks aren't
    bounded by the number of series; all lags of a block come from one window. Otherwise each
    row is sent to the days it is history of and met there by date.
    """
    if dense:
        if block < days:
            raise ValueError("a block has to be as long as the history")
        day = F.unix_date("date")
        own = F.floor(day / block)
        ends = F.pmod(day, F.lit(block)) >= block - days
        sent = df.withColumn("_block", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))))
        w = Window.partitionBy(*keys, "_block").orderBy("date")
        lagged = sent.select("*", *[F.lag(c, i).over(w).alias(f"{c}_lag{i}") for c in cols for i in range(1, days + 1)])
        return lagged.filter(F.col("_block").eqNullSafe(own)).drop("_block")
    sent = df.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_i"), "date", *cols).withColumn("date", F.date_add("date", F.col("_i")))
    past = sent.groupBy(*keys, "date").agg(*[F.first(F.when(F.col("_i") == i, F.col(c)), ignorenulls=True).alias(f"{c}_lag{i}") for c in cols for i in range(1, days + 1)])
    return df.join(past, [*keys, "date"], "left")


def add_target(df: DataFrame, count: str = "visit_amount") -> DataFrame:
    """df with `target`: the visits of the row's own day."""
    return df.withColumn("target", F.col(count))


def add_weekday(df: DataFrame) -> DataFrame:
    """df with the target day's weekday, Monday 0."""
    return df.withColumn("weekday", F.weekday("date"))


def full_history(df: DataFrame, start: date | DataFrame, days: int = 7) -> DataFrame:
    """Rows with all their days before; start: the panel's first day, or the one-row table of span()."""
    if isinstance(start, DataFrame):
        return df.join(F.broadcast(start.select(F.col("start").alias("_start"))), F.col("date") >= F.date_add("_start", days)).drop("_start")
    return df.filter(F.col("date") >= F.date_add(F.lit(start), days))
