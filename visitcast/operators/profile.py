"""Descriptive statistics of a table before cleaning.

Defined results: nulls are counted and left out of all else; a column of nulls has null
figures and 0 distinct values, a single value a null deviation; null is a value among the frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIGURES = ("n", "nulls", "n_distinct", "min", "max", "mean", "std")


def profile(df: DataFrame, cols: list[str], exact: bool = False) -> DataFrame:
    """column, n, nulls, n_distinct, min, max, mean, std: one row per numeric column, all in one aggregation.

    Distinct values are estimated, in one pass; exact counts shuffle every value of every column.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), count(c).alias("n_distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")))
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def frequencies(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; ties by value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(col)).limit(k)


def sketches(df: DataFrame, cols: list[str], part: Column, log2_slots: int = 12, items: int = 1000) -> DataFrame:
    """part, column, n, nulls, least, most, known, mean, m2, distinct, top: mergeable figures of each numeric column in each part.

    One pass with partial aggregation, no value is shuffled. `distinct` is a HyperLogLog sketch with a standard error
    of about 1.04 / sqrt(2^log2_slots) (1.6 % at 12), `top` a heavy-hitter sketch of `items` values whose counts are
    low by at most 1 / (0.75 * items) of the rows. Stored by part (a month), they are merged without reading the
    rows again; a part that changes is made anew alone.
    """
    each = []
    for c in cols:
        x = F.col(c).cast("double")
        figures = {
            "column": F.lit(c), "n": F.count("*"), "nulls": F.count_if(F.col(c).isNull()), "least": F.min(x), "most": F.max(x), "known": F.count(c), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(c),
            "distinct": F.hll_sketch_agg(F.col(c).cast("string"), log2_slots), "top": F.expr(f"approx_top_k_accumulate(CAST(`{c}` AS DOUBLE), {items})"),
        }
        each.append(F.struct(*[v.alias(k) for k, v in figures.items()]))
    return df.groupBy(part.alias("part")).agg(F.array(*each).alias("rows")).select("part", F.inline("rows"))


def merged_profile(parts: DataFrame) -> DataFrame:
    """The figures of profile() from sketches(): all exact but n_distinct, an estimate.

    Means and deviations are merged pairwise from each part's mean and sum of squares about it, so
    that large values with a small spread don't cancel.
    """
    moments = F.filter(F.collect_list(F.struct(F.col("known").cast("double").alias("n"), "mean", "m2")), lambda p: p["n"] > 0)

    def join(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    grouped = parts.groupBy("column").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.min("least").alias("min"), F.max("most").alias("max"), F.aggregate(moments, start, join).alias("_m"))
    n = F.col("_m.n")
    return grouped.select("column", "n", "nulls", "n_distinct", "min", "max", F.when(n > 0, F.col("_m.mean")).alias("mean"), F.when(n > 1, F.sqrt(F.col("_m.m2") / (n - 1))).alias("std"))


def merged_frequencies(parts: DataFrame, k: int) -> DataFrame:
    """column, value, n: about the k most frequent values of each column; a count is low by at most the sketches' error."""
    best = parts.groupBy("column").agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(top), {k})").alias("best"))
    return best.select("column", F.explode("best").alias("b")).select("column", F.col("b.item").alias("value"), F.col("b.count").alias("n"))
