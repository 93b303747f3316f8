"""Aggregates and array statistics that several feature tables share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def std(col: Column | str, ddof: int = 1) -> Column:
    return F.stddev_samp(col) if ddof == 1 else F.stddev_pop(col)


def multi(col: Column | str) -> Column:
    """All non-null values of the group, sorted."""
    return F.sort_array(F.collect_list(col))


def trimmed(values: Column) -> Column:
    """A sorted array without one smallest and one largest value."""
    return F.when(F.size(values) > 2, F.slice(values, 2, F.greatest(F.size(values) - 2, F.lit(0))))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def array_std(values: Column, ddof: int = 1) -> Column:
    """In two passes, so that large values with a small spread don't cancel; the mean is taken once and carried along."""
    start = F.struct(array_mean(values).alias("m"), F.lit(0.0).alias("s"))
    squares = F.aggregate(values, start, lambda a, x: F.struct(a["m"].alias("m"), (a["s"] + (x - a["m"]) * (x - a["m"])).alias("s")), lambda a: a["s"])
    return F.when(F.size(values) > ddof, F.sqrt(squares / (F.size(values) - ddof)))


def share(col: str, value: str) -> Column:
    """Share of a value among the non-null ones; null if there is none."""
    return F.count_if(F.col(col) == value) / F.nullif(F.count(col), F.lit(0))
