"""Environment series: complete grid, Lagrange fill, daily features per district.

Defined results: null values are gaps; a series of nulls stays null; rows whose key is null are
series of their own in a window but are not filled; several values at one t are each an
observation; statistics of too few values are null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitcast.functions.stats import array_mean, array_std, multi, std, trimmed


def complete_grid(df: DataFrame, keys: list[str], t: str, step: int | str = 1) -> DataFrame:
    """df with a row for every step between each series' first and last t; missing values are null.

    t is a number and step an integer, or t a timestamp or date and step an interval such as '1 hour'.
    """
    width = F.lit(step) if isinstance(step, int) else F.expr(f"INTERVAL {step}")
    spans = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi", width)).alias(t))
    return grid.join(df, [*keys, t], "left")


def running_count(df: DataFrame, keys: list[str], t: str, v: str, block: float = 4096, name: str = "_n") -> DataFrame:
    """df with the number of non-null v of the series up to t (t included), in two passes.

    Blocks of `block` units of t are counted, their sums before each block are running sums over
    blocks alone, and rows are counted within their block: a long series is shared by many tasks.
    """
    cut = df.withColumn("_b", F.floor(F.col(t) / block))
    totals = cut.groupBy(*keys, "_b").agg(F.count(v).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_b").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, [*keys, "_b"], "left").withColumn(name, F.coalesce("_before", F.lit(0)) + F.count(v).over(within)).drop("_b", "_before")


def fill_lagrange(df: DataFrame, keys: list[str], t: str, v: str, k: int = 2, bounds: tuple[float, float] | None = None, block: float = 4096) -> DataFrame:
    """df with `filled` and `known_at`: v, and in inner gaps the polynomial through up to k observed values on each side.

    known_at is the t from which on the value can be known: its own for an observed one, that of
    the last node for a filled one. t must be a number of moderate size, such as hours since the
    series began. A gap at an end stays null. Only the gap rows are multiplied (2k each) and meet
    the observed rows in an equi-join on series and ordinal; ordinals are counted in blocks of t.
    """
    seen = running_count(df, keys, t, v, block)
    known = seen.filter(F.col(v).isNotNull()).select(*keys, F.col("_n").alias("_o"), F.col(t).cast("double").alias("_x"), F.col(v).cast("double").alias("_y"))
    gaps = seen.filter(F.col(v).isNull()).select(*keys, t, "_n", F.explode(F.sequence(F.col("_n") - k + 1, F.col("_n") + k)).alias("_o"))
    nodes = gaps.join(known, [*keys, "_o"]).groupBy(*keys, t).agg(F.sort_array(F.collect_list(F.struct("_x", "_y"))).alias("_nodes"), F.count_if(F.col("_o") <= F.col("_n")).alias("_before"), F.count_if(F.col("_o") > F.col("_n")).alias("_after"))
    at, pts = F.col(t).cast("double"), F.col("_nodes")

    def term(p: Column) -> Column:
        others = F.filter(pts, lambda q: q["_x"] != p["_x"])
        return F.aggregate(others, p["_y"], lambda s, q: s * (at - q["_x"]) / (p["_x"] - q["_x"]))

    value = F.aggregate(F.transform(pts, term), F.lit(0.0), lambda s, x: s + x)
    if bounds:
        value = F.greatest(F.lit(float(bounds[0])), F.least(F.lit(float(bounds[1])), value))
    filled = nodes.filter("_before > 0 AND _after > 0").select(*keys, t, value.alias("_value"), F.element_at(pts, -1)["_x"].alias("_last"))
    out = df.join(filled, [*keys, t], "left")
    return out.withColumns({"filled": F.coalesce(F.col(v).cast("double"), "_value"), "known_at": F.when(F.col(v).isNotNull(), at).otherwise(F.col("_last"))}).drop("_value", "_last")


def features_as_of(filled: DataFrame, t: str = "t", days: int = 7, per_day: float = 24, keys: tuple[str, ...] = ("district", "indicator"), ddof: int = 1) -> DataFrame:
    """keys, day, lag, n, x_mean, x_mean_remove, x_std, x_std_remove, known_at: daily features as they are known `lag` days later.

    `filled` comes from fill_lagrange, with `per_day` units of t a day. Seen from the target day day + lag, a value
    counts only if its last node lies before that day: what a later reading fills in is missing from the features of
    the days that come before it. The values of one day are gathered once for all lags.
    """
    day = F.floor(F.col(t) / per_day)
    late = F.floor(F.col("known_at") / per_day) - day
    daily = filled.filter(F.col("filled").isNotNull()).groupBy(*keys, day.cast("int").alias("day")).agg(F.collect_list(F.struct(F.col("filled").alias("v"), late.alias("late"), "known_at")).alias("_all"))
    seen = daily.select(*keys, "day", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("lag"), "_all").withColumn("_seen", F.filter("_all", lambda s: s["late"] < F.col("lag")))
    values = seen.withColumn("_v", F.array_sort(F.transform("_seen", lambda s: s["v"])))
    inner = trimmed(F.col("_v"))
    return values.select(*keys, "day", "lag", F.size("_v").alias("n"), array_mean(F.col("_v")).alias("x_mean"), array_mean(inner).alias("x_mean_remove"), array_std(F.col("_v"), ddof).alias("x_std"), array_std(inner, ddof).alias("x_std_remove"), F.array_max(F.transform("_seen", lambda s: s["known_at"])).alias("known_at"))


def history_as_of(features: DataFrame, indicators: list[str], days: int = 7, fields: tuple[str, ...] = ("mean", "mean_remove", "std", "std_remove")) -> DataFrame:
    """target, district and <indicator>_<field>_lag<i>: the features of features_as_of() under the day that they serve."""
    pick = lambda i, f, d: F.first(F.when((F.col("indicator") == i) & (F.col("lag") == d), F.col(f"x_{f}")), ignorenulls=True).alias(f"{i}_{f}_lag{d}")
    chosen = features.filter(F.col("indicator").isin(indicators)).withColumn("target", F.col("day") + F.col("lag"))
    return chosen.groupBy("target", "district").agg(*[pick(i, f, d) for i in indicators for f in fields for d in range(1, days + 1)])


def air_features(readings: DataFrame, ddof: int = 1) -> DataFrame:
    """date, district, indicator, x_mean, x_mean_remove, x_std, x_std_remove, x_multi from ts, district, indicator, value."""
    daily = readings.groupBy(F.to_date("ts").alias("date"), "district", "indicator").agg(F.avg("value").alias("x_mean"), std("value", ddof).alias("x_std"), multi("value").alias("x_multi"))
    inner = trimmed(F.col("x_multi"))
    return daily.select("date", "district", "indicator", "x_mean", array_mean(inner).alias("x_mean_remove"), "x_std", array_std(inner, ddof).alias("x_std_remove"), "x_multi")


def pivot_indicators(features: DataFrame, indicators: list[str], fields: tuple[str, ...] = ("mean", "mean_remove", "std", "std_remove", "multi")) -> DataFrame:
    """date, district and <indicator>_<field> for a fixed list of indicators, by conditional aggregation."""
    pick = lambda i, f: F.first(F.when(F.col("indicator") == i, F.col(f"x_{f}")), ignorenulls=True).alias(f"{i}_{f}")
    return features.filter(F.col("indicator").isin(indicators)).groupBy("date", "district").agg(*[pick(i, f) for i in indicators for f in fields])


def weather_features(readings: DataFrame, indicators: list[str], ddof: int = 1) -> DataFrame:
    return pivot_indicators(air_features(readings.filter(F.col("indicator").isin(indicators)), ddof), indicators)
