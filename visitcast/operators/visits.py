"""Filters and dedup of visits; daily counts and statistics of visits, deaths and emergencies.

Defined results: a null address fits no city, a null patient is no placeholder; null keys
are equal in the dedup, whose order has to be total; null ages and genders count as visits only,
shares leave unknown genders out and are null without any known; groups with null keys stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitcast.functions.stats import multi, share, std

GENDERS = ("M", "F")
VISIT_KEY = ("patient_id", "visit_date", "gy_bm")


def in_city(df: DataFrame, current: str, registered: str, city: str = "广州", prefix: str | None = None) -> DataFrame:
    """Rows whose current or registered address names the city (or begins with a code); a null on one side hides nothing."""

    def fits(c: str) -> Column:
        found = F.col(c).contains(city)
        return F.coalesce(found | F.col(c).startswith(prefix) if prefix else found, F.lit(False))

    return df.filter(fits(current) | fits(registered))


def drop_placeholder(df: DataFrame, ids: tuple[str, ...] = ("01",), patient: str = "patient_id") -> DataFrame:
    """Rows of real patients; a null id stays."""
    return df.filter(~F.coalesce(F.col(patient).isin(*ids), F.lit(False)))


def dedup_visits(df: DataFrame, order_by: list[str], keys: tuple[str, ...] = VISIT_KEY) -> DataFrame:
    """The first row of each key in a total order."""
    first = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def person_stats(df: DataFrame, keys: list[Column | str], prefix: str, ddof: int = 1, genders: tuple[str, ...] = GENDERS) -> DataFrame:
    """<prefix>_amount, _gender (map of shares), _gender_<g>, _age_mean, _age_std, _age_multi per group."""
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}_amount"),
        *[share("gender", g).alias(f"{prefix}_gender_{g.lower()}") for g in genders],
        F.avg("age").alias(f"{prefix}_age_mean"),
        std("age", ddof).alias(f"{prefix}_age_std"),
        multi("age").alias(f"{prefix}_age_multi"),
    )
    shares = F.create_map(*[x for g in genders for x in (F.lit(g), F.col(f"{prefix}_gender_{g.lower()}"))])
    return grouped.withColumn(f"{prefix}_gender", F.when(F.col(f"{prefix}_gender_{genders[0].lower()}").isNotNull(), shares))


def visit_features(visits: DataFrame, ddof: int = 1) -> DataFrame:
    return person_stats(visits, [F.col("visit_date").alias("date"), "district", "disease"], "visit", ddof)


def death_features(deaths: DataFrame, ddof: int = 1) -> DataFrame:
    return person_stats(deaths, ["date", "district"], "death", ddof)


def emergency_features(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("visit_date").alias("date"), "district").agg(F.count("*").alias("emergency_amount"))
