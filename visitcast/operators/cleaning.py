"""Raw visit records to clean visits: fields, filters, codes and districts together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitcast.functions.fields import tidy_age, tidy_date, tidy_gender
from visitcast.operators import address, icd, visits


def clean_visits(
    raw: DataFrame, library: DataFrame, blocks: DataFrame, gazetteer: DataFrame, polygons: DataFrame, districts: DataFrame, order_by: list[str], city: str = "广州", min_score: float = 0.5, steps: tuple[str, ...] = ("polygon", "text"),
    texts: DataFrame | None = None, places: DataFrame | None = None,
) -> DataFrame:
    """raw with visit_date, age, gender, code, score, block and district, one row a visit.

    raw holds patient_id, gy_bm, date_text, age_text, gender_text, disease_raw, current_address and
    registered_address. Filters run first: a readable date, an address in the city, no placeholder patient;
    then the dedup. Codes, their blocks and districts are found for distinct texts and addresses and
    joined to the visits by equality. `texts` (disease_raw) and `places` (current_address) are tables
    that hold all of them; without these they are gathered from what is left of the visits, which are made
    anew for each reading. What can't be read or matched is null: a visit stays without code or district.
    """
    dated = raw.withColumns({"visit_date": tidy_date(F.col("date_text")), "age": tidy_age(F.col("age_text")), "gender": tidy_gender(F.col("gender_text"))}).filter(F.col("visit_date").isNotNull())
    kept = visits.dedup_visits(visits.drop_placeholder(visits.in_city(dated, "current_address", "registered_address", city)), order_by)
    known = (kept if texts is None else texts).select("disease_raw").distinct()
    coded = icd.to_block(icd.mapping(known, library, min_score=min_score, raw="disease_raw"), blocks)
    where = (kept if places is None else places).select(F.col("current_address").alias("address")).filter("address IS NOT NULL").distinct()
    found = address.clean_district(where, gazetteer, polygons, districts, steps).select(F.col("address").alias("current_address"), "district")
    return icd.standardise_codes(kept.drop("block", "district"), coded, "disease_raw").join(found, "current_address", "left")


def rejects(clean: DataFrame) -> DataFrame:
    """reason, value, n: texts of diseases without a code and addresses without a district, with the visits that have them."""
    without = lambda reason, text, result: clean.filter(F.col(result).isNull()).groupBy(F.col(text).alias("value")).agg(F.count("*").alias("n")).select(F.lit(reason).alias("reason"), "value", "n")
    return without("disease", "disease_raw", "code").unionByName(without("address", "current_address", "district"))


def block_features(clean: DataFrame) -> DataFrame:
    """Visit features per day, district and block of codes; visits without district or block are left out (they are in the reject table)."""
    known = clean.filter(F.col("district").isNotNull() & F.col("block").isNotNull())
    return visits.visit_features(known.withColumn("disease", F.col("block")))
