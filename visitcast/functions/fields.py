"""Tidying of single fields; what can't be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the genders.
GENDERS = {"M": "M", "MALE": "M", "1": "M", "男": "M", "F": "F", "FEMALE": "F", "2": "F", "女": "F"}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd")


def tidy_age(col: Column, most: int = 120) -> Column:
    """The whole number that the text begins with, if from 0 to `most`."""
    age = F.regexp_extract(F.trim(col.cast("string")), r"^(-?[0-9]+)", 1).try_cast("int")
    return F.when(age.between(0, most), age)


def tidy_gender(col: Column, genders: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (genders or GENDERS).items() for x in pair])
    return F.try_element_at(known, F.upper(F.trim(col.cast("string"))))


def tidy_date(col: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date by the first format that reads the text."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(col.cast("string")), F.lit(f))) for f in formats])


def normalise_code(col: Column) -> Column:
    """Full-width letters, digits and signs narrowed, upper case, no blanks."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    return F.upper(F.regexp_replace(F.translate(col, wide, "".join(chr(0x21 + i) for i in range(94))), r"\s+", ""))


def normalise_address(col: Column) -> Column:
    return F.regexp_replace(F.trim(col), r"\s+", "")
