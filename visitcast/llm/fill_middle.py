r"""Fill-in-middle transformation by counted, possessive regular expressions.

A unit is a code point. regexp_count gives the number n of units: it keeps every
match, so it counts runs of BLOCK units first and single units at the end, and a
text of any length costs n / BLOCK matches. Two draws from a hash of the id give the
cuts a <= b; each row's pattern, unit{a}+, then unit{b-a}+, then the rest, captures
prefix, middle and suffix in one match, whose replacement writes the parts in the
order of the form. Exact counts never give back units, so nothing is backtracked. The
text is read back from output and form by one more match: the marks can't overlap
themselves or each other, and texts that hold one stay plain.

All of it is one projection over the scan: no shuffle, no state beyond a row.

Defined results: a null text is an empty one; an empty text is plain with n = 0; a
null id is drawn as if written as no digits; repeated rows are cut alike; an empty
table gives no rows; other columns pass through (names that begin with _fim_ are
reserved and replaced).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import spread, table, text_of

#: One code point, line ends included.
UNIT = "(?s:.)"
#: Units that are counted as one match.
BLOCK = 256
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Percent of the texts that are transformed, and percent of these whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20


def count_units(text: Column, block: int = BLOCK) -> Column:
    """Number of units, from matches of `block` units and of the single ones left at the end."""
    whole = F.regexp_count(text, F.lit(f"{UNIT}{{{block}}}+"))
    pieces = F.regexp_count(text, F.lit(f"{UNIT}{{{block}}}+|{UNIT}"))
    return pieces.cast("long") + (block - 1) * whole.cast("long")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks between which no other place of a mark can arise: unlike ones in < and >, neither inside."""
    if len(set(marks)) != 3 or any(not re.fullmatch("<[^<>]+>", m) for m in marks):
        raise ValueError("marks have to be three unlike texts in < and >")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with _fim_n, _fim_form (plain, psm or spm), _fim_prefix and _fim_middle (units, null if plain) and _fim_output."""
    _checked(marks)
    names = ["_fim_text", "_fim_n", "_fim_h", "_fim_form", "_fim_prefix", "_fim_middle", "_fim_output"]
    docs = docs.drop(*names)
    rows = docs.withColumns({"_fim_text": text_of(), "_fim_h": F.array(*draws(F.col("doc_id"), seed))})
    rows = rows.withColumn("_fim_n", count_units(F.col("_fim_text")))
    h = lambda i: F.get("_fim_h", F.lit(i))
    one, two, text = h(0) % (F.col("_fim_n") + 1), h(1) % (F.col("_fim_n") + 1), F.col("_fim_text")
    marked = text.contains(marks[0]) | text.contains(marks[1]) | text.contains(marks[2])
    form = F.when((F.col("_fim_n") == 0) | marked | (h(2) % 100 >= rate), "plain").when(h(3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("_fim_form", form)
    cut = F.col("_fim_form") != "plain"
    rows = rows.withColumns({"_fim_prefix": F.when(cut, F.least(one, two)), "_fim_middle": F.when(cut, F.abs(one - two))})
    pattern = F.concat(F.lit(rf"\A({UNIT}{{"), F.col("_fim_prefix").cast("string"), F.lit(rf"}}+)({UNIT}{{"), F.col("_fim_middle").cast("string"), F.lit(rf"}}+)({UNIT}*+)\z"))
    p, s, m = marks
    order = F.when(F.col("_fim_form") == "spm", f"{_said(s)}$3{_said(p)}$1{_said(m)}$2").otherwise(f"{_said(p)}$1{_said(s)}$3{_said(m)}$2")
    output = F.when(cut, F.regexp_replace(text, pattern, order)).otherwise(text)
    return rows.select(*docs.columns, "_fim_n", "_fim_form", "_fim_prefix", "_fim_middle", output.alias("_fim_output"))


def _said(mark: str) -> str:
    """A mark as it is written in a replacement."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form alone."""
    p, s, m = (rf"\Q{x}\E" for x in marks)
    psm = F.regexp_replace(output, F.lit(rf"\A{p}({UNIT}*?){s}({UNIT}*?){m}({UNIT}*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"\A{s}({UNIT}*?){p}({UNIT}*?){m}({UNIT}*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = transform(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(
        "doc_id", F.col("_fim_n").alias("n"), F.col("_fim_form").alias("form"), F.col("_fim_prefix").alias("prefix_chars"), F.col("_fim_middle").alias("middle_chars"),
        F.sha2("_fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("_fim_output"), F.col("_fim_form")), 256).alias("restored_sha256"),
    )


_P, _S, _M = MARKS
ORACLE_SQL = f"""
WITH fm_rows AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
fm_drawn AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, {', '.join(f"CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT) AS h{i + 1}" for i in range(4))} FROM fm_rows),
fm_form AS (
  SELECT *, CASE WHEN x = '' OR contains(x, '{_P}') OR contains(x, '{_S}') OR contains(x, '{_M}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM fm_drawn),
fm_parts AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1) AS suf FROM fm_form)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '{_S}' || suf || '{_P}' || pre || '{_M}' || mid ELSE '{_P}' || pre || '{_S}' || suf || '{_M}' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM fm_parts"""
