"""Line dedup over windows of three consecutive lines, by DataFrame functions only.

Each window is known by two 64-bit hashes. The first occurrence of a window in
the whole corpus (by doc_id, then hash of the text, then line) stays; the lines
that later occurrences cover are merged and removed. Hot windows are counted by
partial aggregation and meet their first place in a sort-merge join, which
adaptive execution splits; no window's rows are gathered in one group.

Defined results: a null text stays null with 0 lines; documents of fewer than
three lines have no window and stay as they are; rows that repeat doc_id and text
are one document, so neither removes lines of the other; a null doc_id comes last
in the order; a document may become empty but its row stays; other columns of the
input pass through dedup() (names that begin with _ are reserved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import BROADCAST_ROWS, keyed, table, text_of, written

SPAN = 3


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """_k, _t, pos, h1, h2: every window of `span` lines."""
    lines = keyed(docs).select("_k", "_t", F.split(text_of(), "\n").alias("lines")).filter(F.size("lines") >= span)
    at = lambda i: [F.get("lines", i + j) for j in range(span)]
    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - span), lambda i: F.struct(F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit(1), *at(i)).alias("h2")))
    return lines.select("_k", "_t", F.posexplode(hashed).alias("pos", "h")).select("_k", "_t", "pos", "h.h1", "h.h2")


def later(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """_k, _t, _at: the starts of windows that occurred before, as an array per document."""
    seen = windows(docs, span)
    place = F.struct("_k", "_t", "pos")
    repeated = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last")
    return seen.join(repeated, ["h1", "h2"]).filter(place != F.col("first")).groupBy("_k", "_t").agg(F.collect_set("pos").alias("_at"))


def dedup(docs: DataFrame, span: int = SPAN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the text less its repeated lines, and _n_lines, _n_removed beside its own columns."""
    gone = written(later(docs, span), "line-dedup")
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_at")), F.lit(0))).first()
    side = F.broadcast(gone) if size[0] + size[1] // 4 <= broadcast_rows else gone
    rows = keyed(docs).join(side, ["_k", "_t"], "left").withColumn("_lines", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n")))
    covered = F.flatten(F.transform("_at", lambda p: F.sequence(p, p + span - 1)))
    rows = rows.withColumn("_left", F.when(F.col("_at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)))
    text = F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"))
    removed = F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_left")).cast("long")
    kept = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return rows.select(*kept, F.size("_lines").cast("long").alias("_n_lines"), removed.alias("_n_removed"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def _sql(source: str) -> str:
    """DuckDB text up to `deduped` (rid, n_lines, n_removed, text of the rows of `source`); needs distinct doc_ids."""
    return rf"""
ld_rows AS (SELECT row_number() OVER () AS rid, * FROM {source}),
ld_lines AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM ld_rows WHERE text IS NOT NULL),
ld_win AS (
  SELECT rid, doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS w
  FROM (SELECT rid, doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM ld_lines)),
ld_later AS (
  SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS place FROM ld_win) WHERE place > 1),
ld_gone AS (SELECT DISTINCT rid, i + o AS p FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM ld_later)),
ld_text AS (
  SELECT l.rid, coalesce(string_agg(x, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS text, count(*) AS n_lines, count(g.p) AS n_removed
  FROM (SELECT rid, unnest(range(0, len(ls))) AS p, unnest(ls) AS x FROM ld_lines) l
  LEFT JOIN ld_gone g ON g.rid = l.rid AND g.p = l.p GROUP BY l.rid),
deduped AS (
  SELECT r.* EXCLUDE (text), CAST(coalesce(t.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, t.text
  FROM ld_rows r LEFT JOIN ld_text t USING (rid))"""


ORACLE_SQL = f"WITH {_sql('documents')} SELECT doc_id, n_lines, n_removed, text FROM deduped"
