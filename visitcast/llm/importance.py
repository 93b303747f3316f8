r"""Importance resampling towards a target's distribution of hashed word runs.

A document's features are its runs of 1 to `order` words, hashed into buckets. Both
corpora are counted over all texts, a task at a time into one array of buckets, so
that a task sends at most `buckets` rows however much it has read. A bucket's gain is
the logarithm of target over corpus share; a document's weight, the sum over its
features, is read from the array of gains. A draw by the id's hash turns weights into
scores whose highest are a sample without replacement.

The cutoff among the scores is found without sorting them: a mergeable quantile
sketch gives a bracket around the wanted place, exact counts of what lies above and
inside validate it (or widen it, in the end to all scores), and only the bracket is
sorted, in ranges, to find the row at the cutoff. The drawn rows are ranked likewise:
range partitions, numbered within, offset by the counts of those before. The driver
sees the array of gains and a count for each partition.

Defined results: a null or empty text and one without words have no features and
weight 0; a null id is drawn as if written as no digits and comes last in ties;
repeated rows are scored alike and each may be drawn, in an order of their own; an
empty table gives no rows, an empty target gains of the corpus alone; a target
column of nulls counts as empty; other columns pass through (names that begin with
_ir_ are reserved and replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from visitcast.llm.common import NO_ID, modest, spread, table, written
from visitcast.llm.text_bytes import tidied

BUCKETS = 10_000
ORDER = 1
SEED = 2024
#: Percent of the documents with at least LEAST_WORDS words that are drawn.
PERCENT, LEAST_WORDS = 10, 20
#: The sketch's places are right to a share 1 / ACCURACY of all rows.
ACCURACY = 10_000
#: Bytes of a text whose words are held at once.
CHUNK = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words and what parts them, in bytes of UTF-8: ASCII but 0-9 and a-z parts, all else belongs to words.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PART = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def hashed(text: bytes, order: int = ORDER, buckets: int = BUCKETS, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the runs that end in them, chunk by chunk of the text."""
    at, carry = 0, []
    text = text.translate(_LOWER)
    while at < len(text):
        part = _PART.search(text, at + chunk) if at + chunk < len(text) else None
        end = part.start() if part else len(text)
        words = _WORD.findall(text, at, end)
        found = []
        for k in range(1, order + 1):
            tail = [*carry[len(carry) - min(k - 1, len(carry)) :], *words]
            codes = list(map(crc32, tail))
            for j in range(1, k):
                codes = [crc32(b" " + w, c) for c, w in zip(codes, tail[j:], strict=False)]
            found.append(np.array(codes, dtype=np.int64) % buckets)
        yield len(words), np.concatenate(found)
        carry, at = [*carry, *words][-(order - 1) :] if order > 1 else [], end


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in _bytes(batch):
                for _, codes in hashed(text, order, buckets):
                    total += np.bincount(codes, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    with modest(docs.sparkSession):
        for r in docs.select("text").mapInArrow(lambda b: tidied(count(b)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths of the natural logarithm, floored; shares smoothed by one count a bucket."""
    size, all_corpus, all_target = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + size) / ((s + 1.0) * (all_target + size)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], dtype=np.int64)


def draw_of(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """docs with _ir_words, _ir_features, _ir_weight, _ir_score and _ir_row (a number of its own), written; without the text unless asked for."""
    docs = docs.drop("_ir_words", "_ir_features", "_ir_weight", "_ir_score", "_ir_row", "_ir_rank", "_ir_at", "_ir_part")
    names = [c for c in docs.columns if keep_text or c != "text"]
    added = ["_ir_words", "_ir_features", "_ir_weight"]
    schema = StructType([*[docs.schema[c] for c in names], *[StructField(c, LongType()) for c in added]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((3, batch.num_rows), dtype=np.int64)
            for i, text in enumerate(_bytes(batch)):
                for n, codes in hashed(text, order, len(gain)):
                    found[:, i] += (n, len(codes), gain[codes].sum())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, found)], [*names, *added])

    rows = docs.mapInArrow(lambda b: tidied(score(b)), schema)
    with modest(docs.sparkSession):
        return written(rows.withColumns({"_ir_score": F.col("_ir_weight") + draw_of(F.col("doc_id"), seed), "_ir_row": F.monotonically_increasing_id()}), "importance-scores")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their place from 1 on in falling order of score: sorted in range partitions, counted, offset."""
    order = [F.desc("_ir_score"), _id().asc(), F.asc("_ir_row")]
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_ir_at", F.monotonically_increasing_id()), "importance-ranges")
    part = F.shiftright("_ir_at", 33)
    before, offsets = 0, []
    for r in sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        offsets.append((r.part, before))
        before += r.n
    starts = rows.sparkSession.createDataFrame(offsets, "_ir_part long, _ir_before long")
    place = F.col("_ir_before") + F.col("_ir_at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.withColumn("_ir_part", part).join(F.broadcast(starts), "_ir_part").withColumn(name, place).drop("_ir_at", "_ir_part", "_ir_before")


def bracket(rows: DataFrame, wanted: int, share: float, accuracy: int = ACCURACY) -> tuple[float, float, int]:
    """Lowest and highest score between which the `wanted`-th highest lies, and how many rows lie above; share: about wanted / rows.

    Each round takes the sketch's scores four times as far from the wanted place, the last all scores.
    """
    score, far = F.col("_ir_score"), 2 / accuracy
    while True:
        low, high = 1 - share - far, 1 - share + far
        at = rows.agg(F.percentile_approx("_ir_score", F.array(F.lit(max(low, 0.0)), F.lit(min(high, 1.0))), F.lit(accuracy)).alias("q")).first().q
        lo, hi = -math.inf if low <= 0 else float(at[0]), math.inf if high >= 1 else float(at[1])
        above, inside = rows.agg(F.count_if(score > hi), F.count_if(score.between(lo, hi))).first()
        if above < wanted <= above + inside:
            return lo, hi, above
        far *= 4


def cutoff(rows: DataFrame, wanted: int, share: float, accuracy: int = ACCURACY) -> tuple:
    """Score, id (a null one as the largest) and row number of the `wanted`-th row; only the bracket around it is sorted."""
    lo, hi, above = bracket(rows, wanted, share, accuracy)
    inside = rows.filter(F.col("_ir_score").between(lo, hi)).select("_ir_score", "doc_id", "_ir_row")
    return tuple(numbered(inside, "_ir_place").filter(F.col("_ir_place") == wanted - above).select("_ir_score", _id(), "_ir_row").first())


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """rows of weighed() with _ir_rank: the place of the drawn ones, null for the others."""
    fit = F.col("_ir_words") >= least_words
    eligible = rows.filter(fit)
    wanted = percent * eligible.count() // 100
    none = F.lit(None).cast("long").alias("_ir_rank")
    if not wanted:
        return rows.select("*", none)
    score, last, row = cutoff(eligible, wanted, percent / 100, accuracy)
    tie = (_id() < last) | ((_id() == last) & (F.col("_ir_row") <= row))
    first = fit & ((F.col("_ir_score") > score) | ((F.col("_ir_score") == score) & tie))
    return numbered(rows.filter(first), "_ir_rank").unionByName(rows.filter(~first).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, accuracy: int = ACCURACY, keep_text: bool = False) -> DataFrame:
    """Every row of docs with its features, weight, score and rank (null if it isn't drawn); target: a table with `text`."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    return drawn(weighed(docs, gain, order, seed, keep_text), percent, least_words, accuracy)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = resample(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *[F.col(f"_ir_{c}").alias(c if c != "features" else "n_features") for c in ("features", "weight", "score", "rank")])


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: CRC-32 is spelled out, on distinct words: DuckDB has no function for it.
ORACLE_SQL = rf"""
WITH ir_docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_WORDS}') AS ws FROM documents),
ir_bench AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_WORDS}') AS ws FROM benchmark),
ir_tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS c FROM range(0, 256) t(n))),
ir_bytes AS (
  SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bs
  FROM (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM ir_docs UNION ALL SELECT ws FROM ir_bench))),
ir_bucket AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) % {BUCKETS} AS k FROM ir_bytes, ir_tab),
ir_feat AS (SELECT rid, k FROM (SELECT rid, unnest(ws) AS w FROM ir_docs) JOIN ir_bucket USING (w)),
ir_s AS (SELECT k, count(*) AS s FROM ir_feat GROUP BY k),
ir_t AS (SELECT k, count(*) AS t FROM (SELECT unnest(ws) AS w FROM ir_bench) JOIN ir_bucket USING (w) GROUP BY k),
ir_all AS (SELECT (SELECT coalesce(sum(s), 0) FROM ir_s) AS all_s, (SELECT coalesce(sum(t), 0) FROM ir_t) AS all_t),
ir_gain AS (
  SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM ir_s LEFT JOIN ir_t USING (k), ir_all),
ir_weight AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM ir_feat JOIN ir_gain USING (k) GROUP BY rid),
ir_score AS (
  SELECT d.rid, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM ir_docs d LEFT JOIN ir_weight w ON w.rid = d.rid),
ir_fit AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM ir_score WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM ir_score LEFT JOIN ir_fit USING (rid)"""
