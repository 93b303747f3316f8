"""Secret scan: fixed patterns, then two character Markov models, by DataFrame functions only.

Three patterns give the base spans. What they leave of a text is cut into tokens;
those of TOKEN characters or more are scored under two first-order Markov models:
of random strings, trained on the values of base spans, and of ordinary
identifiers, trained on the other tokens of labelled documents, less those that
earlier fits take for random. A token whose log-likelihood ratio exceeds MARGIN nats is a span
of kind `markov`; short tokens must be the more unlike identifiers to reach it.

The models are fitted on at most `sample` documents, a documented bound: half of them
drawn from documents that hold a base span, half from all (those with the smallest
hash of doc_id and text). Scoring reads every whole text. Only the two tables of pair
counts (at most 66 * 66 rows each) reach the driver.

The work on a text of n characters and m matches is n + m log m: places are running
sums by doubling, and nothing compares matches with matches.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; with no base span in the table the random model is uniform; an empty
table gives no rows; columns named like a result are replaced by it. Places are code
points, ends exclusive. A U+0001 in a text is read as U+0002, which no pattern contains.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import sampled, spread, table, written

#: The base patterns in order of rank. Letters of the assign keywords match in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of tokens; the models know these and "other" (0).
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Shorter tokens aren't scored: they are nearly all words of a text, and hold less than eight characters' worth of a secret.
TOKEN = 8
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{TOKEN},}}"
MARGIN = 12.0
#: Weight of the single characters' shares in the pairs' shares, as a count.
BACKOFF = 10.0
SAMPLE = 2000
#: Times that the ordinary tokens are cleaned of what looks random, and the models fitted anew.
CLEANED = 1


SPANS = "array<struct<start:int,rank:int,end:int,what:string>>"


def _cut(text: Column, pattern: str) -> Column:
    """text in pieces: those at odd places (from 0) are the matches of `pattern`, the others what lies between."""
    return F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01")


def _running(values: Column) -> Column:
    """Running sums of an array: in round k each element takes in the one 2^k places before it."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))) - 1)
    step = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return F.aggregate(rounds, values, step)


def _spans(pieces: Column, ends: Column, kind: str, ok=None) -> Column:
    """The matches among `pieces` (which end at `ends`) as SPANS."""
    odd = F.when(F.size(pieces) > 2, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    good = odd if ok is None else F.filter(odd, lambda i: ok(F.get(pieces, i)))
    return F.transform(good, lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.get(ends, i).alias("end"), F.get(pieces, i).alias("what")))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _matched(rows: DataFrame, text: str, kind: str, pattern: str, there: Column, ok=None) -> DataFrame:
    """rows with the spans of `pattern` in the column `text` as a column named `kind`; `there`: whether there can be any."""
    none = F.array().cast(SPANS)
    cut = rows.withColumn("_p", F.when(there, _cut(F.col(text), pattern)))
    cut = cut.withColumn("_e", F.when(F.col("_p").isNotNull(), _running(F.transform("_p", lambda x: F.length(x)))))
    return cut.withColumn(kind, F.when(F.col("_p").isNotNull(), _spans(F.col("_p"), F.col("_e"), kind, ok)).otherwise(none)).drop("_p", "_e")


def _long_value(match: Column) -> Column:
    return F.length(_value(match)) >= 12


def _there(text: Column) -> dict[str, Column]:
    low, keyword = F.lower(text), F.lit(False)
    for k in KEYWORDS:
        keyword = keyword | low.contains(k)
    return {"assign": keyword, "access": text.contains("AKIA"), "hex": text.rlike(HEX)}


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with _text and the arrays assign, access and hex."""
    rows = docs.drop("_text", *KINDS).withColumn("_text", F.replace(F.coalesce("text", F.lit("")), F.lit("\x01"), F.lit("\x02")))
    there = _there(F.col("_text"))
    rows = _matched(rows, "_text", "assign", ASSIGN, there["assign"], _long_value)
    rows = _matched(rows, "_text", "access", ACCESS, there["access"])
    return _matched(rows, "_text", "hex", HEX, there["hex"])


def _blanked(text: Column, pattern: str, there: Column, ok=None) -> Column:
    """text with blanks in place of the matches."""
    hide = lambda x, i: F.when((i % 2 == 1) & (F.lit(True) if ok is None else ok(x)), F.repeat(F.lit(" "), F.length(x))).otherwise(x)
    return F.when(there, F.array_join(F.transform(_cut(text, pattern), hide), "")).otherwise(text)


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def fit(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of the pairs of codes, row by row."""
    rows = docs.select("doc_id", "text")
    there = _there(F.col("text"))
    bearing = rows.filter((there["assign"] & F.col("text").rlike(ASSIGN.replace("]+)", "]{12,})"))) | (there["access"] & F.col("text").rlike(ACCESS)) | there["hex"])
    drawn = sampled(bearing, sample // 2, "doc_id", "text").unionByName(sampled(rows, sample - sample // 2, "doc_id", "text"))
    some = base_spans(drawn.repartition(16))
    secret = F.concat(F.transform("assign", lambda s: _value(s["what"])), F.transform("access", lambda s: s["what"]), F.transform("hex", lambda s: s["what"]))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    tokens = some.select(F.inline(F.concat(F.transform(secret, lambda x: F.struct(F.lit(1).alias("random"), x.alias("token"))), F.transform(ordinary, lambda x: F.struct(F.lit(0).alias("random"), x.alias("token"))))))
    tokens = written(tokens.filter(F.length("token") > 1), "secret-tokens")
    ratios = _ratios(tokens)
    for _ in range(CLEANED):
        # Secrets that no pattern knows stand among the ordinary tokens: what is likelier random under the last models is left out of the next.
        ratios = _ratios(tokens.filter((F.col("random") == 1) | (_score(F.col("token"), ratios) <= 0)))
    return ratios


def _ratios(tokens: DataFrame) -> list[float]:
    """The ratios of two models with the pairs of the tokens that are random (1) and ordinary (0)."""
    coded = tokens.select("random", _codes(F.col("token")).alias("c"))
    pairs = coded.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * SIZE + b)).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    table_: list[float] = []
    single = [[sum(counts.get((m, a * SIZE + b), 0) for a in range(SIZE)) + 1 for b in range(SIZE)] for m in (0, 1)]
    total = [sum(x) for x in single]
    for a in range(SIZE):
        row = [sum(counts.get((m, a * SIZE + b), 0) for b in range(SIZE)) for m in (0, 1)]
        for b in range(SIZE):
            p = [(counts.get((m, a * SIZE + b), 0) + BACKOFF * single[m][b] / total[m]) / (row[m] + BACKOFF) for m in (0, 1)]
            table_.append(round(math.log(p[1] / p[0]), 6))
    return table_


def _score(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios of the token's pairs."""
    codes, table_ = _codes(token), F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    return F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.length(token)), lambda a, b: F.coalesce(F.get(table_, a * SIZE + b), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, ratios: list[float] | None = None, margin: float = MARGIN, sample: int = SAMPLE) -> DataFrame:
    """docs with assign, access, hex and markov: arrays of (start, rank, end, what)."""
    ratios = ratios or fit(docs, sample)
    if len(ratios) != SIZE * SIZE:
        raise ValueError(f"{SIZE * SIZE} ratios are needed")
    found = base_spans(docs)
    there = _there(F.col("_text"))
    for kind, pattern, ok in (("assign", ASSIGN, _long_value), ("access", ACCESS, None), ("hex", HEX, None)):
        found = found.withColumn("_text", _blanked(F.col("_text"), pattern, there[kind] & (F.size(kind) > 0), ok))
    found = _matched(found, "_text", "markov", CANDIDATE, F.col("_text").rlike(CANDIDATE))

    return found.withColumn("markov", F.filter("markov", lambda m: _score(m["what"], ratios) > margin)).drop("_text")


def _joined(spans: Column) -> Column:
    kind = lambda r: F.element_at(F.array(*[F.lit(k) for k in KINDS]), r + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", kind(s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = scan(docs)
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    base = F.concat("assign", "access", "hex")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("markov"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, F.col("markov"))).alias("spans"))
