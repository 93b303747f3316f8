"""Quality rules whose cutoffs adapt to each language and source.

Fixed rules come first (too few words, too much repetition). Then every document that
passes them is held against fences from quantile sketches of its language and source,
made of all documents that pass them.
The sketch is a log-linear histogram: a value is kept to its leading DIGITS binary
digits, so a bin is at most 1 / 2^(DIGITS - 1) of its value wide, whatever the value;
sketches merge by adding counts and give the same quantiles however the rows were
dealt, so a rerun after a lost executor agrees with the first run.

A fence is the median plus (for two-sided features also less) so many times the
quartile range, or so many times the distance from the median to an upper quantile,
whichever is more: features that are 0 in most documents have quartiles that coincide,
and the upper quantile tells how far the usual exceptions of the group go. No fence is
a fixed share. Quantiles of a group of n documents are drawn towards those of its
language as if PULL documents of the language were added, those of a language
towards the corpus, so groups of any size have fences of their own and no size is a
switch. A share beyond its fence counts only if its count lies SIGMAS deviations of a
Poisson count above what the median gives a text of this length, so that one symbol or
one repeated line rejects nothing where most texts have none.

Everything is DataFrame functions; the text is read once, into a narrow table. The
fences, one row a language and source, are broadcast if a count proves them few.

Defined results: a null text counts as empty (0 words, fails the base rules); a
null lang or source forms the group ''; a group whose documents all fail the base
rules has no fences and keeps none; repeated rows are each counted; an empty
table gives an empty result; other columns of the input are ignored, or pass through
keep_good() but for _k and _t, which are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitcast.llm.common import BLANKS, BROADCAST_ROWS, keyed, small, spread, table, text_of, without, written

#: Leading binary digits that a bin of the sketches keeps of a value.
DIGITS = 6
#: Documents of the wider group that quantiles are mixed with.
PULL = 20
#: Deviations that a count lies above the median's before it is judged.
SIGMAS = 3
#: feature: (quartile ranges allowed beyond the median, upper quantile in percent, distances to it allowed, two-sided).
#: Documents may repeat lines and words more than nearly all of their group do, but hold no more symbols than nine of ten.
FENCES = {
    "symbol": (6, 90, 1, False),
    "upper": (8, 99, 1, False),
    "dup_line": (6, 99, 2, False),
    "repeat": (6, 99, 2, False),
    "word_len": (6, 99, 0, True),
}
#: feature: (what is counted, what it is a share of, unit): shares in 1/100,000, the mean word length in 1/1000 of a character.
SHARES = {
    "symbol": ("n_symbols", "word_chars", 100_000),
    "upper": ("n_upper", "word_chars", 100_000),
    "dup_line": ("n_dup_lines", "n_lines", 100_000),
    "repeat": ("n_repeat_words", "n_words", 100_000),
    "word_len": ("word_chars", "n_words", 1000),
}
QUANTILES = (25, 50, 75, 90, 99)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeat_words(sorted_: Column, bits: Column) -> Column:
    """Places of 3-word windows that occur twice; sorted_: window hash (high bits) and place (low bits).

    The longer the text, the fewer bits of the hash are left, so windows of equal hashes are compared word by word.
    """
    part = lambda j: F.call_function("shiftright", F.get(sorted_, j), bits)
    place = lambda j: F.get(sorted_, j) - F.call_function("shiftleft", part(j), bits)
    word = lambda j, o: F.get("words", place(j).cast("int") + o)
    same = lambda i, j: F.coalesce((part(i) == part(j)) & (word(i, 0) == word(j, 0)) & (word(i, 1) == word(j, 1)) & (word(i, 2) == word(j, 2)), F.lit(False))
    hit = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    return F.when(F.size(sorted_) > 1, F.sort_array(F.transform(hit, place))).otherwise(F.array().cast("array<bigint>"))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, _k, _t and the counts of METRICS, one row per input row."""
    base = keyed(docs).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "_k", "_t", text_of().alias("text"))
    split = base.select(
        "doc_id", "lang", "source", "_k", "_t",
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    n = F.size("words")
    bits = F.length(F.bin(n.cast("long")))
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), bits), bits).bitwiseOR(i.cast("long")),
    )
    counted = split.select(
        "doc_id", "lang", "source", "_k", "_t", "n_symbols", "n_upper",
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("packed"),
        bits.alias("bits"), "words",
    )
    places = counted.withColumn("at", _repeat_words(F.col("packed"), F.col("bits"))).drop("packed", "bits", "words")
    covered = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    return places.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop("at")


def _per(part: str, whole: str, unit: int) -> Column:
    return F.expr(f"{part} * {unit} div greatest({whole}, 1L)")


def features(measured: DataFrame) -> DataFrame:
    return measured.withColumns({
        **{f"f_{f}": _per(*share) for f, share in SHARES.items()},
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def _bin(value: Column) -> Column:
    """The lower edge of the value's bin: its leading DIGITS binary digits, then zeros."""
    low = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(featured: DataFrame) -> DataFrame:
    """lang, source, feature, bin, n: the sketch of each language and source. Those of wider groups are their sums."""
    long = featured.filter("NOT base_failed").select("lang", "source", F.explode(F.create_map(*[x for f in FENCES for x in (F.lit(f), F.col(f"f_{f}"))])).alias("feature", "value"))
    return long.groupBy("lang", "source", "feature", _bin(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, *group: str) -> DataFrame:
    """group, feature, docs and the QUANTILES of merged sketches."""
    key = [*group, "feature"]
    merged = sketch.groupBy(*key, "bin").agg(F.sum("n").alias("n"))
    ranked = merged.withColumns({"upto": F.sum("n").over(Window.partitionBy(*key).orderBy("bin")), "docs": F.sum("n").over(Window.partitionBy(*key))})
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("docs"), F.col("bin"))).alias(f"q{q}")
    return ranked.groupBy(*key).agg(F.max("docs").alias("docs"), *[at(q) for q in QUANTILES])


def thresholds(featured: DataFrame, pull: int = PULL) -> DataFrame:
    """lang, source and lo_/mid_/hi_ of each feature."""
    sketch = written(sketches(featured), "quality-sketches")
    fine, wide, whole = _quantiles(sketch, "lang", "source"), _quantiles(sketch, "lang"), _quantiles(sketch)
    mixed = lambda a, b, q: F.expr(f"({a}.docs * {a}.q{q} + {pull} * {b}.q{q}) div ({a}.docs + {pull})").alias(f"q{q}")
    lang = wide.alias("a").join(whole.alias("b"), "feature").select("a.lang", "feature", *[mixed("a", "b", q) for q in QUANTILES])
    group = fine.alias("a").join(lang.alias("b"), ["lang", "feature"]).select("lang", "source", "feature", *[mixed("a", "b", q) for q in QUANTILES])
    fences = []
    for f, (spreads, upper, reach, both) in FENCES.items():
        own = lambda x, f=f: F.max(F.when(F.col("feature") == f, x))
        # Two bins at least, since quantiles are known to the bin.
        width = F.greatest(spreads * (F.col("q75") - F.col("q25")), reach * (F.col(f"q{upper}") - F.col("q50")), F.call_function("shiftright", F.col("q50"), F.lit(DIGITS - 2)))
        fences += [own(F.col("q50") - width if both else F.lit(-1).cast("long")).alias(f"lo_{f}"), own(F.col("q50")).alias(f"mid_{f}"), own(F.col("q50") + width).alias(f"hi_{f}")]
    return group.groupBy("lang", "source").agg(*fences)


def _inside(f: str) -> str:
    """Whether a document lies inside the fence of a feature; the text is SQL of both engines."""
    count, whole, unit = SHARES[f]
    within = f"f_{f} BETWEEN lo_{f} AND hi_{f}"
    if FENCES[f][3]:
        return within
    usual = f"CAST({whole} AS DOUBLE) * mid_{f} / {unit}"
    return f"({within} OR {count} - {usual} <= {SIGMAS} * sqrt({usual} + 1))"


def judge(docs: DataFrame, pull: int = PULL, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Metrics, features, base_failed and kept of each document."""
    featured = features(written(metrics(docs), "quality-metrics"))
    inside = F.expr(" AND ".join(_inside(f) for f in FENCES))
    return featured.join(small(written(thresholds(featured, pull), "quality-fences"), rows), ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & inside)


def keep_good(docs: DataFrame, pull: int = PULL) -> DataFrame:
    """The documents that pass, with all their columns."""
    return without(docs, judge(docs, pull).filter("NOT kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(spread(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(source: str = "documents", pull: int = PULL) -> str:
    """DuckDB text up to the relation `judged` (all columns of the table, the metrics and kept)."""
    feats = ", ".join(f"{count} * {unit} // greatest({whole}, 1) AS f_{f}" for f, (count, whole, unit) in SHARES.items())
    long = " UNION ALL ".join(f"SELECT lang0, source0, '{f}' AS feature, f_{f} AS v, greatest(length(bin(f_{f})) - {DIGITS}, 0) AS low FROM qr_feat WHERE NOT base_failed" for f in FENCES)
    wide = {f: f"greatest({s} * (q75 - q25), {r} * (q{u} - q50), q50 >> {DIGITS - 2})" for f, (s, u, r, _) in FENCES.items()}
    at = lambda x, name: f"max({x}) FILTER (feature = '{name[1]}') AS {name[0]}_{name[1]}"
    fences = ", ".join(x for f, w in wide.items() for x in (at(f"q50 - {w}" if FENCES[f][3] else "-1", ("lo", f)), at("q50", ("mid", f)), at(f"q50 + {w}", ("hi", f))))
    inside = " AND ".join(_inside(f) for f in FENCES)
    mixed = ", ".join(f"(a.docs * a.q{q} + {pull} * b.q{q}) // (a.docs + {pull}) AS q{q}" for q in QUANTILES)

    def quantiles(name: str, group: str) -> str:
        at = ", ".join(f"min(bin) FILTER (100 * upto >= {q} * docs) AS q{q}" for q in QUANTILES)
        return f"""
qr_{name} AS (
  SELECT {group} feature, max(docs) AS docs, {at} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {group} feature ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {group} feature) AS docs
    FROM (SELECT {group} feature, bin, count(*) AS n FROM qr_long GROUP BY ALL)) GROUP BY {group} feature)"""

    return rf"""
qr_rows AS (SELECT row_number() OVER () AS rid, * FROM {source}),
qr_split AS (
  SELECT rid, coalesce(lang, '') AS lang0, coalesce(source, '') AS source0, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM qr_rows),
qr_tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM (
    SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM qr_split))),
qr_rep AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM qr_tri WHERE times > 1) GROUP BY rid),
qr_met AS (
  SELECT rid, lang0, source0, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM qr_split LEFT JOIN qr_rep USING (rid)),
qr_feat AS (SELECT *, {feats}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM qr_met),
qr_long AS (SELECT lang0, source0, feature, (v >> low) << low AS bin FROM ({long})),{quantiles('fine', 'lang0, source0,')},{quantiles('wide', 'lang0,')},{quantiles('whole', '')},
qr_lang AS (SELECT a.lang0, a.feature, {mixed} FROM qr_wide a JOIN qr_whole b USING (feature)),
qr_group AS (SELECT a.lang0, a.source0, a.feature, {mixed} FROM (SELECT * FROM qr_fine) a JOIN (SELECT *, 0 AS docs FROM qr_lang) b USING (lang0, feature)),
qr_fence AS (SELECT lang0, source0, {fences} FROM qr_group GROUP BY lang0, source0),
judged AS (
  SELECT r.*, q.* EXCLUDE (rid, lang0, source0), NOT base_failed AND {inside} AS kept
  FROM qr_feat q JOIN qr_rows r USING (rid) LEFT JOIN qr_fence p ON p.lang0 = q.lang0 AND p.source0 = q.source0)"""


ORACLE_SQL = f"WITH {_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
