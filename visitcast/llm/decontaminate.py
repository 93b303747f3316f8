"""Benchmark decontamination over canonical templates, by DataFrame functions only.

A text is split at blanks and loses its punctuation. Each token gets a type: a
number (it begins with a digit), a unit of measure after a number, a name
(capitalised) or a word. Two views of a text are matched. In the first, numbers,
units and names are typed placeholders, a run of names is one placeholder, and
words are lower-cased; in the second, names are words too, so that a copy in other
capitals is found. A window of WINDOW tokens without a word counts with its values
instead of its types: "42" is found as "42" only.

Windows of the documents meet those of the benchmark in a hash join, seeds first.
Of each item the rarest windows are seeds, so many that a document without any
can't hold COVER percent of the item's places; windows that many items share are
seeds of few. Documents that hit a seed are candidates. Their windows are joined
to the items' windows by hash, kept for candidate pairs only, and aligned: grouped
by document place minus item place, exactly and in two overlapping rows of bands
of a quarter of the item (for copies with words put in). An alignment is a leak if
it holds COVER percent of the item's places and its slots agree: of the slots,
counted in both directions, SLOTS_OK percent have the value that most often stands
for theirs. Each alignment is judged by itself, so a document with an item and
several re-parameterised copies of it is found through any of them.

The benchmark side is broadcast if a count proves it small, else Spark sorts and
merges. Document windows go through the first join without a shuffle in the first
case; only ids of candidates are shuffled, and the windows that hit of these.

Defined results: null and empty texts hold nothing; items of fewer than WINDOW
tokens are matched as a whole; items without a token match nothing; repeated
documents are each reported once per (doc_id, text, item); repeated items are
reported under each item_id; a null doc_id is reported as null; extra columns are
ignored, or pass through clean(), but for _k and _t, which are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import BROADCAST_ROWS, NO_ID, keyed, small, spread, table, text_of, without, written

WINDOW = 4
COVER = 60
SLOTS_OK = 80
#: Units of measure that count as such after a number, without punctuation.
UNITS = (
    "km", "m", "cm", "mm", "mi", "ft", "in", "yd", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "s", "sec", "min", "h", "hr", "hrs", "kmh", "mph", "ms",
    "usd", "eur", "percent", "dollars", "euros", "cents", "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms",
    "pounds", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
)
#: Patterns, valid in both Java and RE2.
NAME = r"^\p{Lu}\p{Ll}+$"
NUMBER = r"^[0-9]"
PUNCTUATION = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
#: Types of tokens. A word stands in the arrays by its hash, the others by their type.
WORD, NUM, NAM, UNIT = 0, 1, 2, 3


def tokens(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, low (lower-cased tokens) and kind (their types) of the column text."""
    full = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    bare = docs.select(*keep, F.translate(F.regexp_replace("text", PUNCTUATION, ""), "\t\n\x0b\x0c\r", "     ").alias("bare"))
    cut = bare.select(*keep, full(F.col("bare")).alias("toks"), full(F.lower("bare")).alias("low"))
    digit = lambda w: (w < ":") & (w >= "0")  # noqa: E731  the same as NUMBER

    def kind(w: Column, i: Column) -> Column:
        unit = F.coalesce(digit(F.get("toks", i - 1)), F.lit(False)) & F.get("low", i).isin(*UNITS)
        return F.when(digit(w), NUM).when(unit, UNIT).when((w != F.get("low", i)) & w.rlike(NAME), NAM).otherwise(WORD)

    return cut.select(*keep, "low", F.transform("toks", kind).alias("kind"))


def _views(toks: DataFrame, keep: list[str]) -> DataFrame:
    """view 0 (names are one placeholder a run) and 1 (names are words): t (type or hash of each token, hashes are negative), s (token)."""
    hashed = toks.filter(F.size("low") > 0).select(*keep, "low", "kind", F.transform("low", lambda w: F.xxhash64(w).bitwiseOR(F.lit(-(1 << 63)))).alias("hashes"))
    at = F.filter(F.sequence(F.lit(0), F.size("low") - 1), lambda i: (F.get("kind", i) != NAM) | F.coalesce(F.get("kind", i - 1) != NAM, F.lit(True)))
    typed = lambda i: F.when(F.get("kind", i) == WORD, F.get("hashes", i)).otherwise(F.get("kind", i).cast("long"))
    plain = F.zip_with("hashes", "kind", lambda h, k: F.when(k.isin(WORD, NAM), h).otherwise(k.cast("long")))
    return hashed.withColumn("at", at).select(*keep, F.transform("at", typed).alias("t0"), F.transform("at", lambda i: F.get("low", i)).alias("s0"), plain.alias("t1"), F.col("low").alias("s1"), "kind")


def _places(n: Column, span: int) -> Column:
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def _window(view: int, i: Column, span: int, window: int) -> Column:
    """Hash of the window at place i: of its types and words; of a short one without a word, of its values.

    Long windows without a word are compared by value once they are joined.
    """
    types = [F.get(f"t{view}", i + k) for k in range(span)]
    whole = F.xxhash64(*types)
    if span == window:
        return whole
    return F.when(F.least(F.lit(4), *types) > 0, F.xxhash64(*[F.get(f"s{view}", i + k) for k in range(span)])).otherwise(whole)


def _slots(view: int, i: Column, span: int) -> Column:
    """(j, s): the placeholders in the window at place i."""
    there = F.filter(F.array(*[F.lit(k) for k in range(span)]), lambda k: F.get(f"t{view}", i + k) > 0)
    return F.transform(there, lambda k: F.struct(k.alias("j"), F.get(f"s{view}", i + k).alias("s")))


def item_places(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, cls, view, h, span, item_at, slots, n_places: the windows of both views of each item; cls tells views and texts of items apart."""
    items = _views(tokens(benchmark.select("item_id", text_of().alias("text")), ["item_id"]), ["item_id"])

    def cut(view: int, span: int) -> Column:
        n, cls = F.size(f"t{view}"), F.xxhash64(f"s{view}", f"t{view}", F.lit(view))
        one = lambda i: F.struct(cls.alias("cls"), F.lit(view).alias("view"), _window(view, i, span, window).alias("h"), F.lit(span).alias("span"), i.alias("item_at"), _slots(view, i, span).alias("slots"), (n - span + 1).alias("n_places"))
        fits = n == span if span < window else n >= window
        return F.transform(F.when(fits, _places(n, span)).otherwise(F.array().cast("array<int>")), one)

    return items.select("item_id", F.inline(F.concat(*[cut(view, span) for view in (0, 1) for span in range(1, window + 1)])))


def _seeds(places: DataFrame, cover: int) -> DataFrame:
    """h, cls: of each text of an item its rarest windows, one of which any text that covers it must hold."""
    from pyspark.sql.window import Window

    each = places.groupBy("cls", "h").agg(F.count("*").alias("times"), F.first("n_places").alias("n_places"))
    rare = each.join(each.groupBy("h").agg(F.count("*").alias("shared")), "h")
    before = F.coalesce(F.sum("times").over(Window.partitionBy("cls").orderBy("shared", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The places outside the seeds are fewer than `cover` percent.
    return rare.withColumn("before", before).filter(100 * (F.col("n_places") - F.col("before")) >= cover * F.col("n_places")).select("h", "cls")


def _doc_hashes(docs: DataFrame, spans: list[int], window: int) -> DataFrame:
    """_k, _t and h of the windows of the first view, and of those of the second that hold a name: the others are the same."""
    views = _views(tokens(docs, ["_k", "_t"]), ["_k", "_t"])
    n = F.size("kind")
    names = F.filter(F.sequence(F.lit(0), n - 1), lambda p: F.get("kind", p) == NAM)

    def near(span: int) -> Column:
        around = F.transform(names, lambda p: F.sequence(F.greatest(p - (span - 1), F.lit(0)), F.least(p, n - span)))
        return F.when(n >= span, F.array_distinct(F.flatten(around))).otherwise(F.array().cast("array<int>"))

    each = [_hashes(0, _places(F.size("t0"), s), s, window) for s in spans] + [_hashes(1, near(s), s, window) for s in spans]
    return views.select("_k", "_t", F.explode(F.concat(*each)).alias("h"))


def _hashes(view: int, places: Column, span: int, window: int) -> Column:
    return F.transform(places, lambda i: _window(view, i, span, window))


def _doc_windows(docs: DataFrame, spans: list[int], window: int) -> DataFrame:
    """_k, _t, view, h, at and slots of every window of both views."""
    views = _views(tokens(docs, ["_k", "_t"]), ["_k", "_t"])

    def cut(view: int, span: int) -> Column:
        return F.transform(_places(F.size(f"t{view}"), span), lambda i: F.struct(F.lit(view).alias("view"), _window(view, i, span, window).alias("h"), i.alias("at"), _slots(view, i, span).alias("slots")))

    return views.select("_k", "_t", F.inline(F.concat(*[cut(view, s) for view in (0, 1) for s in spans])))


def _aligned(hits: DataFrame, cover: int, slots_ok: int) -> DataFrame:
    """_k, _t, cls, n_windows, n_found, n_slots, n_slots_ok: the best alignment of each pair that covers the item and agrees."""
    key = ["_k", "_t", "cls", "n_places", "width", "band"]
    offset, wide = F.col("at") - F.col("item_at"), F.greatest(F.lit(2), F.ceil(F.col("n_places") / 4)).cast("int")
    half = (wide / 2).cast("int")
    bands = F.array(*[F.struct(F.lit(w).alias("width"), F.floor(x).cast("int").alias("band")) for w, x in ((0, offset), (1, offset / wide), (2, (offset + half) / wide))])
    every = hits.select("_k", "_t", "cls", "n_places", "item_at", "at", "theirs", "ours", F.inline(bands))
    found = every.groupBy(*key, "item_at").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("n_found"))
    full = written(found.filter(100 * F.col("n_found") >= cover * F.col("n_places")), "decontaminate-full")
    pairs = every.join(full.select(*key), key, "left_semi").select(*key, "item_at", "at", F.inline(F.zip_with("theirs", "ours", lambda a, b: F.struct(a["j"].alias("j"), a["s"].alias("a"), b["s"].alias("b")))))
    # A slot that several windows share counts once.
    once = pairs.groupBy(*key, (F.col("item_at") + F.col("j")).alias("p"), (F.col("at") + F.col("j")).alias("q"), "a", "b").agg(F.lit(1).alias("one")).groupBy(*key, "a", "b").agg(F.count("*").alias("n"))
    ways = once.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("a").alias("x")), F.struct(F.lit(1).alias("way"), F.col("b").alias("x")))).alias("w"), "n")
    most = ways.groupBy(*key, "w").agg(F.sum("n").alias("n"), F.max("n").alias("ok")).groupBy(*key).agg(F.sum("n").alias("n_slots"), F.sum("ok").alias("n_slots_ok"))
    judged = full.join(most, key, "left").fillna(0, ["n_slots", "n_slots_ok"]).filter(100 * F.col("n_slots_ok") >= slots_ok * F.col("n_slots"))
    best = F.max(F.struct("n_found", "n_slots_ok", "n_slots", "n_places"))
    return judged.groupBy("_k", "_t", "cls").agg(best.alias("b")).select("_k", "_t", "cls", F.col("b.n_places").alias("n_windows"), "b.n_found", "b.n_slots", "b.n_slots_ok")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER, slots_ok: int = SLOTS_OK, rows: int = BROADCAST_ROWS) -> DataFrame:
    """_k, _t, item_id, n_windows, n_found, n_slots, n_slots_ok: documents that hold an item, with the figures of its best view and alignment."""
    items = written(item_places(benchmark, window), "decontaminate-items")
    spans = sorted({window, *(r[0] for r in items.select("span").distinct().collect())})  # `window` values at most
    places = written(items.drop("item_id").distinct(), "decontaminate-places")
    names = written(items.select("item_id", "cls").distinct(), "decontaminate-names")
    base = keyed(docs.select("doc_id", text_of().alias("text")))
    seeds = written(_seeds(places, cover), "decontaminate-seeds")
    candidates = written(_doc_hashes(base, spans, window).join(small(seeds, rows), "h").select("_k", "_t", "cls").distinct(), "decontaminate-candidates")
    texts = base.join(small(candidates.select("_k", "_t").distinct(), rows), ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"])
    hits = _doc_windows(texts, spans, window).withColumnRenamed("slots", "ours").join(small(places.withColumnRenamed("slots", "theirs"), rows), ["h", "view"])
    by_value = (F.size("theirs") < F.col("span")) | (F.col("theirs") == F.col("ours"))
    hits = written(hits.filter(by_value).join(small(candidates, rows), ["_k", "_t", "cls"], "left_semi"), "decontaminate-hits")
    found = _aligned(hits, cover, slots_ok).join(small(names, rows), "cls")
    best = F.max(F.struct("n_found", "n_slots_ok", "n_slots", "n_windows"))
    return found.groupBy("_k", "_t", "item_id").agg(best.alias("b")).select("_k", "_t", "item_id", "b.n_windows", "b.n_found", "b.n_slots", "b.n_slots_ok")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    return without(docs, written(leaks(docs, benchmark), "decontaminate-leaks"))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each leak: a document that holds a benchmark item."""
    found = leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    ids = F.when(F.col("_k") != NO_ID, F.col("_k"))
    return found.select(ids.alias("doc_id"), "item_id", "n_windows", "n_found", "n_slots", "n_slots_ok", F.lit(True).alias("contaminated"))


def _sql(source: str, benchmark: str = "benchmark") -> str:
    """DuckDB text up to `leaked` (doc_id, item_id and figures), without seeds; for items of WINDOW tokens or more and distinct doc_ids."""
    v = WINDOW
    units = ", ".join(f"'{u}'" for u in UNITS)

    def toks(key: str, t: str, name: str) -> str:
        return rf"""
{name}_w AS (SELECT {key}, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '{PUNCTUATION}', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {t}),
{name}_k AS (SELECT {key}, list_transform(w, lambda x: lower(x)) AS low, list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '{NUMBER}') THEN 'N' WHEN lower(x) IN ({units}) AND i > 1 AND regexp_matches(w[i - 1], '{NUMBER}') THEN 'U' WHEN regexp_matches(x, '{NAME}') THEN 'P' ELSE '' END) AS kind FROM {name}_w),
{name}_v AS (
  SELECT {key}, 0 AS view, list_filter(list_transform(low, lambda x, i: CASE WHEN kind[i] = 'P' AND i > 1 AND kind[i - 1] = 'P' THEN NULL ELSE {{'t': CASE WHEN kind[i] = '' THEN x ELSE chr(1) || kind[i] END, 's': x, 'slot': kind[i] <> ''}} END), lambda z: z IS NOT NULL) AS z FROM {name}_k
  UNION ALL
  SELECT {key}, 1 AS view, list_transform(low, lambda x, i: {{'t': CASE WHEN kind[i] IN ('', 'P') THEN x ELSE chr(1) || kind[i] END, 's': x, 'slot': kind[i] IN ('N', 'U')}}) AS z FROM {name}_k),
{name}_p AS (SELECT {key}, view, len(z) - {v - 1} AS n_places, i AS pos, z[i:i + {v - 1}] AS win FROM (SELECT {key}, view, z, unnest(range(1, len(z) - {v - 2})) AS i FROM {name}_v)),
{name} AS (
  SELECT {key}, view, n_places, pos, win, CASE WHEN len(list_filter(win, lambda y: y.slot)) = {v} THEN '=' || array_to_string(list_transform(win, lambda y: y.s), ' ') ELSE array_to_string(list_transform(win, lambda y: y.t), ' ') END AS h FROM {name}_p)"""

    return rf"""{toks('item_id', benchmark, 'dc_i')},{toks('doc_id', source, 'dc_d')},
dc_hit AS MATERIALIZED (
  SELECT d.doc_id, i.item_id, i.view, i.n_places, i.pos AS item_at, d.pos AS pos, i.win AS theirs, d.win AS ours, d.pos - i.pos AS o, greatest(2, (i.n_places + 3) // 4) AS wide
  FROM dc_d d JOIN dc_i i ON i.view = d.view AND i.h = d.h),
dc_band AS (
  SELECT *, unnest([0, 1, 2]) AS width, unnest([CAST(o AS BIGINT), CAST(floor(o / wide) AS BIGINT), CAST(floor((o + wide // 2) / wide) AS BIGINT)]) AS band FROM dc_hit),
dc_full AS MATERIALIZED (
  SELECT doc_id, item_id, view, n_places, width, band, count(DISTINCT item_at) AS n_found FROM dc_band GROUP BY ALL HAVING 100 * count(DISTINCT item_at) >= {COVER} * n_places),
dc_slot AS (
  SELECT DISTINCT doc_id, item_id, view, width, band, item_at + j AS p, pos + j AS q, theirs[j].s AS a, ours[j].s AS b
  FROM (SELECT b.*, unnest(range(1, {v + 1})) AS j FROM dc_band b SEMI JOIN dc_full f ON f.doc_id = b.doc_id AND f.item_id = b.item_id AND f.view = b.view AND f.width = b.width AND f.band = b.band) WHERE theirs[j].slot),
dc_pair AS (SELECT doc_id, item_id, view, width, band, a, b, count(*) AS n FROM dc_slot GROUP BY ALL),
dc_way AS (
  SELECT doc_id, item_id, view, width, band, sum(n) AS n, max(n) AS ok FROM dc_pair GROUP BY doc_id, item_id, view, width, band, a
  UNION ALL SELECT doc_id, item_id, view, width, band, sum(n) AS n, max(n) AS ok FROM dc_pair GROUP BY doc_id, item_id, view, width, band, b),
dc_agree AS (SELECT doc_id, item_id, view, width, band, CAST(sum(n) AS BIGINT) AS n_slots, CAST(sum(ok) AS BIGINT) AS n_slots_ok FROM dc_way GROUP BY ALL),
dc_best AS (
  SELECT doc_id, item_id, CAST(n_places AS BIGINT) AS n_windows, n_found, coalesce(n_slots, 0) AS n_slots, coalesce(n_slots_ok, 0) AS n_slots_ok
  FROM dc_full LEFT JOIN dc_agree USING (doc_id, item_id, view, width, band) WHERE 100 * coalesce(n_slots_ok, 0) >= {SLOTS_OK} * coalesce(n_slots, 0)),
leaked AS (
  SELECT doc_id, item_id, n_windows, n_found, n_slots, n_slots_ok FROM dc_best
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found DESC, n_slots_ok DESC, n_slots DESC, n_windows DESC) = 1)"""


ORACLE_SQL = f"WITH {_sql('documents')} SELECT doc_id, item_id, CAST(n_windows AS INTEGER) AS n_windows, n_found, n_slots, n_slots_ok, true AS contaminated FROM leaked"
