"""Disease codes: exact and similar matches to the standard library, rejects, blocks.

Similarity works on distinct strings only and meets the library in an equi-join on the
rare ones of their character bigrams, so no cross join arises and no visit row is compared.
Whether a library is small enough to broadcast is left to adaptive execution, which knows
its size once it is there.

Defined results: null texts match nothing and are counted by the reject table; repeated
texts are matched once; a code or name that stands for several codes gives the smallest;
an empty library or table gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitcast.functions.fields import normalise_code

def match_exact(dirty: DataFrame, icd: DataFrame, raw: str = "raw") -> DataFrame:
    """raw, code, score 1.0 for the distinct raw strings equal to a code or a name of the library (normalised)."""
    keys = icd.select(F.explode(F.array(normalise_code(F.col("code")), normalise_code(F.col("name")))).alias("key"), "code").groupBy("key").agg(F.min("code").alias("code"))
    distinct = dirty.select(raw).filter(F.col(raw).isNotNull()).distinct()
    return distinct.withColumn("key", normalise_code(F.col(raw))).join(keys, "key").select(raw, "code", F.lit(1.0).alias("score"))


def _grams(text: Column, gram: int) -> Column:
    """Distinct character n-grams; a shorter text is its own gram."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - gram + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(gram)))
    return F.array_distinct(cut)


def _least_common(size: Column, min_score: float) -> Column:
    """Grams that a set of this size shares at least with any set that it reaches the score with: Dice >= s means common >= s * size / (2 - s)."""
    return F.greatest(F.lit(1), F.ceil(size * (min_score / (2 - min_score)) - 1e-9)).cast("int")


def _ranked(df: DataFrame, key: list[str], text: str, often: DataFrame, gram: int) -> DataFrame:
    """key and `grams`: the text's grams in one order for all texts, rare ones of the library first."""
    each = df.select(*key, F.explode(_grams(F.col(text), gram)).alias("gram")).join(often, "gram", "left")
    ranked = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram"))).alias("g"))
    return ranked.select(*key, F.transform("g", lambda x: x["gram"]).alias("grams"))


def similar_candidates(dirty: DataFrame, icd: DataFrame, gram: int = 2, min_score: float = 0.5, raw: str = "raw") -> DataFrame:
    """raw, code, name: the pairs that can reach the score, a superset of those that do.

    Prefix filter: with grams in one order, two sets that reach the score share a gram among the first
    size - least + 1 of each, `least` being what a set of this size has in common with any match. Rare grams
    come first, so a gram that most names hold joins hardly anything. Length filter: sizes may differ by a
    factor of (2 - s) / s. Position filter: what is left behind the first shared gram has to suffice.
    """
    if not 0 < min_score <= 1:
        raise ValueError("min_score has to lie above 0 and at most at 1")
    names = icd.select("code", "name").filter(F.col("name").isNotNull()).distinct()
    often = names.select("code", "name", F.explode(_grams(F.col("name"), gram)).alias("gram")).groupBy("gram").agg(F.count("*").alias("names"))
    distinct = dirty.select(raw).filter(F.col(raw).isNotNull()).distinct()

    def prefixes(df: DataFrame, key: list[str], text: str, side: str) -> DataFrame:
        size = F.size("grams")
        sized = _ranked(df, key, text, often, gram).withColumn(f"n_{side}", size)
        first = F.slice("grams", F.lit(1), size - _least_common(size, min_score) + 1)
        return sized.select(*key, f"n_{side}", F.posexplode(first).alias(f"at_{side}", "gram"))

    left, right = prefixes(distinct, [raw], raw, "left"), prefixes(names, ["code", "name"], "name", "right")
    n, m = F.col("n_left"), F.col("n_right")
    ratio = (2 - min_score) / min_score
    met = left.join(right, "gram").filter((n <= m * ratio + 1e-9) & (m <= n * ratio + 1e-9))
    pairs = met.groupBy(raw, "code", "name", "n_left", "n_right").agg(F.min("at_left").alias("i"), F.min("at_right").alias("j"))
    most = 1 + F.least(n - F.col("i") - 1, m - F.col("j") - 1)
    return pairs.filter(2 * most >= min_score * (n + m) - 1e-9).select(raw, "code", "name")


def match_similar(dirty: DataFrame, icd: DataFrame, gram: int = 2, min_score: float = 0.5, raw: str = "raw") -> DataFrame:
    """raw, code, score of the best name by Dice on distinct n-grams; ties by edit distance, then code.

    Exact: the candidates hold every pair that reaches the score, and each is scored on its whole sets.
    Null texts match nothing; repeated texts are matched once.
    """
    pairs = similar_candidates(dirty, icd, gram, min_score, raw)
    a, b = _grams(F.col(raw), gram), _grams(F.col("name"), gram)
    scored = pairs.withColumn("score", 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).filter(F.col("score") >= min_score)
    order = F.struct((-F.col("score")).alias("s"), F.levenshtein(F.col(raw), F.col("name")).alias("d"), F.col("code").alias("c"), F.col("score").alias("score"))
    return scored.groupBy(raw).agg(F.min(order).alias("best")).select(raw, F.col("best.c").alias("code"), F.col("best.score").alias("score"))


def mapping(dirty: DataFrame, icd: DataFrame, gram: int = 2, min_score: float = 0.5, raw: str = "raw") -> DataFrame:
    """Exact matches, and similar ones for the rest."""
    exact = match_exact(dirty, icd, raw)
    rest = dirty.join(exact, raw, "left_anti")
    return exact.unionByName(match_similar(rest, icd, gram, min_score, raw))


def standardise_codes(visits: DataFrame, found: DataFrame, raw: str = "raw") -> DataFrame:
    """visits with code and score; null where nothing matched."""
    return visits.join(found, raw, "left")


def unmatched(visits: DataFrame, found: DataFrame, raw: str = "raw") -> DataFrame:
    """The reject table: raw strings without a code, and how many rows have them."""
    return visits.join(found, raw, "left_anti").groupBy(raw).agg(F.count("*").alias("n"))


def block_index(blocks: DataFrame) -> DataFrame:
    """block, lo, hi, width, prefix: each range of codes as the prefixes that its codes begin with.

    Both ends share their first characters; the next one runs from that of `lo` to that of `hi`. Ends with
    other characters than ASCII, or of which one is all that the other begins with, keep the shared part alone.
    """
    known = blocks.select("block", "lo", "hi").filter(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi")))
    n = F.least(F.length("lo"), F.length("hi"))
    shared = F.size(F.filter(F.sequence(F.lit(0), n), lambda i: (i > 0) & (F.substring("lo", F.lit(1), i) == F.substring("hi", F.lit(1), i))))
    cut = known.withColumn("_n", shared).withColumns({"_a": F.ascii(F.substring("lo", F.col("_n") + 1, F.lit(1))), "_b": F.ascii(F.substring("hi", F.col("_n") + 1, F.lit(1)))})
    runs = (F.col("_n") < n) & (F.col("_b") < 128)
    head = F.substring("lo", F.lit(1), F.col("_n"))
    prefixes = F.when(runs, F.transform(F.sequence("_a", F.when(runs, F.col("_b")).otherwise(F.col("_a"))), lambda c: F.concat(head, F.char(c)))).otherwise(F.array(head))
    return cut.select("block", "lo", "hi", F.when(runs, F.col("_n") + 1).otherwise(F.col("_n")).alias("width"), F.explode(prefixes).alias("prefix"))


def to_block(df: DataFrame, blocks: DataFrame, code: str = "code", width: int = 3) -> DataFrame:
    """df with the block whose range holds the code's first `width` characters; null outside all and for a null code.

    The distinct beginnings of the codes meet the ranges by equal prefixes, and the rows meet the result by
    equality, so neither join is a nested loop. A code in several ranges gives a row for each.
    """
    key = F.substring(F.col(code), 1, width)
    keys = df.select(key.alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    each = keys.select("_key", F.explode(F.sequence(F.lit(0), F.length("_key"))).alias("width")).withColumn("prefix", F.substring("_key", F.lit(1), F.col("width")))
    found = each.join(block_index(blocks), ["width", "prefix"]).filter(F.col("_key").between(F.col("lo"), F.col("hi"))).select("_key", "block").distinct()
    return df.drop("block").withColumn("_key", key).join(found, "_key", "left").drop("_key")
