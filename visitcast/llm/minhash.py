"""Near-duplicate detection by HyperMinHash.

A document is its set of distinct word shingles. For each of BANDS * ROWS buckets
the smallest hash of the set is kept in 16 bits: 6 of leading-zero count and 10 of
mantissa. ROWS registers in a row, packed exactly in a long, are a band key; equal
keys make candidates. A candidate's Jaccard similarity is estimated from equal
registers, corrected for chance collisions of the compressed registers, and pairs
that could not reach the threshold (binomial tail below MISS) go; the rest are
confirmed on the full sets. Components of confirmed links get the smallest doc_id.

Work stays linear on large groups: equal sets are one class from the start; each
bucket's members are first compared with the bucket's smallest id only; components
are found; then only members of buckets that still span several components are
compared, block by block inside tasks: first their registers, by the estimate, then
the full sets of those members that may still be linked with another component. These
tasks emit nothing but links that join components. Blocks are bounded in members and
in shingles; no bucket is held whole in one task and no link that could change a
component is left out. In a bucket that stays unresolved the comparison of registers
is quadratic in its members, that of texts in those that the estimate leaves.

With 24 bands of 3 registers a pair of similarity s shares no band with
probability (1 - s^3)^24: 3e-8 at 0.8, 1e-10 at 0.85.

Defined results: a null text and a text of blanks have an empty set, linked with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat a
doc_id are one vertex (linked if any of their texts is); rows without doc_id are
linked with nothing, their component is null and they stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import BROADCAST_ROWS, keyed, modest_batches, small, spread, table, text_of, without, written
from visitcast.llm.text_bytes import mix, pieces, tidied, word_hashes

BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Chance at most that the estimate drops a pair which reaches the threshold.
MISS = 1e-9
#: Members of a star that are compared in one block, shingles of theirs in all, and at a time.
BLOCK, SHINGLES, COLUMNS = 256, 400_000, 4096

_U = np.uint64

_MUL = mix(np.arange(1, REGISTERS + 1, dtype=_U)) | _U(1)
_ADD = mix(np.arange(1001, 1001 + REGISTERS, dtype=_U))


def _hashed(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; text i is data[offsets[i]:offsets[i + 1]]."""
    _, _, words, bounds = word_hashes(data, offsets)
    rolled = np.zeros(max(len(words) - width + 1, 0), dtype=_U)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _MUL[j]
    rolled = mix(rolled + _U(width))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(w) * int(m) for w, m in zip(words[a:b], _MUL, strict=False)) + int(b - a) & (1 << 64) - 1], dtype=_U)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in turn."""
    for data, offsets in pieces(texts):
        yield from _hashed(data, offsets, width)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), REGISTERS), dtype=np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat(flat * _MUL[i] + _ADD[i], starts)
        zeros = np.clip(64 - np.frexp(least.astype(np.float64))[1], 0, 63).astype(_U)
        out[:, i] = (zeros << _U(MANTISSA)) | (((least << zeros) << _U(1)) >> _U(64 - MANTISSA))
    return out


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f1, f2, sig = [], [], [], []

        def flush(some: list[np.ndarray]) -> None:
            full = [s for s in some if len(s)]
            rows = iter(registers(full)) if full else iter(())
            for s in some:
                n.append(len(s))
                f1.append(int(np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if len(s) else 0)
                f2.append(int(np.add.reduce(mix(s * _U(3))).astype(np.int64)) if len(s) else 0)
                sig.append(next(rows).tobytes() if len(s) else None)

        some, held = [], 0
        for s in shingle_sets(batch.column("text"), width):
            some.append(s)
            held += len(s)
            if held > 100_000:
                flush(some)
                some, held = [], 0
        flush(some)
        ids = [batch.column(c) for c in ("doc_id", "_k", "_t")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "_k", "_t", "n", "f1", "f2", "sig"])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, _k, _t, n (set size), f1 and f2 (128-bit hash of the set), sig (registers) per row."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    return rows.mapInArrow(lambda it: tidied(_signed(it, width)), "doc_id long, _k long, _t long, n long, f1 long, f2 long, sig binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            r = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS).astype(np.int64)
            keys = np.arange(BANDS, dtype=np.int64)[None, :] << 48 | r[:, :, 0] << 32 | r[:, :, 1] << 16 | r[:, :, 2]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["key", "rep"])


@lru_cache(maxsize=1)
def _chance() -> np.ndarray:
    """Probability that registers of disjoint sets of 2^i and 2^j shingles are equal by chance."""
    low = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(40)])
    wide = np.repeat(2.0 ** -(np.arange(40) + 1.0) / (1 << MANTISSA), 1 << MANTISSA)
    p = np.stack([np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(low + wide, 1 - 1e-16))) for n in 2.0 ** np.arange(33)])
    return p @ p.T


@lru_cache(maxsize=4)
def _least_equal(percent: int) -> int:
    """Equal registers below which a pair of the threshold's similarity falls with chance MISS at most."""
    t, tail = percent / 100, 0.0
    for m in range(REGISTERS + 1):
        tail += comb(REGISTERS, m) * t**m * (1 - t) ** (REGISTERS - m)
        if tail > MISS:
            return m
    return REGISTERS


def estimate(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity from equal registers, corrected for collisions, and the chance of these."""
    c = _chance()[np.clip(np.round(np.log2(np.maximum(n1, 1))), 0, 32).astype(int), np.clip(np.round(np.log2(np.maximum(n2, 1))), 0, 32).astype(int)]
    return (equal / REGISTERS - c) / (1 - c), c


def _likely(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    est, c = estimate(equal, n1, n2)
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return fits & (est >= (_least_equal(percent) / REGISTERS - c) / (1 - c) - 1e-12)


def _estimated(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            ok = _likely((x == y).sum(axis=1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _confirmed(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.zeros(batch.num_rows, dtype=bool)
        last_id, last = None, None
        for i, (a, y) in enumerate(zip(batch.column("a").to_pylist(), shingle_sets(batch.column("text_b"), width), strict=True)):
            if a != last_id or batch.column("text_a")[i] != last[0]:
                text = batch.column("text_a").slice(i, 1)
                last_id, last = a, (text[0], next(shingle_sets(text, width)))
            x = last[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = both and 100 * both >= percent * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _texts(ids: DataFrame, docs: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """rep, text: one text of each class in `ids` (rep, distinct)."""
    wanted = small(ids.join(classes.select("rep", "rep_t"), "rep").select(F.col("rep").alias("_k"), F.col("rep_t").alias("_t")), rows)
    found = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).join(wanted, ["_k", "_t"])
    return written(found.select(F.col("_k").alias("rep"), "text").distinct(), "minhash-texts")


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """The links among `pairs` (a, b: class ids), by estimate and then by the full sets."""
    mine = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    fit = pairs.join(mine("a"), "a").join(mine("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = written(fit.mapInArrow(lambda it: tidied(_estimated(it, percent)), "a long, b long").distinct(), "minhash-pairs")
    texts = _texts(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, classes, rows)
    side = lambda s: texts.select(F.col("rep").alias(s), F.col("text").alias(f"text_{s}"))
    return likely.join(side("b"), "b").join(side("a"), "a").mapInArrow(lambda it: tidied(_confirmed(it, width, percent)), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of `edges` (a, b), by large-star and small-star steps."""
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = written(star.filter("a != b").distinct(), "components")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, from products of their incidence matrices, COLUMNS shingles at a time.

    Of one list with itself, a set's size is not counted as its intersection with itself.
    """
    sets = left if right is left else left + right
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    everywhere = times == len(sets)
    use = (times > 1) & ~everywhere
    place = np.cumsum(use) - 1
    row, column = row[use[column]], place[column[use[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.full((len(left), len(right)), int(everywhere.sum()), dtype=np.float32)
    for at in range(0, int(use.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[: len(left)] @ m[len(sets) - len(right) :].T
    return out


def _possible(pdf, percent: int):
    """The members of one block pair of a star that the estimate may link with a member of another component."""
    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    whole = not len(right) or not len(left)
    if whole:
        left = right = pdf
    x, y = (np.frombuffer(b"".join(p.sig), dtype=np.uint16).reshape(-1, REGISTERS) for p in (left, right))
    equal = np.zeros((len(x), len(y)), dtype=np.int64)
    for r in range(REGISTERS):
        equal += x[:, r][:, None] == y[:, r][None, :]
    ok = _likely(equal, left.n.to_numpy()[:, None], right.n.to_numpy()[None, :], percent) & (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :])
    found = [left[ok.any(axis=1) | ok.any(axis=0)]] if whole else [left[ok.any(axis=1)], right[ok.any(axis=0)]]
    import pandas as pd

    return pd.concat(found)[["pivot", "i", "j", "side", "rep", "comp"]]


def _joining(pdf, width: int, percent: int):
    """Links in one block pair of a star that join components: a forest over these."""
    import pandas as pd

    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    whole = not len(right) or not len(left)
    if whole:
        left = right = pdf
    sets = [list(shingle_sets(pa.array(p.text, pa.string()), width)) for p in ((left,) if whole else (left, right))]
    x, y = sets[0], sets[-1]
    both = _common(x, y)
    n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    links = (both > 0) & (100 * both.astype(np.int64) >= percent * (n[:, None] + m[None, :] - both.astype(np.int64))) & (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = find(left.comp.iat[i]), find(right.comp.iat[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((left.rep.iat[i], right.rep.iat[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _rest(members: DataFrame, comps: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, block: int, rows: int) -> DataFrame:
    """Links a, b that join components, among members of buckets of three or more that still span several.

    Buckets of one pivot are taken together: their members form a star, and pairs of
    a star meet once instead of once for each bucket that they share.
    """
    at = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "pivot", "rep", F.coalesce("component", "rep").alias("comp"))
    open_ = at.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("size > 2 AND c0 != c1")
    # A hot bucket's members would meet in one task if both sides were dealt by key.
    open_ = small(written(open_.select("key"), "minhash-open"), rows)
    stars = written(at.join(open_, "key", "left_semi").select("pivot", "rep", "comp").distinct(), "minhash-stars")
    weighed = stars.join(classes.select("rep", "n", "sig"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks")
    # Written, since rows dealt by pivot would pass for dealt by block pair, and a star would stay in one task.
    sized = written(weighed.join(small(weighed.groupBy("pivot").agg(blocks), rows), "pivot"), "minhash-sized").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j"), (F.col("own") > j).cast("int").alias("side")))
    cells = sized.select("pivot", F.inline(cell), "rep", "comp", "n", "sig").groupBy("pivot", "i", "j")
    left = written(cells.applyInPandas(lambda pdf: _possible(pdf, percent), "pivot long, i int, j int, side int, rep long, comp long"), "minhash-possible")
    texts = _texts(left.select("rep").distinct(), docs, classes, rows)
    return left.join(texts, "rep").groupBy("pivot", "i", "j").applyInPandas(lambda pdf: _joining(pdf, width, percent), "a long, b long")


def components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, _k, _t, n_shingles, component_id, kept: one row per input row.

    Links are pairs with 100 * intersection >= percent * union of their sets of
    `width`-word shingles (A-Z lower-cased, words split at ASCII blanks).
    """
    modest_batches(docs.sparkSession)
    signed = written(signatures(docs, width), "minhash-signatures")
    whole = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(whole.groupBy("f1", "f2", "n").agg(F.min(F.struct("_k", "_t", "sig")).alias("r")).select("f1", "f2", "n", F.col("r._k").alias("rep"), F.col("r._t").alias("rep_t"), "r.sig"), "minhash-classes")
    banded = classes.select("rep", "sig").mapInArrow(lambda it: tidied(_banded(it)), "key long, rep long")
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot != last").drop("last")
    members = written(banded.join(shared, "key"), "minhash-members")
    stars = members.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    twice = whole.groupBy("_k").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).filter("x != y").select("_k")
    same = whole.join(twice, "_k", "left_semi").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select(F.col("_k").alias("a"), F.col("rep").alias("b"))
    links = written(_confirm(stars, docs, classes, width, percent, broadcast_rows).union(same), "minhash-links")
    comps = written(connected(links), "minhash-components")
    rest = written(_rest(members, comps, docs, classes, width, percent, block, broadcast_rows), "minhash-rest")
    if rest.limit(1).count():
        comps = written(connected(links.union(rest)), "minhash-components")
    found = classes.select("f1", "f2", "n", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("found"))
    out = signed.select("doc_id", "_k", "_t", "n", "f1", "f2").join(found, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "_k", "_t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with all columns; of rows that repeat a doc_id, one."""
    judged = written(components(docs, width, percent), "minhash-judged")
    again = judged.filter("doc_id IS NOT NULL").groupBy("_k").agg(F.count("*").alias("rows"), F.min("_t").alias("first_t")).filter("rows > 1")
    rejected = judged.filter("NOT kept").select("_k", "_t").union(judged.join(again, "_k").filter("_t != first_t").select("_k", "_t"))
    left = without(docs, rejected)
    if not again.limit(1).count():
        return left
    marked = keyed(left).join(small(again.select("_k")).withColumn("_again", F.lit(True)), "_k", "left")
    once = marked.filter("_again").dropDuplicates(["_k", "_t"])
    return marked.filter("_again IS NULL").unionByName(once).select(docs.columns)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def _sql(source: str, width: int, percent: int) -> str:
    """DuckDB text up to `grouped` (doc_id, n_shingles, component_id, kept); exact, over all pairs that share a shingle."""
    cut = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
mh_words AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex({cut}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM {source}),
mh_sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {width - 1}], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 1}, 1) + 1)) AS i FROM mh_words WHERE len(ws) > 0)),
mh_n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM mh_sh GROUP BY doc_id),
mh_edge AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM mh_sh x JOIN mh_sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN mh_n na ON na.doc_id = p.a JOIN mh_n nb ON nb.doc_id = p.b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
mh_reach AS (SELECT doc_id AS v, doc_id AS c FROM mh_n UNION SELECT e.b, r.c FROM mh_reach r JOIN mh_edge e ON e.a = r.v AND r.c < e.b),
grouped AS (
  SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, w.doc_id) AS component_id, coalesce(r.c, w.doc_id) = w.doc_id AS kept
  FROM mh_words w LEFT JOIN mh_n n USING (doc_id) LEFT JOIN (SELECT v, min(c) AS c FROM mh_reach GROUP BY v) r ON r.v = w.doc_id)"""


ORACLE_SQL = f"WITH RECURSIVE {_sql('documents', 3, 85)} SELECT doc_id, n_shingles, component_id, kept FROM grouped"
