"""Substring dedup by suffix automata of reference shards.

A window is `span` consecutive words. A word goes if a window that covers it also
starts in a document with a smaller id, judged on the input.

1. Fragments. Neighbouring windows whose least hash of GRAM words is the same are one
   fragment, under that hash as key. Cuts depend on the words alone, so equal windows
   lie in fragments of equal keys, and equal passages are cut alike inside.
2. Keys that two documents share are known from their smallest and largest id alone;
   the rest of the corpus, all that repeats nowhere, goes no further. Equal fragments
   (two 64-bit hashes and the length) are one class, with its smallest id: in larger
   ids all of it goes.
3. References. Where classes of one key differ, their windows are compared by hash; each
   repeated one belongs to the class with the smallest id. Runs of such windows are the
   references: no window of the corpus stands in them twice.
4. Automata. References are dealt by key into shards of about SHARD_WORDS words. A
   shard's suffix automaton is built from the words themselves, each state with the
   smallest id that it occurs in, and is sent to as many tasks as its share of the stream
   asks for. The classes' texts are streamed through it: where the matching statistic
   reaches `span` words of a smaller id, the maximal spans go.
5. Spans meet the places of their classes and, merged, the documents.

An automaton of the whole corpus can't be broadcast; a shard's has a bound, since keys
with more references than a shard holds are dealt window by window. No group is
gathered in one task: keys, classes and windows are aggregated before the shuffle and
joined by joins that adaptive execution can split.

Defined results: a null text stays null with 0 words; texts under `span` words lose
nothing; a null id counts as the largest; rows of one id (repeated ones, or with another
text) take no words from each other; a document may become empty, its row stays; an
empty table gives no rows; other columns pass through (names that begin with _ are
reserved). The text left is the kept words joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import BLANKS, BROADCAST_ROWS, keyed, modest, small, spread, table, text_of, written
from visitcast.llm.text_bytes import Runs, pieces, sliding_least, tidied, word_hashes

SPAN = 50
#: Words whose least hash is a fragment's key.
GRAM = 10
#: Words of references in an automaton, and of the texts that one task streams through it.
SHARD_WORDS, STREAM_WORDS = 50_000, 1_000_000

_CLASS = ["m", "h", "n"]


class Automaton:
    """Suffix automaton of several word sequences; each state knows the smallest id of those it occurs in."""

    def __init__(self, sequences: list[tuple[int, list[str]]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]
        for owner, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w, owner)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            self.least[up] = min(self.least[up], self.least[state])

    def _state(self, length: int, link: int, after: dict[str, int], least: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def _split(self, state: int, word: str, target: int) -> int:
        """The state for the strings of `target` that `state` and its suffixes reach by the word."""
        short = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]), 1 << 63)
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = short
            state = self.link[state]
        self.link[target] = short
        return short

    def _extend(self, last: int, word: str, owner: int) -> int:
        found = self.next[last].get(word)
        if found is not None:  # another sequence has gone this way
            new = found if self.length[found] == self.length[last] + 1 else self._split(last, word, found)
            self.least[new] = min(self.least[new], owner)
            return new
        new = self._state(self.length[last] + 1, 0, {}, owner)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            found = self.next[last][word]
            self.link[new] = found if self.length[found] == self.length[last] + 1 else self._split(last, word, found)
        return new

    def spans(self, words: list[str], owner: int, span: int) -> list[tuple[int, int]]:
        """Maximal spans made of windows of `span` words that occur under a smaller id than `owner`."""
        after, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words, 1):
            while state and w not in after[state]:
                state = link[state]
                matched = length[state]
            to = after[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            while length[link[state]] >= span:  # the state of the last `span` words and no more
                state = link[state]
                matched = length[state]
            if matched >= span and least[state] < owner:
                begin = i - span
                if out and out[-1][1] >= begin:
                    begin = out.pop()[0]
                out.append((begin, i))
        return out


def _cut(hashes: np.ndarray, bounds: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, key and hash of each fragment of the texts whose words lie between `bounds`."""
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < span:
        return none, none, none, none
    runs, width = Runs(hashes), span - gram + 1
    first = np.arange(len(hashes) - gram + 1)
    key = sliding_least(runs(first, first + gram), width)
    a, b = bounds[:-1], bounds[1:] - span + 1
    whole = b > a
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(steps, a[whole], 1)
    np.add.at(steps, b[whole], -1)
    at = np.flatnonzero(np.cumsum(steps[:-1]))
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (key[at[1:]] != key[at[:-1]])
    begin = np.flatnonzero(new)
    long = np.diff(np.append(begin, len(at)))
    times = -(-long // width)  # where a text turns in a circle, one key may hold for any number of windows
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    n = np.minimum(np.repeat(long, times) - turn * width, width)
    start = at[np.repeat(begin, times) + turn * width]
    return start, n, key[start].view(np.int64), runs(start, start + n + span - 1).view(np.int64)


def fragments(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """_k, _t, m (key), h (hash), n (windows), at (first word) of every fragment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t = (batch.column(c).to_numpy() for c in ("_k", "_t"))
            row = 0
            for data, offsets in pieces(batch.column("text")):
                _, _, hashes, bounds = word_hashes(data, offsets, lower=False)
                start, n, m, h = _cut(hashes, bounds, span, gram)
                own = np.searchsorted(bounds, start, side="right") - 1
                columns = [k[row + own], t[row + own], m, h, n.astype(np.int32), (start - bounds[own]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_k", "_t", "m", "h", "n", "at"])
                row += len(offsets) - 1

    rows = keyed(docs).select("_k", "_t", text_of().alias("text"))
    with modest(docs.sparkSession):
        return written(rows.mapInArrow(lambda b: tidied(cut(b)), "_k long, _t long, m long, h long, n int, at int"), "repeat-fragments")


def _texts(docs: DataFrame, classes: DataFrame, span: int, rows: int) -> DataFrame:
    """classes with their words (joined by a space), the hashes of their windows and a number of their own, read from their first document."""
    asks = classes.groupBy(F.col("first._k").alias("_k"), F.col("first._t").alias("_t")).agg(F.collect_list(F.struct(*_CLASS, F.col("first.at").alias("at"))).alias("asks"))
    # Rows that repeat an id and text give a piece each; all that is made of pieces are minima and sets.
    found = keyed(docs).select("_k", "_t", text_of().alias("text")).join(small(written(asks, "repeat-asks"), rows), ["_k", "_t"])
    names = ["m", "h", "n", "owner", "words", "windows"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, asked in enumerate(batch.column("asks")):
                out = []
                for data, offsets in pieces(batch.column("text").slice(i, 1)):
                    start, end, hashes, _ = word_hashes(data, offsets, lower=False)
                    runs, raw = Runs(hashes), data.tobytes()
                    for x in asked.as_py():
                        at = np.arange(x["at"], x["at"] + x["n"])
                        last = x["at"] + x["n"] + span - 1
                        words = b" ".join(raw[a:b] for a, b in zip(start[x["at"] : last].tolist(), end[x["at"] : last].tolist(), strict=True))
                        out.append((x["m"], x["h"], x["n"], batch.column("_k")[i].as_py(), words.decode(), runs(at, at + span).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names)

    with modest(docs.sparkSession, rows=200):
        return written(found.mapInArrow(lambda b: tidied(read(b)), "m long, h long, n int, owner long, words string, windows array<long>").withColumn("piece", F.monotonically_increasing_id()), "repeat-texts")


def _units(texts: DataFrame, span: int, gram: int, shard_words: int, rows: int) -> DataFrame:
    """key, kind (0 reference, 1 stream), class, base (first window), owner, words and, of references, the windows they stand for."""
    width = span - gram + 1  # no piece has more windows, so piece and window are one number
    window = texts.select("m", "owner", "piece", F.posexplode("windows").alias("o", "w")).select("m", "w", "owner", (F.col("piece") * width + F.col("o")).alias("at"))
    first = window.groupBy("m", "w").agg(F.min(F.struct("owner", "at")).alias("a"), F.max("owner").alias("last")).filter(F.col("a.owner") < F.col("last"))
    at = F.col("a.at")
    owned = written(first.groupBy("m", F.floor(at / width).alias("piece")).agg(F.array_sort(F.collect_set((at % width).cast("int"))).alias("owned")), "repeat-owned")
    # Keys with many references, whose windows are dealt by their own hash.
    weight = F.sum(F.size("owned") + span - 1)
    keys = written(owned.groupBy("m").agg((weight > shard_words).alias("heavy")), "repeat-keys")
    both = texts.join(small(keys, rows), "m").join(small(owned.drop("m"), rows // 8), "piece", "left")
    # A piece is streamed, and a reference as well if it owns windows.
    kinds = F.explode(F.when(F.col("owned").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("kind", kinds).withColumn("owned", F.when(F.col("kind") == 0, F.col("owned")))
    light = both.filter("NOT heavy").select(F.col("m").alias("key"), "kind", *_CLASS, F.lit(0).alias("base"), "owner", "words", "owned")
    single = both.filter("heavy").select("*", F.posexplode("windows").alias("base", "w")).filter("kind = 1 OR array_contains(owned, base)")
    word = F.array_join(F.slice(F.split("words", " "), F.col("base") + 1, F.lit(span)), " ")
    return light.unionByName(single.select(F.xxhash64("m", "w").alias("key"), "kind", *_CLASS, "base", "owner", word.alias("words"), F.when(F.col("kind") == 0, F.array(F.lit(0))).alias("owned")))


def _stretches(owned: list[int], span: int) -> Iterator[tuple[int, int]]:
    """First and past-the-last word of the runs of neighbouring windows."""
    begin = last = owned[0]
    for o in owned[1:]:
        if o != last + 1:
            yield begin, last + span
            begin = o
        last = o
    yield begin, last + span


def matched(texts: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS, rows: int = BROADCAST_ROWS) -> DataFrame:
    """m, h, n, spans: what goes of a class (words from its first one on) in the document with its smallest id."""
    units = written(_units(texts, span, gram, shard_words, rows).withColumn("long", F.size(F.split("words", " "))), "repeat-units")
    total = units.agg(F.sum(F.when(F.col("kind") == 0, F.col("long"))).alias("n")).first().n or 0
    shards = 1 + 2 * total // shard_words
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    salts = dealt.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("kind") == 1, F.col("long"))) / stream_words)).cast("int").alias("salts"))
    salted = dealt.join(small(salts, rows), "shard")
    own = F.array(F.pmod(F.xxhash64(*_CLASS, "base"), F.col("salts")).cast("int"))
    sent = salted.withColumn("salt", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sequences, automaton = None, [], None
        for batch in batches:
            out = []
            for shard, salt, kind, m, h, n, base, owner, text, owned in zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "kind", *_CLASS, "base", "owner", "words", "owned")), strict=True):
                if (shard, salt) != here:
                    here, sequences, automaton = (shard, salt), [], None
                words = text.split(" ")
                if not kind:
                    sequences += [(owner, words[a:b]) for a, b in _stretches(owned, span)]
                    continue
                automaton = automaton or Automaton(sequences)
                out += [(m, h, n, base + a, base + b) for a, b in automaton.spans(words, owner, span)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], [*_CLASS, "a", "b"])

    ordered = sent.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = ordered.select("shard", "salt", "kind", *_CLASS, "base", "owner", "words", "owned").mapInArrow(lambda b: tidied(match(b)), "m long, h long, n int, a int, b int")
    with modest(texts.sparkSession):
        return written(found.groupBy(*_CLASS).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "repeat-matched")


def covered(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS, rows: int = BROADCAST_ROWS) -> DataFrame:
    """_k, _t, a, b: the merged spans of words that go, as two arrays per document that loses any."""
    if not 1 <= gram < span:
        raise ValueError("gram has to lie below span")
    cut = fragments(docs, span, gram)
    # Sides that a join meets by key are written first: where they are too many to broadcast, both sides
    # of the join are dealt for it alone, and adaptive execution can split a hot key.
    shared = written(cut.groupBy("m").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).filter("lo < hi").select("m"), "repeat-keys")
    cut = written(cut.join(small(shared, rows), "m", "left_semi"), "repeat-shared")
    classes = written(cut.groupBy(*_CLASS).agg(F.min(F.struct("_k", "_t", "at")).alias("first"), F.max("_k").alias("last")), "repeat-classes")
    several = written(classes.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), "repeat-keys")
    inner = matched(_texts(docs, classes.join(small(several, rows), "m", "left_semi"), span, rows), span, gram, shard_words, stream_words, rows)
    known = classes.join(inner, _CLASS, "left").filter("first._k < last OR spans IS NOT NULL").select(*_CLASS, F.col("first._k").alias("owner"), "spans")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + span - 1).alias("b")))
    gone = cut.join(small(written(known, "repeat-known"), rows), _CLASS).select("_k", "_t", "at", F.when(F.col("_k") > F.col("owner"), whole).otherwise(F.col("spans")).alias("s")).filter("s IS NOT NULL")
    spans = gone.select("_k", "_t", F.explode(F.transform("s", lambda x: F.struct((F.col("at") + x["a"]).alias("a"), (F.col("at") + x["b"]).alias("b")))).alias("s"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for x in batch.column("spans"):
                flat = x.values.flatten()
                a, b = np.sort(flat[0].to_numpy()), np.sort(flat[1].to_numpy())
                new = np.append(True, a[1:] > b[:-1])  # with both ends sorted, a gap lies where the next one begins after all before have ended
                out[0].append(a[new])
                out[1].append(b[np.append(new[1:], True)])
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_t"), *(pa.array(c, pa.list_(pa.int32())) for c in out)], ["_k", "_t", "a", "b"])

    grouped = spans.groupBy("_k", "_t").agg(F.collect_set("s").alias("spans"))
    with modest(docs.sparkSession):
        return written(grouped.mapInArrow(merge, "_k long, _t long, a array<int>, b array<int>"), "repeat-spans")


def dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the text less its repeated spans, and _n_words, _n_removed beside its own columns."""
    gone = covered(docs, span, gram, shard_words, stream_words, rows)
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("a")), F.lit(0))).first()
    side = F.broadcast(gone) if size[0] + size[1] // 4 <= rows else gone
    said = F.filter(F.split(text_of(), BLANKS), lambda w: w != "")
    joined = keyed(docs).join(side.withColumnsRenamed({"a": "_a", "b": "_b"}), ["_k", "_t"], "left").withColumn("_words", said)
    # What is kept lies from the end of a span to the beginning of the next.
    begin, end = F.concat(F.array(F.lit(0)), F.col("_b")), F.concat(F.col("_a"), F.array(F.size("_words")))
    kept = F.flatten(F.zip_with(begin, end, lambda x, y: F.slice("_words", x + 1, y - x)))
    left = F.when(F.col("_a").isNull(), F.col("_words")).otherwise(kept)
    rows_ = joined.withColumn("_left", left)
    text = F.when(F.col("text").isNotNull(), F.array_join("_left", " "))
    count = lambda c: F.size(c).cast("long")
    return rows_.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], count("_words").alias("_n_words"), (count("_words") - count("_left")).alias("_n_removed"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(text_of(), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH sd_docs AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sd_win AS (SELECT rid, k, i, sha256(array_to_string(ws[i:i + {SPAN - 1}], ' ')) AS w FROM (SELECT rid, k, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM sd_docs)),
sd_late AS (SELECT rid, i FROM (SELECT rid, i, k, min(k) OVER (PARTITION BY w) AS first FROM sd_win) WHERE first < k),
sd_gone AS (SELECT DISTINCT rid, unnest(range(i, i + {SPAN})) AS p FROM sd_late),
sd_left AS (
  SELECT w.rid, count(*) AS n, string_agg(x, ' ' ORDER BY w.p) AS kept FROM (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM sd_docs) w
  ANTI JOIN sd_gone g ON g.rid = w.rid AND g.p = w.p GROUP BY w.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM sd_docs LEFT JOIN sd_left USING (rid)"""
