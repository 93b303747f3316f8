"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. A passage's input is hashed counts
of its words, pairs of words and runs of three bytes (square roots of their shares),
with shares of character classes, word lengths, capitals and repeated words; a dense
layer learns the passage's vector from them. Gated attention (tanh times sigmoid)
learns from document labels how much each passage weighs, and the weighted passage
representation is scored. Labels, language, source and ids are no inputs.

The network is fitted on the driver, on at most `sample` labelled documents of at
most `size` bytes of text in all (those with the smallest hash of doc_id; documents
above a hundredth of `size` come last): documented bounds. Sampled texts are encoded
whole. Every whole text is then scored in Arrow batches, a bounded block of passages
at a time.

Defined results: null and empty texts are one empty passage and get a score; a
document labelled twice with both labels counts as 1; labels without a document
are ignored; with labels of no or one kind every score is that kind's share (0.5
for none); repeated rows are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitcast.llm.common import modest_batches, sampled, spread, table, text_of
from visitcast.llm.text_bytes import _LOWER, mix, pieces, tidied, word_hashes

PASSAGE = 64
SAMPLE, SIZE = 4000, 16 << 20
HIDDEN, GATE, STEPS, BATCH, RATE, DECAY, SEED = 16, 8, 1000, 64, 0.005, 1e-3, 7
#: Buckets of hashed words and word pairs, and of hashed runs of three bytes; powers of two.
WORDS, RUNS = 512, 512
#: Buckets are divided by so many of their mean deviations: they are many, and each says little.
SOFT = 4.0
#: Passages that are encoded together.
BLOCK = 512
#: Classes of bytes, in order; anything else in ASCII is "other".
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&|<>", "\"'()-_/@=+")
KINDS = len(CLASSES) + 2
LAYOUT = KINDS + 6
FEATURES = LAYOUT + WORDS + RUNS

_KIND = np.full(256, len(CLASSES), dtype=np.int64)
_KIND[128:] = len(CLASSES) + 1
for _i, _c in enumerate(CLASSES):
    _KIND[np.frombuffer(_c.encode(), dtype=np.uint8)] = _i


def _layout(data, start, end, again, edges, passage_of, words) -> np.ndarray:
    """LAYOUT columns of each passage: how its characters and words look."""
    total = len(words)
    where = np.repeat(np.arange(total), np.diff(edges))
    kinds = np.bincount(where * KINDS + _KIND[data[edges[0] : edges[-1]]], minlength=total * KINDS).reshape(total, KINDS)
    long = (end - start).astype(float)
    per = lambda w=None: np.bincount(passage_of, weights=w, minlength=total)
    n = np.maximum(per(), 1)
    mean = per(long) / n
    spread = np.sqrt(np.maximum(per(long * long) / n - mean * mean, 0))
    capital = per((_KIND[data[start]] == 1).astype(float)) / n
    size = np.maximum(np.diff(edges), 1)
    return np.column_stack([kinds / size[:, None], np.minimum(mean, 50) / 10, np.minimum(spread, 50) / 10, capital, per(again) / n, np.log1p(per()), np.log1p(words)])


def _shares(where: np.ndarray, bucket: np.ndarray, total: int, buckets: int) -> np.ndarray:
    """Square roots of each bucket's share of a passage's grams."""
    n = np.bincount(where * buckets + bucket, minlength=total * buckets).reshape(total, buckets).astype(np.float32)
    return np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1))


def _encode(data: np.ndarray, offsets: np.ndarray) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Blocks of passages' inputs (rows, float32), and each text's first passage, the end included.

    Text i is data[offsets[i]:offsets[i + 1]]. A pair of words belongs to the passage that
    holds both, a run of three bytes of one text to the passage of its first.
    """
    start, end, hashes, bounds = word_hashes(data, offsets)
    counts = np.maximum(1, -(-np.diff(bounds) // PASSAGE))
    first = np.cumsum(np.concatenate([[0], counts]))
    edges = np.empty(first[-1] + 1, dtype=np.int64)
    edges[-1] = len(data)
    passage_of = np.empty(len(start), dtype=np.int64)
    again = np.zeros(len(start))
    for d in range(len(counts)):
        a, b = bounds[d], bounds[d + 1]
        edges[first[d] : first[d + 1]] = [offsets[d], *start[a + PASSAGE : b : PASSAGE]]
        passage_of[a:b] = first[d] + np.arange(b - a) // PASSAGE
        again[a:b] = 1
        again[a + np.unique(hashes[a:b], return_index=True)[1]] = 0
    words = np.repeat(np.diff(bounds), counts)

    def blocks() -> Iterator[np.ndarray]:
        for p in range(0, first[-1], BLOCK):
            q = min(p + BLOCK, first[-1])
            total = q - p
            a, b = np.searchsorted(passage_of, [p, q])
            at, h = passage_of[a:b] - p, hashes[a:b]
            both = np.flatnonzero(at[1:] == at[:-1])
            grams = np.concatenate([h, mix(h[both] * np.uint64(3) + h[both + 1])]).astype(np.int64) & (WORDS - 1)
            pairs = _shares(np.concatenate([at, at[both]]), grams, total, WORDS)
            low = _LOWER[data[edges[p] : edges[q] + 2]].astype(np.uint32)
            where = np.repeat(np.arange(total), np.diff(edges[p : q + 1]))
            inside = np.ones(len(where), dtype=bool)
            for back in (1, 2):
                last = offsets[1:] - back - edges[p]
                inside[last[(last >= 0) & (last < len(where))]] = False
            i = np.flatnonzero(inside)
            runs = (low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * np.uint32(2654435761) >> np.uint32(16) & np.uint32(RUNS - 1)
            layout = _layout(data, start[a:b], end[a:b], again[a:b], edges[p : q + 1], at, words[p:q])
            yield np.hstack([layout.astype(np.float32), pairs, _shares(where[i], runs, total, RUNS)])

    return blocks(), first


class Network:
    """Gated attention over a bag; parameters are small arrays that travel with the tasks."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[-1]), s)
        self.mean, self.scale = mean, scale
        self.p = {"w": draw(HIDDEN, FEATURES), "b": np.zeros(HIDDEN), "v": draw(GATE, HIDDEN), "u": draw(GATE, HIDDEN), "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """The passages' learned vectors."""
        w = self.p["w"] / self.scale
        return np.maximum(x @ w.T.astype(x.dtype) + (self.p["b"] - w @ self.mean), 0)

    def _forward(self, h: np.ndarray, starts: np.ndarray) -> dict:
        p, counts = self.p, np.diff(np.append(starts, len(h)))
        t, s = np.tanh(h @ p["v"].T), 1 / (1 + np.exp(-np.clip(h @ p["u"].T, -30, 30)))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * weight[:, None], starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "y": y, "counts": counts}

    def score(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each bag's score from its passages' vectors."""
        return self._forward(h, starts)["y"]

    def weights(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Attention of each passage; sums to 1 in each bag."""
        return self._forward(h, starts)["weight"]

    def gradient(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.p, self._forward(self.vectors(x), starts)
        h, t, s, weight, counts = f["h"], f["t"], f["s"], f["weight"], f["counts"]
        err = (f["y"] - labels) / len(labels)
        dz = np.repeat(err[:, None] * p["c"], counts, axis=0)
        da = (h * dz).sum(axis=1)
        de = weight * (da - np.repeat(np.add.reduceat(weight * da, starts), counts))
        dg = de[:, None] * p["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = weight[:, None] * dz + dt @ p["v"] + ds @ p["u"]
        dh[h <= 0] = 0
        dw = (dh.T.astype(x.dtype) @ x - np.outer(dh.sum(axis=0), self.mean)) / self.scale
        return {"w": dw, "b": dh.sum(axis=0), "v": dt.T @ h, "u": ds.T @ h, "a": (t * s).T @ de, "c": f["z"].T @ err, "d": np.array([err.sum()])}

    def fit(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Network:
        """About `steps` steps of Adam over batches of BATCH bags, dealt anew in each epoch."""
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        r, counts, i = np.random.default_rng(SEED), np.diff(np.append(starts, len(x))), 0
        for _ in range(-(-steps // -(-len(starts) // BATCH))):
            order = r.permutation(len(starts))
            for at in range(0, len(order), BATCH):
                bags, i = order[at : at + BATCH], i + 1
                here = np.cumsum(counts[bags]) - counts[bags]
                rows = np.repeat(starts[bags] - here, counts[bags]) + np.arange(counts[bags].sum())
                for k, g in self.gradient(x[rows].astype(np.float32), here, labels[bags]).items():
                    g = g + DECAY * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for data, offsets in pieces(batch.column("text")):
            blocks, first = _encode(data, offsets)
            x = np.concatenate([b.astype(np.float16) for b in blocks])
            bags += [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])


def _sample(docs: DataFrame, labels: DataFrame, sample: int, size: int) -> DataFrame:
    """doc_id, label and text of at most `sample` labelled documents of at most `size` bytes in all."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = sampled(usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label")), sample, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # One task sees ids and sizes of the sample only; repeated rows of an id count once each.
    bytes_ = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    order = Window.orderBy(F.col("bytes") * 100 > size, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = bytes_.withColumn("sum", F.sum("bytes").over(order)).filter(F.col("sum") <= size).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id").select("doc_id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> Network | float:
    """The network from a bounded sample of labelled documents; a bare share where only one label occurs."""
    modest_batches(docs.sparkSession)
    rows = _sample(docs, labels, sample, size)
    got = sorted(rows.mapInArrow(lambda it: tidied(_bags(it)), "doc_id long, label int, bag binary").collect())
    y = np.array([r["label"] for r in got], dtype=float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r["bag"], dtype=np.float16).reshape(-1, FEATURES) for r in got]
    x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
    return Network(*moments(x)).fit(x, starts, y)


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the inputs; buckets share one scale, so that rare ones aren't blown up."""
    mean = x.mean(axis=0, dtype=np.float64)
    scale = np.sqrt(np.maximum(sum((x[i : i + BLOCK].astype(float) ** 2).sum(axis=0) for i in range(0, len(x), BLOCK)) / len(x) - mean**2, 0)) + 1e-3
    scale[LAYOUT:] = np.sqrt((scale[LAYOUT:] ** 2).mean()) * SOFT
    return mean, scale


def _scored(batches: Iterator[pa.RecordBatch], model: Network | float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if isinstance(model, float):
            found = np.full(batch.num_rows, model)
        else:
            found = np.empty(batch.num_rows)
            at = 0
            for data, offsets in pieces(batch.column("text")):
                blocks, first = _encode(data, offsets)
                found[at : at + len(offsets) - 1] = model.score(np.concatenate([model.vectors(x) for x in blocks]), first[:-1])
                at += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(found, 6))], ["doc_id", "score"])


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id and score of each row."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lambda it: tidied(_scored(it, model)), "doc_id long, score double")


def op6_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
