"""The encoder and network against plain loops, the gradient, held-out accuracy, the sample's bounds, and odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import SMALL
from helpers import documents, empty, odd

from visitcast.llm import quality_classifier as q
from visitcast.llm import text_bytes

MASK = (1 << 64) - 1


def passages(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for data, offsets in text_bytes.pieces(texts):
        blocks, first = q._encode(data, offsets)
        x = np.concatenate(list(blocks))
        out += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def finalise(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def word_hash(word: bytes) -> int:
    base = 0x9E3779B97F4A7C15
    return finalise(sum(finalise((b + 1) * base & MASK) * pow(base, i, 1 << 64) for i, b in enumerate(word)) & MASK)


def plain_bag(text: str) -> list[list[float]]:
    """The inputs of a text's passages, one word and one byte at a time."""
    data = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
    bag, seen = [], set()
    for n in range(max(1, -(-len(found) // q.PASSAGE))):
        mine = found[n * q.PASSAGE : (n + 1) * q.PASSAGE]
        a = 0 if n == 0 else mine[0].start()
        b = found[(n + 1) * q.PASSAGE].start() if len(found) > (n + 1) * q.PASSAGE else len(data)
        kind = [next((k for k, c in enumerate(q.CLASSES) if chr(x) in c), len(q.CLASSES)) if x < 128 else len(q.CLASSES) + 1 for x in data[a:b]]
        long = [m.end() - m.start() for m in mine]
        mean = sum(long) / len(long) if long else 0
        dev = math.sqrt(max(sum(x * x for x in long) / len(long) - mean * mean, 0)) if long else 0
        hashes, again = [word_hash(low[m.start() : m.end()]) for m in mine], 0
        for h in hashes:
            again += h in seen
            seen.add(h)
        size, count = max(b - a, 1), max(len(mine), 1)
        row = [kind.count(k) / size for k in range(q.KINDS)]
        row += [min(mean, 50) / 10, min(dev, 50) / 10, sum(65 <= data[m.start()] <= 90 for m in mine) / count, again / count, math.log1p(len(mine)), math.log1p(len(found))]
        grams = Counter(h % q.WORDS for h in hashes + [finalise((3 * x + y) & MASK) for x, y in zip(hashes, hashes[1:])])
        row += [math.sqrt(grams[k] / max(grams.total(), 1)) for k in range(q.WORDS)]
        runs = Counter((((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16) % q.RUNS for i in range(a, min(b, len(data) - 2)))
        bag.append(row + [math.sqrt(runs[k] / max(runs.total(), 1)) for k in range(q.RUNS)])
    return bag


def plain_score(net: q.Network, bag: list[list[float]]) -> float:
    """Gated attention over a bag with plain sums."""
    p = {k: v.tolist() for k, v in net.p.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    hs = []
    for x in bag:
        x = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale, strict=True)]
        hs.append([max(dot(w, x) + b, 0) for w, b in zip(p["w"], p["b"], strict=True)])
    e = [math.exp(sum(a * math.tanh(dot(v, h)) * sigmoid(dot(u, h)) for a, v, u in zip(p["a"], p["v"], p["u"], strict=True))) for h in hs]
    z = [sum(w * h[i] for w, h in zip(e, hs, strict=True)) / sum(e) for i in range(q.HIDDEN)]
    return sigmoid(dot(z, p["c"]) + p["d"][0])


def test_gradient():
    r = np.random.default_rng(0)
    x, starts, y = r.normal(size=(12, q.FEATURES)), np.array([0, 1, 5, 9]), np.array([0.0, 1, 1, 0])
    net = q.Network(np.zeros(q.FEATURES), np.ones(q.FEATURES))
    score = lambda: net.score(net.vectors(x), starts)
    loss = lambda: -np.mean(y * np.log(score()) + (1 - y) * np.log(1 - score()))
    for k, g in net.gradient(x, starts, y).items():
        flat, i = net.p[k].reshape(-1), int(np.abs(g).argmax())
        flat[i] += 1e-5
        up = loss()
        flat[i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g.reshape(-1)[i]) < 1e-5, k
        flat[i] += 1e-5


def test_attention_finds_the_bad_passage():
    r = np.random.default_rng(1)
    bags = [r.normal(size=(6, q.FEATURES)) for _ in range(300)]
    y = (np.arange(300) % 2).astype(float)
    for b, label in zip(bags, y, strict=True):
        b[2, 0] = 4 if label else -4
    x, starts = np.concatenate(bags), np.arange(0, 1800, 6)
    net = q.Network(*q.moments(x)).fit(x, starts, y)
    h = net.vectors(x)
    assert ((net.score(h, starts) > 0.5) == y).mean() > 0.97
    assert net.weights(h, starts).reshape(-1, 6)[:, 2].mean() > 0.4


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in q.op6_attention_quality(spark, SMALL.replace("0.001", "0.01")).collect()}
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    held = [x for x in labels if got[x.doc_id].held_out]
    assert len(held) > 80 and np.mean([got[x.doc_id].predicted == x.quality for x in held]) > 0.95


def test_passages_of_pieces(monkeypatch):
    texts = pa.array(["", "a b", "w " * 200, "", "É ### x" * 30, " lead", "x"])
    whole = passages(texts)
    monkeypatch.setattr(text_bytes, "CHUNK", 1)
    monkeypatch.setattr(q, "BLOCK", 2)
    assert all(np.allclose(a, b) for a, b in zip(whole, passages(texts), strict=True))
    assert [len(x) for x in whole] == [1, 1, 4, 1, 1, 1, 1]


TEXTS = ["", " \n", "One two, ONE 2!", "Élan né à côté\n" * 40, "x", "ab", "#$% the the the " * 50, " ".join(f"word{i % 90}" for i in range(130))]


def test_encoder_against_plain_loops():
    for got, text in zip(passages(pa.array(TEXTS)), TEXTS, strict=True):
        assert np.allclose(got, plain_bag(text), atol=1e-5), text


def test_query_against_plain_loops(spark, tmp_path):
    """The registered query's scores, from its own fitted network, by plain loops."""
    texts = TEXTS * 6
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(len(t) > 20), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.score for r in q.op6_attention_quality(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = q.fit(docs, labels)
    for i, text in enumerate(TEXTS):
        assert abs(got[i] - plain_score(net, plain_bag(text))) < 1e-3, text


def test_content_decides(spark):
    """Words of one length and alphabet: only which words occur tells the labels apart."""
    r = np.random.default_rng(3)
    good, bad, common = (["".join(r.choice(list("abcdefgh"), 5)) for _ in range(30)] for _ in range(3))
    texts = [" ".join([*r.choice(common, 90), *r.choice(good if i % 2 else bad, 20)]) for i in range(400)]
    docs = documents(spark, texts)
    net = q.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int"))
    found = q.score(docs, net).filter(q.held_out(q.F.col("doc_id"))).collect()
    assert len(found) > 80 and np.mean([(x.score >= 0.5) == x.doc_id % 2 for x in found]) > 0.9


def test_sample_is_bounded(spark):
    docs = documents(spark, ["é" * 500] * 60 + ["y" * 50_000])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(61)], "doc_id long, quality int, toxic int")
    usable = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert q._sample(docs, labels, 10, 1 << 20).count() == 10
    assert q._sample(docs, labels, 1000, 10_000).count() == 10
    assert q._sample(docs, labels, 1000, 1 << 24).filter("doc_id < 60").count() == usable


def test_odd_rows(spark):
    df, none = odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.fit(df, none) == 0.5 and {r.score for r in q.score(df, 0.5).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (5, None, 0), (99, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(df, labels)
    assert q.score(df, model).count() == 12 and q.score(empty(spark), model).count() == 0
    assert q.fit(documents(spark, ["a"] * 30), labels.filter("quality = 1")) == 1.0
