"""Best-fit-decreasing sharding against a plain best fit, and by its law."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from conftest import SMALL
from helpers import documents, empty, odd, words

from visitcast.llm import sharding


def plain_best_fit(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(bins)) if bins[b] >= sizes[i]]
        if sizes[i] > capacity or not fits:
            bins.append(max(0, capacity - sizes[i]))
            out[i] = len(bins) - 1
        else:
            b = min(fits, key=lambda b: (bins[b], b))
            bins[b] -= sizes[i]
            out[i] = b
    return out


def _runs(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def _loads(runs, placed):
    load = defaultdict(int)
    for (size, number), parts in zip(runs, placed, strict=True):
        assert sum(n for _, n in parts) == number
        for b, n in parts:
            load[b] += size * n
    return sorted(load.values())


def test_runs_are_best_fit():
    """Whole runs at a time fill the bins as one group after the other does."""
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randint(1, r.choice([5, 100, 350])) for _ in range(r.randint(1, 900))]
        capacity, runs = r.randint(100, 300), _runs(sizes)
        theirs = plain_best_fit(sizes, capacity)
        fill = sorted(sum(s for s, b in zip(sizes, theirs, strict=True) if b == k) for k in set(theirs))
        assert _loads(runs, sharding.best_fit_decreasing(runs, capacity)) == fill


def test_pack_is_near_equal():
    r = random.Random(2)
    sizes = [r.randint(1, 1000) for _ in range(5000)] + [400_000]
    load = _loads(_runs(sizes), sharding.pack(_runs(sizes), 24))
    assert load[-1] == 400_000 and load[-2] - load[0] <= 0.01 * load[-2] and len(load) == 24
    assert sharding.pack([], 24) == [] and len(_loads([(5, 2)], sharding.pack([(5, 2)], 24))) == 2 and sharding.pack([(7, 1)], 1) == [[(0, 1)]]


def _plain_pack(sizes, shards):
    """Loads of plain best fit decreasing over open bins, at the capacity that the same bisection finds."""

    def loads(capacity):
        left = [capacity] * shards
        for s in sorted(sizes, reverse=True):
            b = min((b for b in range(shards) if left[b] >= s), key=lambda b: (left[b], b), default=None)
            if b is None:
                return None
            left[b] -= s
        return sorted(capacity - x for x in left)

    low = max(-(-sum(sizes) // shards), max(sizes))
    high = -(-sum(sizes) // shards) + max(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if loads(middle) is None else (low, middle)
    return loads(high)


def test_query_packs_every_group(spark, tmp_path):
    """10,000 texts of a few hundred lengths, some in several copies: the loads of plain best fit over all groups."""
    r = random.Random(5)
    texts = [f"{i} " + "x" * r.choice([r.randint(0, 300), 40, 41, r.randint(0, 4000)]) for i in range(10_000)]
    texts += [texts[r.randrange(200)] for _ in range(500)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op4_best_fit_sharding(spark, str(tmp_path)).collect()
    assert sorted(_law(got, 24).values()) == _plain_pack([(len(t) + 8) * n for t, n in Counter(texts).items()], 24)


def _law(got, shards):
    load, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) <= set(range(shards)) and all(len(s) == 1 for s in of.values())
    return load


def test_law(spark, monkeypatch):
    r = random.Random(3)
    texts = [words(r, r.randint(1, 60)) for _ in range(400)] + ["the same text"] * 90 + ["né 控"]
    df = documents(spark, texts)
    for part in (7, 50_000):
        monkeypatch.setattr(sharding, "PART", part)
        got = sharding.shard(df, shards=8).collect()
        load = _law(got, 8)
        assert len(got) == len(texts) and len(load) == 8 and max(load.values()) - min(load.values()) <= 0.03 * max(load.values())
        assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    few = sharding.shard(df, capacity=5000).collect()
    load = _law(few, 100)
    assert max(load.values()) <= 5000 and len(load) <= -(-sum(load.values()) // 5000) + 1


def test_query(spark):
    got = sharding.op4_best_fit_sharding(spark, SMALL).collect()
    load = _law(got, 24)
    assert len(got) == 200 and {r.law for r in got} == {"bytes"} and max(load.values()) <= 1.3 * sum(load.values()) / 24 + max(r.size for r in got)


def test_odd_rows(spark):
    got = sharding.shard(odd(spark), shards=3).collect()
    _law(got, 3)
    assert len(got) == 12 and sorted(r.size for r in got)[:3] == [8, 8, 8]
    assert sharding.shard(empty(spark), shards=3).count() == 0
