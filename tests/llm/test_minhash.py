"""MinHash near-dedup against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, duck_rows, rows
from helpers import documents, empty, odd, words

from visitcast.llm import minhash


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def brute(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family(seed):
    """Copies, near copies in chains and large families around and below the threshold, and strangers."""
    r = random.Random(seed)
    out = [words(r, 60) for _ in range(20)] + ["a b", "A B", "a b c", "x"]
    for size, edits in ((120, (0, 9)), (60, (2, 4)), (30, (0, 2))):
        base = words(r, 120).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(*edits)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 9999)}"
            out.append(" ".join(w))
    out += out[-5:]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 16), (5, 80, 512)])
def test_equal_to_brute_force(spark, width, percent, block):
    texts = family(width)
    got = minhash.components(documents(spark, texts), width, percent, block=block, broadcast_rows=0 if block == 16 else 1000)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(texts, width, percent)


def test_equal_to_sql(spark, duck):
    assert rows(minhash.op1_minhash_near_dedup(spark, SMALL)) == duck_rows(duck, minhash.ORACLE_SQL)


def test_odd_rows(spark):
    got = minhash.components(odd(spark), 3, 85)
    by = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert got.count() == 12
    assert by[1, 0].component_id == 1 and by[2, 0].kept and by[3, 0].component_id == 3 and by[4, 1].kept
    assert by[None, 3].component_id is None and by[None, 3].kept
    kept = minhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8, 9] and ids.count(None) == 2
    assert minhash.components(empty(spark)).count() == 0 and minhash.keep_one(empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    texts = family(9)
    want = {c for _, _, c in brute(texts, 5, 80)}
    assert {r.doc_id for r in minhash.keep_one(documents(spark, texts)).collect()} == want


def test_estimate_follows_similarity():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        est = []
        for _ in range(40):
            both, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
            x, y = minhash.registers([np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))])
            est.append(minhash.estimate(np.array([(x == y).sum()]), np.array([1000]), np.array([1000]))[0][0])
        assert abs(np.mean(est) - share) < 0.03


def test_shingles_of_pieces(monkeypatch):
    """The same sets whether texts are hashed together or one by one."""
    from visitcast.llm import text_bytes

    texts = ["", "a", "a b c", " x\ty\nz\x0bw ", "É é A", "a b c", "q" * 50 + " r s t"]
    whole = [s.tolist() for s in minhash.shingle_sets(pa.array(texts), 3)]
    monkeypatch.setattr(text_bytes, "CHUNK", 1)
    assert whole == [s.tolist() for s in minhash.shingle_sets(pa.array(texts), 3)]
    assert [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts] and whole[2] == whole[5]


def test_common():
    r = np.random.default_rng(2)
    x, y = ([np.unique(r.integers(0, 300, n)).astype(np.uint64) for n in (1, 40, 200)] for _ in range(2))
    assert minhash._common(x, y).tolist() == [[len(set(a) & set(b)) for b in y] for a in x]
    twice = minhash._common(x, x)
    assert all(twice[i, j] == len(set(x[i]) & set(x[j])) for i in range(3) for j in range(3) if i != j)


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    """Stars cut into blocks of few members and few shingles give the components of uncut ones."""
    r = random.Random(21)
    base = [words(r, 120).split() for _ in range(3)]
    texts = []
    for k in range(60):
        w = list(base[k % 3])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        texts.append(" ".join(w))
    df = documents(spark, texts)
    whole = {x.doc_id: x.component_id for x in minhash.components(df, 3, 85).collect()}
    monkeypatch.setattr(minhash, "SHINGLES", 600)
    assert {x.doc_id: x.component_id for x in minhash.components(df, 3, 85, block=7, broadcast_rows=0).collect()} == whole
    assert 3 <= len(set(whole.values())) < 60
