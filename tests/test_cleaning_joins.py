"""Similar codes, blocks and districts against brute force, and how much work their joins leave."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from visitcast.operators import address, icd

RING = "district string, ring array<struct<x:double,y:double>>"


def _sets(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(max(len(text) - 1, 1))}


def _dice(a: str, b: str) -> float:
    x, y = _sets(a), _sets(b)
    return 2 * len(x & y) / (len(x) + len(y))


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _texts(r: random.Random, n: int, alphabet: str) -> list[str]:
    """Names that mostly begin alike, so that some grams are in nearly all of them."""
    return [r.choice(["chronic ", "acute ", "chronic ", ""]) + "".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("score", [0.2, 0.5, 0.8, 0.9, 1.0])
def test_similar_is_exact(spark, score):
    r = random.Random(int(10 * score))
    names = [(f"C{i:03}", t) for i, t in enumerate(_texts(r, 60, "abcde"))]
    dirty = _texts(r, 80, "abcde") + [n[: i % 5] + n[i % 5 + 1 :] for i, (_, n) in enumerate(names)] + ["", "a", None]
    lib = spark.createDataFrame(names + names[:5] + [("C999", None)], "code string, name string")
    got = {x.raw: (x.code, round(x.score, 9)) for x in icd.match_similar(spark.createDataFrame([(t,) for t in dirty + dirty[:9]], "raw string"), lib, min_score=score).collect()}
    want = {}
    for t in set(dirty) - {None}:
        best = min(((-_dice(t, n), _distance(t, n), c) for c, n in names if _sets(t) & _sets(n) and _dice(t, n) >= score), default=None)
        if best:
            want[t] = (best[2], round(-best[0], 9))
    assert got == want


def test_similar_joins_rare_grams(spark):
    """Where every name holds the same frequent grams, candidates stay far below the pairs that share a gram."""
    r = random.Random(3)
    names = [(f"C{i:03}", "malignant neoplasm of " + "".join(r.choices("bcdfghjklmnpqrstvwxz", k=12))) for i in range(200)]
    dirty = [n[:-1] for _, n in names]
    lib, df = spark.createDataFrame(names, "code string, name string"), spark.createDataFrame([(t,) for t in dirty], "raw string")
    pairs = icd.similar_candidates(df, lib, min_score=0.8).count()
    assert sum(bool(_sets(t) & _sets(n)) for t in dirty for _, n in names) == 40_000 and 200 <= pairs < 6_000
    assert {x.raw: x.code for x in icd.match_similar(df, lib, min_score=0.8).collect()} == {n[:-1]: c for c, n in names}
    with pytest.raises(ValueError):
        icd.match_similar(df, lib, min_score=0)


def test_similar_of_nothing(spark):
    lib, df = spark.createDataFrame([], "code string, name string"), spark.createDataFrame([("a",)], "raw string")
    assert icd.match_similar(df, lib).count() == 0 and icd.match_similar(df.limit(0), lib).count() == 0


BLOCKS = [("I20_I25", "I20", "I25"), ("I2x", "I20", "I29"), ("A_B", "A00", "B99"), ("one", "E11", "E11"), ("wide", "A", "J9"), ("up", "I25", "I20"), ("none", None, "Z"), ("far", "Y9", "Zé")]


def test_blocks_are_ranges(spark):
    r = random.Random(4)
    codes = ["".join([r.choice("ABEIJYZ"), *r.choices("0123459X", k=r.randint(0, 4))]) for _ in range(300)] + ["I20", "I25.9", "E11", "", "é12", "Zè", None]
    df = spark.createDataFrame([(i, c, "old") for i, c in enumerate(codes)], "id int, code string, block string")
    blocks = spark.createDataFrame(BLOCKS, "block string, lo string, hi string")
    want = []
    for i, c in enumerate(codes):
        held = [b for b, lo, hi in BLOCKS if c is not None and lo is not None and lo.encode() <= c[:3].encode() <= hi.encode()]
        want += [(i, b) for b in held or [None]]
    got = icd.to_block(df, blocks)
    assert sorted(((x.id, x.block) for x in got.collect()), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def _ring(r: random.Random, x: float, y: float, radius: float, n: int) -> list[tuple[float, float]]:
    """A star-shaped ring, concave as a rule."""
    return [(x + radius * r.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + radius * r.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def _holds(ring, x: float, y: float) -> bool:
    hit = 0
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit += 1
    return hit % 2 == 1


@pytest.mark.parametrize("depth", [0, 2, 6])
def test_districts_are_those_of_ray_casting(spark, depth):
    r = random.Random(5)
    rings = {f"d{i}": _ring(r, r.uniform(-3, 3), r.uniform(-3, 3), r.choice([0.01, 0.3, 2]), r.choice([3, 7, 60])) for i in range(12)}
    rings |= {"square": [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], "next": [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)], "line": [(0.0, 0.0), (1.0, 1.0)], "tiny": [(5.0, 5.0), (5.0 + 1e-9, 5.0), (5.0, 5.0 + 1e-9)]}
    points = [(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(400)] + [(x / 4, y / 4) for x in range(-8, 12) for y in range(-8, 8)] + [p for ring in rings.values() for p in ring[:20]]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([*points, (None, 1.0), (1.0, None), (float("nan"), 0.5), (1e9, 0.0)])], "id int, lon double, lat double")
    got = {p.id: p.district for p in address.district_of(df, spark.createDataFrame(list(rings.items()), RING), depth=depth).collect()}
    want = {i: min((d for d, ring in rings.items() if len(ring) > 2 and _holds(ring, x, y)), default=None) for i, (x, y) in enumerate(points)}
    assert got == want | {len(points) + i: None for i in range(4)}


def test_few_points_are_tested(spark):
    """Of the points in and around a city-sized ring of many corners, few meet a border cell, and there few sides."""
    r = random.Random(6)
    city = [(113.3 + 0.4 * (1 + 0.05 * r.random()) * math.cos(2 * math.pi * i / 2000), 23.1 + 0.3 * (1 + 0.05 * r.random()) * math.sin(2 * math.pi * i / 2000)) for i in range(2000)]
    polygons = spark.createDataFrame([("city", city)], RING)
    df = spark.range(20_000).select(F.rand(1).alias("u"), F.rand(2).alias("v")).select((F.col("u") + 112.8).alias("lon"), (F.col("v") + 22.6).alias("lat"))
    near = address.near_cells(df, polygons)
    tested = near.filter("band IS NOT NULL").agg(F.count("*"), F.avg(F.size("band"))).first()
    inner = near.filter("band IS NULL").count()
    assert inner > 6000 and tested[0] < 2000 and tested[1] < 300
    assert near.groupBy("_px", "_py").count().filter("count > 1").count() == 0


def test_no_polygons(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5)], "id int, lon double, lat double")
    assert address.district_of(df, spark.createDataFrame([], RING)).first().district is None
