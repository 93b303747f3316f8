"""Nothing from a day on enters what that day may know: patient vectors, filled readings, histories in blocks."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from visitcast.operators import embedding, environment, forecast, panel
from visitcast.sources import scratch

DAY0 = date(2020, 1, 1)
VISIT = "patient_id string, visit_date date, disease string, district string, gender string, age int"


def day(i: int) -> date:
    return DAY0 + timedelta(i)


def _visits(seed: int, n: int = 400):
    r = random.Random(seed)
    return [(r.choice([None, *"pqrstu"]), day(r.randint(0, 40)), r.choice([None, *"abcdefg"]), r.choice("xy"), "M", 30) for _ in range(n)]


CODES = {c: [float(i), float(i * i)] for i, c in enumerate("abcdef")}  # g has no vector


def _as_of(visits, p, t):
    """Mean over the codes that the patient had before t."""
    seen = {v[2] for v in visits if v[0] == p and v[1] < t and v[2] in CODES}
    return None if p is None or not seen else [sum(CODES[c][i] for c in seen) / len(seen) for i in (0, 1)]


def _vectors(spark, visits, start=None):
    df = spark.createDataFrame(visits, VISIT).repartition(3)
    codes = spark.createDataFrame(list(CODES.items()), "disease string, vector array<double>")
    return df, embedding.vectors_as_of(df, embedding.patient_history(df, codes, 2), start)


def test_vectors_are_those_of_the_days_before(spark):
    visits = _visits(1)
    got = {(r.patient_id, r.visit_date): r.vector for r in _vectors(spark, visits)[1].collect()}
    assert set(got) == {(v[0], v[1]) for v in visits if v[0]}
    for (p, t), v in got.items():
        want = _as_of(visits, p, t)
        assert (v is None) == (want is None) and (v is None or max(abs(x - y) for x, y in zip(v, want, strict=True)) < 1e-9)


def test_later_visits_change_nothing(spark):
    """Other visits from day t on, other vectors after t only."""
    r = random.Random(2)
    for t in (day(5), day(20), day(39)):
        visits = _visits(3)
        other = [v if v[1] < t else (v[0], v[1], r.choice("abcdef"), *v[3:]) for v in visits]
        other += [(r.choice("pqrstu"), t + timedelta(r.randint(0, 5)), r.choice("abcdef"), "x", "F", 1) for _ in range(50)]
        a, b = ({(x.patient_id, x.visit_date): x.vector for x in _vectors(spark, v)[1].filter(F.col("visit_date") <= F.lit(t)).collect()} for v in (visits, other))
        assert all(a[k] == b[k] for k in a) and set(a) <= set(b)


def test_patients_without_history_stay(spark):
    visits = _visits(4)
    df, vectors = _vectors(spark, visits)
    got = {(r.date, r.district, r.disease): r for r in embedding.embedding_features(df, vectors, 2).collect()}
    assert set(got) == {(v[1], v[3], v[2]) for v in visits}
    for (d, place, disease), row in got.items():
        known = [x for v in visits if v[1:4] == (d, disease, place) and (x := _as_of(visits, v[0], d)) is not None]
        assert row.embedded == len(known) and (row.embedding is None) == (not known)
        assert not known or abs(row.embedding[1] - sum(x[1] for x in known) / len(known)) < 1e-9
    late = embedding.vectors_as_of(df, embedding.patient_history(df, spark.createDataFrame(list(CODES.items()), "disease string, vector array<double>"), 2), day(30)).collect()
    assert all(r.vector is None for r in late if r.visit_date < day(30)) and any(r.vector for r in late)
    assert embedding.embedding_features(df.limit(0), vectors, 2).count() == 0


def _series(seed: int):
    r = random.Random(seed)
    return [(d, k, t, float(r.randint(0, 50))) for d in "xy" for k in "ab" for t in range(24 * 12) if r.random() < 0.3]


READ = "district string, indicator string, t int, value double"


def _filled(spark, rows):
    keys = ["district", "indicator"]
    return environment.fill_lagrange(environment.complete_grid(spark.createDataFrame(rows, READ), keys, "t"), keys, "t", "value")


def test_known_at_is_the_last_node(spark):
    rows = _series(5)
    at = {}
    for d, k, t, _ in rows:
        at.setdefault((d, k), []).append(t)
    for r in _filled(spark, rows).collect():
        nodes = at[r.district, r.indicator]
        after = sorted(x for x in nodes if x > r.t)
        if r.value is not None:
            assert (r.filled, r.known_at) == (r.value, r.t)
        elif r.filled is not None:
            assert r.known_at == after[min(1, len(after) - 1)] > r.t
        else:
            assert r.known_at is None


def test_later_readings_change_no_feature(spark):
    """Features that serve a target day are the same whatever is read from that day on."""
    rows, r = _series(6), random.Random(7)
    for target in (3, 6, 10):
        other = [x if x[2] < 24 * target else (*x[:3], float(r.randint(0, 50))) for x in rows]
        other = [x for x in other if x[2] < 24 * target or r.random() < 0.6]
        seen = []
        for data in (rows, other):
            known = environment.features_as_of(_filled(spark, data))
            served = known.filter(F.col("day") + F.col("lag") <= target)
            assert served.filter(F.col("known_at") >= 24 * (F.col("day") + F.col("lag"))).count() == 0
            seen.append({(x.district, x.indicator, x.day, x.lag): tuple(x) for x in served.collect()})
        # A gap at the end of what was read so far may become an inner one, but is not known by then either.
        assert seen[0] == seen[1]


def test_features_as_of_by_hand(spark):
    """A gap on day 0 that day 2 fills is missing at lags 1 and 2, there from lag 3 on."""
    rows = [("x", "a", 20, 1.0), ("x", "a", 22, 3.0), ("x", "a", 50, 5.0), ("x", "a", 51, 5.0)]
    got = {(r.day, r.lag): r for r in environment.features_as_of(_filled(spark, rows)).collect()}
    assert [got[0, i].n for i in range(1, 5)] == [2, 2, 4, 4]
    assert got[0, 1].x_mean == 2.0 and got[0, 1].known_at == 22 and got[0, 3].known_at == 51
    assert [got[1, i].n for i in (1, 2)] == [0, 24] and got[1, 1].x_mean is None
    wide = {r.target: r for r in environment.history_as_of(environment.features_as_of(_filled(spark, rows)), ["a"]).collect()}
    assert wide[1].a_mean_lag1 == 2.0 and wide[1].a_mean_lag2 is None and wide[2].a_mean_lag2 == 2.0 and wide[3].a_mean_lag2 == got[1, 2].x_mean


@pytest.mark.parametrize("block", [7, 10, 1000])
def test_history_in_blocks(spark, block):
    r = random.Random(8)
    values = {(d, k): r.randint(0, 99) for d in range(-30, 90) for k in ("a", "b")}
    df = spark.createDataFrame([(day(d), k, "z", v) for (d, k), v in values.items()], "date date, district string, disease string, n int")
    got = panel.add_history(df, ["n"], block=block)
    assert got.count() == len(values)
    for row in got.collect():
        d = (row.date - DAY0).days
        assert [row[f"n_lag{i}"] for i in range(1, 8)] == [values.get((d - i, row.district)) for i in range(1, 8)]
    with pytest.raises(ValueError):
        panel.add_history(df, ["n"], days=8, block=7)


def test_one_series_in_many_tasks(spark):
    """Blocks, not series, bound the tasks of histories and of running counts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("date"), F.lit("a").alias("district"), F.lit("z").alias("disease"), F.col("id").alias("n"))
        used = panel.add_history(df, ["n"]).groupBy(F.spark_partition_id()).count().count()
        assert used == 4  # all shuffle partitions of the tests' session
        series = spark.range(20_000).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 3 == 0, 1.0).alias("v"))
        counted = environment.running_count(series, ["k"], "t", "v", block=512)
        assert counted.groupBy(F.spark_partition_id()).count().count() == 4
        assert counted.filter(F.col("_n") != F.floor(F.col("t") / 3) + 1).count() == 0 and counted.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_fill_alike(spark):
    rows = _series(9)
    df = spark.createDataFrame(rows, READ)
    keys = ["district", "indicator"]
    grid = environment.complete_grid(df, keys, "t")
    one, many = ({(r.district, r.indicator, r.t): (r.filled, r.known_at) for r in environment.fill_lagrange(grid, keys, "t", "value", block=b).collect()} for b in (10**6, 5))
    assert one == many
    odd = environment.fill_lagrange(spark.createDataFrame([(None, "a", 1, 2.0), (None, "a", 2, None)], READ), keys, "t", "value")
    assert sorted((r.t, r.filled) for r in odd.collect()) == [(1, 2.0), (2, None)]


def test_forest_fills_missing_values(spark):
    df = spark.createDataFrame([(float(i % 5), None if i % 3 else 1.0, None, float(i % 5)) for i in range(60)], "a double, b double, c double, target double")
    forest = forecast.fit_forest(df, ["a", "b", "c"], trees=5)
    assert forest.means == [2.0, 1.0, 0.0]
    got = forecast.predict(forest, df)
    assert got.columns == [*df.columns, "predicted"] and got.filter("predicted IS NULL").count() == 0 and got.filter("b IS NULL").count() == 40
    assert forecast.importances(forest).first().feature == "a"
    with pytest.raises(ValueError):
        forecast.predict(forest, df, ["a"])


def test_made_once(spark):
    made = []

    def make():
        made.append(1)
        return {"numbers": spark.range(5)}

    for _ in range(2):
        assert scratch.once(spark, "test numbers", make)["numbers"].count() == 5
    assert len(made) == 1
    scratch.forget(spark)
    scratch.once(spark, "test numbers", make)
    assert len(made) == 2
