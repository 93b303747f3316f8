"""Mergeable sketches and sparse model inputs."""

from __future__ import annotations

import random
from datetime import date, timedelta

from conftest import SMALL
from pyspark.sql import functions as F

from visitcast.operators import forecast, profile
from visitcast.plans import queries as jobs


def test_merged_profile_is_that_of_all_rows(spark):
    r = random.Random(1)
    data = [(r.choice("pqr"), None if r.random() < 0.1 else 1e9 + r.random(), r.randint(0, 4000) if i < 9000 else 7) for i in range(10_000)] + [("empty", None, 1)]
    df = spark.createDataFrame(data, "part string, x double, k long").repartition(5)
    stored = profile.sketches(df, ["x", "k"], F.col("part"))
    got = {row.column: row for row in profile.merged_profile(stored).collect()}
    for want in profile.profile(df, ["x", "k"], exact=True).collect():
        row = got[want.column]
        assert (row.n, row.nulls, row.min, row.max) == (want.n, want.nulls, want.min, want.max)
        assert abs(row.mean - want.mean) < 1e-9 * abs(want.mean) and abs(row.std - want.std) < 1e-6 * want.std
        assert abs(row.n_distinct - want.n_distinct) < 4 * 0.0163 * want.n_distinct
    top = profile.merged_frequencies(stored, 1).filter("column = 'k'").first()
    exact = df.filter("k = 7").count()
    assert top.value == 7.0 and exact - len(data) / 750 <= top.n <= exact + len(data) / 750


def test_parts_are_replaced_alone(spark):
    """A changed part is made anew; the others' sketches are kept."""
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "part string, x double")
    old = profile.sketches(df, ["x"], F.col("part"))
    new = profile.sketches(spark.createDataFrame([("b", 9.0), ("b", None)], "part string, x double"), ["x"], F.col("part"))
    row = profile.merged_profile(old.filter("part != 'b'").unionByName(new)).first()
    assert (row.n, row.nulls, row.n_distinct, row.min, row.max, row.mean) == (4, 1, 3, 1.0, 9.0, 4.0)
    nothing = profile.merged_profile(profile.sketches(df.withColumn("x", F.lit(None).cast("double")), ["x"], F.col("part"))).first()
    assert (nothing.n, nothing.nulls, nothing.n_distinct, nothing.mean, nothing.std) == (3, 3, 0, None, None)
    assert profile.merged_profile(old.limit(0)).count() == 0


def _rows(spark, seed=2):
    """Targets that depend on a cross of categories and on how many old people came the day before."""
    r = random.Random(seed)
    data = []
    for d in range(120):
        for place in "ab":
            for kind in "xyz":
                ages = [float(r.randint(0, 100)) for _ in range(r.randint(0, 6))]
                y = 5.0 * ((place, kind) in {("a", "x"), ("b", "y")}) + 2.0 * sum(a >= 65 for a in ages) + r.random()
                data.append((date(2020, 1, 1) + timedelta(d), place, kind, float(d % 7), ages or None, y))
    return spark.createDataFrame(data, "date date, district string, disease string, lag double, ages array<double>, target double")


def test_sparse_inputs(spark):
    df = _rows(spark)
    train, test = forecast.split_by_date(df, date(2020, 4, 1))
    scores = {}
    for name, crosses, multi in (("plain", [], {}), ("crossed", [["district", "disease"]], {}), ("all", [["district", "disease"]], {"ages": [0.0, 18.0, 65.0, 121.0]})):
        inputs = forecast.SparseInputs(["lag"], ["district", "disease"], crosses, multi).fitted(train)
        model = forecast.fit_linear(train, inputs, penalty=0.01)
        pred = forecast.predict_linear(model, inputs, test)
        assert pred.columns == [*df.columns, "predicted"] and pred.filter("predicted IS NULL").count() == 0
        scores[name] = forecast.r2(pred).first().r2
    assert scores["plain"] + 0.1 < scores["crossed"] < scores["all"] - 0.1 and scores["all"] > 0.9
    unseen = forecast.predict_linear(model, inputs, test.limit(3).withColumn("disease", F.lit("new")).withColumn("lag", F.lit(None).cast("double")))
    assert unseen.filter("predicted IS NULL").count() == 0
    vector = inputs.assembled(test).first().features
    assert vector.__class__.__name__ == "SparseVector" and vector.size == 1 + 3 + 4 + 4096 + 3


def test_comparison(spark):
    got = {(r.model, r.multi): (r.n, r.r2) for r in jobs.QUERIES["multi_comparison"](spark, SMALL).collect()}
    assert set(got) == {(m, w) for m in ("linear", "forest") for w in ("with", "without")}
    assert len({n for n, _ in got.values()}) == 1 and all(s is not None and s <= 1 for _, s in got.values())
