"""Small hand-written cases and properties of the visit forecast."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from visitcast.functions import fields
from visitcast.operators import address, embedding, environment, forecast, icd, panel, profile, visits
from visitcast.sources import io


def test_fields(spark):
    df = spark.createDataFrame([("35岁", " 男 ", "2020-01-05"), ("-3", "f", "2020/1/5"), ("abc", "x", "20200105"), (None, None, "junk"), ("121", "2", None)], "age string, gender string, day string")
    got = df.select(fields.tidy_age(F.col("age")).alias("a"), fields.tidy_gender(F.col("gender")).alias("g"), fields.tidy_date(F.col("day")).alias("d")).collect()
    day = date(2020, 1, 5)
    assert [tuple(r) for r in got] == [(35, "M", day), (None, "F", day), (None, None, day), (None, None, None), (None, "F", None)]
    assert spark.range(1).select(fields.normalise_code(F.lit(" ｉ２１．０ "))).first()[0] == "I21.0"


LIBRARY = [("I21", "急性心肌梗死"), ("E11", "2型糖尿病"), ("J45", "支气管哮喘")]


def test_icd(spark):
    lib = spark.createDataFrame(LIBRARY, "code string, name string")
    dirty = spark.createDataFrame([("急性心肌梗塞",), ("糖尿病2型",), ("哮喘",), ("不明",), ("支气管哮喘",), ("i21",), (None,), ("急性心肌梗塞",)], "raw string")
    assert {r.raw: (r.code, round(r.score, 2)) for r in icd.match_similar(dirty, lib).collect()} == {"急性心肌梗塞": ("I21", 0.8), "糖尿病2型": ("E11", 0.75), "支气管哮喘": ("J45", 1.0)}
    assert icd.match_similar(dirty, lib, min_score=0.4).filter("raw = '哮喘'").first().code == "J45"
    found = icd.mapping(dirty, lib)
    assert {r.raw: r.code for r in found.collect()} == {"急性心肌梗塞": "I21", "糖尿病2型": "E11", "支气管哮喘": "J45", "i21": "I21"}
    assert icd.standardise_codes(dirty, found).count() == 8
    assert rows(icd.unmatched(dirty, found)) == [(1, "不明"), (1, "哮喘"), (1, None)]
    blocks = spark.createDataFrame([("I20_I25", "I20", "I25")], "block string, lo string, hi string")
    assert {r.code: r.block for r in icd.to_block(lib, blocks).collect()} == {"I21": "I20_I25", "E11": None, "J45": None}


def test_address(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]
    polygons = spark.createDataFrame([("L", ring), ("R", [(4.0, 0.0), (6.0, 0.0), (6.0, 2.0), (4.0, 2.0)])], "district string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0), (4, 5.0, 1.0), (5, None, 1.0), (6, 1.0, 3.5)], "id int, lon double, lat double")
    assert {r.id: r.district for r in address.district_of(points, polygons).collect()} == {1: "L", 2: None, 3: None, 4: "R", 5: None, 6: "L"}
    edge = spark.createDataFrame([(1, 4.0, 1.0)], "id int, lon double, lat double")
    assert address.district_of(edge, polygons).count() == 1
    df = spark.createDataFrame([(1, "广州市 天河区 1号"), (2, "海珠"), (3, None), (4, "天河区东")], "id int, address string")
    names = spark.createDataFrame([("天河区",), ("天河区东",), ("海珠",)], "district string")
    assert {r.id: r.district for r in address.district_from_text(df, names).collect()} == {1: "天河区", 2: "海珠", 3: None, 4: "天河区东"}
    gazetteer = spark.createDataFrame([("广州市天河区1号", 1.0, 1.0)], "address string, lon double, lat double")
    assert {r.id: r.district for r in address.clean_district(df, gazetteer, polygons, names).collect()} == {1: "L", 2: "海珠", 3: None, 4: "天河区东"}


def test_lagrange_rebuilds_cubics(spark):
    cubic = lambda t: 2 + 3 * t - 0.5 * t**2 + 0.01 * t**3
    gaps = {0, 5, 6, 11, 19}
    series = [("a", t, None if t in gaps else float(cubic(t))) for t in range(20)] + [("b", t, None) for t in range(5)]
    got = {(r.s, r.t): r.filled for r in environment.fill_lagrange(spark.createDataFrame(series, "s string, t int, v double"), ["s"], "t", "v").collect()}
    assert got["a", 0] is None and got["a", 19] is None and all(got["b", t] is None for t in range(5))
    assert all(abs(got["a", t] - cubic(t)) < 1e-6 for t in range(1, 19))
    low = environment.fill_lagrange(spark.createDataFrame([("a", 0, 0.0), ("a", 1, None), ("a", 2, 8.0)], "s string, t int, v double"), ["s"], "t", "v", bounds=(0, 3))
    assert low.filter("t = 1").first().filled == 3.0


def test_grid_of_timestamps(spark):
    df = spark.createDataFrame([("a", datetime(2020, 1, 1, 0), 1.0), ("a", datetime(2020, 1, 1, 3), 2.0)], "s string, ts timestamp, v double")
    assert environment.complete_grid(df, ["s"], "ts", "1 hour").count() == 4


def test_air(spark):
    values = {"a": [1.0], "b": [1.0, 2.0], "c": [1.0, 5.0, 3.0], "d": [1.0, 2.0, 9.0, 9.0]}
    ts = datetime(2020, 1, 1, 5)
    df = spark.createDataFrame([(ts, "x", i, v) for i, vs in values.items() for v in vs], "ts timestamp, district string, indicator string, value double")
    got = {r.indicator: r for r in environment.air_features(df).collect()}
    assert (got["a"].x_mean, got["a"].x_std, got["a"].x_mean_remove) == (1.0, None, None)
    assert got["b"].x_mean_remove is None and (got["c"].x_mean_remove, got["c"].x_std_remove) == (3.0, None)
    assert got["d"].x_mean_remove == 5.5 and abs(got["d"].x_std_remove - 24.5**0.5) < 1e-9 and got["d"].x_multi == [1.0, 2.0, 9.0, 9.0]
    wide = environment.pivot_indicators(environment.air_features(df), ["a", "z"]).first()
    assert wide.a_mean == 1.0 and wide.z_mean is None


VISIT = "patient_id string, visit_date date, gy_bm string, disease string, district string, current_address string, registered_address string, gender string, age int"


def _visits(spark):
    d = date(2020, 1, 1)
    return spark.createDataFrame([
        ("1", d, "g", "I21", "x", "广州市", None, "M", 30), ("1", d, "g", "I21", "x", "广州市", "深圳", "M", 31), ("2", d, "g", "I21", "x", None, "广州", "F", 40),
        ("01", d, "g", "I21", "x", "广州", "广州", "F", 50), (None, d, "g", "E11", "x", "广州", None, None, 60), ("3", d, "g", "E11", "x", "深圳", "北京", "M", 70),
    ], VISIT)


def test_visits(spark):
    df = visits.in_city(_visits(spark), "current_address", "registered_address")
    assert df.count() == 5
    assert visits.in_city(_visits(spark), "current_address", "registered_address", prefix="深").count() == 6
    df = visits.drop_placeholder(df)
    assert df.count() == 4 and df.filter("patient_id IS NULL").count() == 1
    once = visits.dedup_visits(df, ["age"])
    assert rows(once) == rows(visits.dedup_visits(once.repartition(7), ["age"])) and once.count() == 3
    got = {r.disease: r for r in visits.visit_features(once).collect()}
    assert got["I21"].visit_amount == 2 and got["I21"].visit_gender == {"M": 0.5, "F": 0.5} and got["I21"].visit_age_multi == [30, 40]
    assert got["E11"].visit_gender is None and got["E11"].visit_age_std is None
    assert sum(r.visit_amount for r in got.values()) == once.count()
    s = {r.patient_id: r.sentence for r in embedding.patient_sentences(once).collect()}
    assert s == {"1": ["I21"], "2": ["I21"]}
    assert embedding.patient_sentences(once, as_of=date(2020, 1, 1)).count() == 0


def test_word2vec(spark):
    s = spark.createDataFrame([("p", ["a", "b"]), ("q", ["b", "c"])], "patient_id string, sentence array<string>").coalesce(1)
    one, two = (embedding.patient_vectors(embedding.fit_word2vec(s, 4, 3), s).collect() for _ in range(2))
    assert one == two and all(len(r.vector) == 4 for r in one)


def test_word2vec_over_tasks(spark):
    """Fitted in several tasks, codes that occur together still lie closer than codes that never do."""
    import math
    import random

    r = random.Random(4)
    left, right = ([f"{k}{i}" for i in range(6)] for k in "ab")
    s = spark.createDataFrame([(str(i), r.choices(left if i % 2 else right, k=8)) for i in range(2000)], "patient_id string, sentence array<string>")
    model = embedding.fit_word2vec(s, 8, 3, per_task=500)
    assert model.getNumPartitions() == 4
    v = {x.word: x.vector.toArray() for x in model.getVectors().collect()}
    assert sorted(v) == sorted(left + right)
    cosine = lambda a, b: float(v[a] @ v[b] / math.sqrt((v[a] @ v[a]) * (v[b] @ v[b])))
    within = [cosine(a, b) for side in (left, right) for a in side for b in side if a < b]
    across = [cosine(a, b) for a in left for b in right]
    assert min(within) > max(across)


@pytest.mark.parametrize("dense", [True, False])
def test_history(spark, dense):
    start = date(2020, 1, 1)
    r = random.Random(1)
    values = {(d, k): r.randint(0, 9) for d in range(20) for k in ("a", "b")}
    df = spark.createDataFrame([(start + timedelta(d), k, "z", v) for (d, k), v in values.items()], "date date, district string, disease string, n int")
    full = panel.full_history(panel.add_history(df, ["n"], dense=dense), start)
    for row in full.collect():
        d = (row.date - start).days
        assert [row[f"n_lag{i}"] for i in range(1, 8)] == [values[d - i, row.district] for i in range(1, 8)]
    assert full.count() == 26


def test_panel_and_merge(spark):
    base = panel.panel(spark, date(2020, 1, 1), date(2020, 1, 3), spark.createDataFrame([("a",), ("b",), ("a",)], "district string"), spark.createDataFrame([("x",)], "disease string"))
    assert base.count() == 6
    v = spark.createDataFrame([(date(2020, 1, 2), "a", "x", 4, 9.0)], "date date, district string, disease string, visit_amount long, visit_age_mean double")
    got = panel.add_weekday(panel.add_target(panel.fill_counts(panel.merge_features(base, visits=v))))
    assert sorted((r.date.day, r.district, r.target, r.visit_age_mean, r.weekday) for r in got.collect())[2:4] == [(2, "a", 4, 9.0, 3), (2, "b", 0, None, 3)]


def test_forecast_parts(spark):
    df = spark.createDataFrame([(date(2020, 1, d), "a", float(d), [1.0, 20.0, 70.0] if d % 2 else None) for d in range(1, 11)], "date date, district string, target double, x_multi array<double>")
    assert forecast.vectorise_multi(df, "x_multi", [0, 18, 65]).first().x_multi_counts == [1, 1]
    assert "x_multi" not in forecast.drop_multi(df).columns
    train, test = forecast.split_by_date(df, date(2020, 1, 8))
    assert (train.count(), test.count()) == (7, 3)
    from pyspark.ml.evaluation import RegressionEvaluator

    pred = df.withColumn("predicted", F.col("target") + F.when(F.col("target") > 5, 1.0).otherwise(-0.5))
    want = RegressionEvaluator(labelCol="target", predictionCol="predicted", metricName="r2").evaluate(pred)
    assert abs(forecast.r2(pred).first().r2 - want) < 1e-9 and abs(forecast.r2(pred, by=["district"]).first().r2 - want) < 1e-9
    assert forecast.r2(pred.limit(1)).first().r2 is None
    assert forecast.cross_features(df, ["district", "target"]).first().crossed.size == 4096
    codes = forecast.encode_categories(train, ["district"]).transform(test.withColumn("district", F.lit("new")))
    assert codes.first().district_index == 1.0


def test_forest_finds_the_weekly_pattern(spark):
    r = random.Random(3)
    start = date(2020, 1, 1)
    df = spark.createDataFrame([(start + timedelta(d), k, "x", 10 * ((start + timedelta(d)).weekday() < 5) + r.randint(0, 2)) for d in range(90) for k in "abcd"], "date date, district string, disease string, visit_amount int")
    full = panel.full_history(panel.add_weekday(panel.add_target(panel.add_history(df, ["visit_amount"]))), start)
    features = [*[f"visit_amount_lag{i}" for i in range(1, 8)], "weekday"]
    model = forecast.fit_forest(full, features)
    assert forecast.importances(model, features).first().feature in ("weekday", "visit_amount_lag7")
    pred = forecast.predict(model, full, features).withColumn("block", F.lit("B"))
    assert forecast.r2(pred).first().r2 > 0.9
    assert forecast.curve(pred, "B", "a").count() == 83


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b")], "x double, k string")
    assert profile.profile(df, ["x"]).first() == Row(column="x", n=3, nulls=1, n_distinct=2, min=1.0, max=3.0, mean=2.0, std=2**0.5)
    assert [tuple(r) for r in profile.frequencies(df, "k", 1).collect()] == [("b", 2)]


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 1, 5), 1), (date(2020, 2, 5), 2)], "date date, n int")
    io.save_clean(df, f"{tmp_path}/c")
    assert rows(io.load_clean(spark, f"{tmp_path}/c", df.schema)) == rows(df)
    io.save_wide(df, f"{tmp_path}/w")
    assert sorted(p.name for p in (tmp_path / "w").glob("month=*")) == ["month=2020-01", "month=2020-02"]
    io.save_curve(df, f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k").count() == 2


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("CAST(id AS INT) AS id", "id * 2 AS v").write.format("jdbc").options(url=url, dbtable="T", driver=driver).save()
    got = io.read_table(spark, url, "T", ('"id"', 0, 100, 4), driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100
