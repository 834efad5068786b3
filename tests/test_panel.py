"""Fills, calendars, encoders, scales, splits and pipelines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import calendar, encode, fills, metrics, scale, splits
from chronoloom.operators.frame import nan_to_null
from chronoloom.plans.pipeline import Pipeline, PipelineModel, permutation_importance, score


@pytest.fixture(scope="module")
def week(spark):
    days = [dt.datetime(2021, 5, 1) + dt.timedelta(days=i) for i in range(7)]
    rows = [(d, i, float(k)) for k, (i, d) in enumerate((i, d) for i in (0, 1) for d in days)]
    return spark.createDataFrame(rows, "date timestamp_ntz, id int, f double")


def without(df, places):
    return df.where(~F.col("f").isin([float(p) for p in places]))


def test_missing_timestamps(week):
    some = without(week, [0, 1, 3, 8, 11, 13])
    by_id = calendar.add_missing_timestamps(some, "date", "D", "id").orderBy("id", "date").collect()
    assert len(by_id) == 11 and [i for i, r in enumerate(by_id) if r["f"] is None] == [1, 6, 9]
    assert calendar.add_missing_timestamps(some, "date", "D", "id", range_by_group=False).count() == 14
    with pytest.raises(ValueError):
        calendar.add_missing_timestamps(some.unionByName(some.limit(1)), "date", "D", "id")


def test_gaps(week):
    df = week.withColumn("f", F.when(~F.col("f").isin(1.0, 3.0, 4.0, 8.0, 9.0, 11.0), F.col("f")))
    out = fills.gaps(df, "f", "date", "id").orderBy("id", "date").collect()
    assert [r["f_dt_fwd"] for r in out] == [1, 1, 2, 1, 2, 3, 1, 1, 1, 2, 3, 1, 2, 1]
    assert [r["f_dt_bwd"] for r in out] == [2, 1, 3, 2, 1, 1, 1, 3, 2, 1, 2, 1, 1, 1]
    assert [r["f_dt_nearest"] for r in out] == [1, 1, 2, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 1]


def test_nan_is_null(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "t int, v double"))
    assert fills.fill_missing(df, "v", "t", value=7.0).orderBy("t").first()["v"] == 7.0


def test_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 31, 5),), (dt.datetime(2023, 4, 1),)], "t timestamp_ntz")
    a, b = encode.date_parts(df, "t", "", with_time=True).orderBy(F.desc("year")).collect()
    assert (a["week"], a["dayofweek"], a["is_year_end"], a["is_quarter_end"], a["is_month_end"], a["hour"]) == (1, 1, 1, 1, 1, 5)
    assert (b["is_quarter_start"], b["is_month_start"], b["is_year_start"]) == (1, 1, 0)
    steps, start = encode.steps_since(df, "t", "h", name="n")
    assert [r[0] for r in steps.select(encode.time_at(F.col("n"), start, "h") == F.col("t")).collect()] == [True, True]
    rolled = df.select(calendar.roll_forward(F.col("t"), "MS").alias("m"), calendar.roll_forward(F.col("t"), "W").alias("w")).orderBy("m").collect()
    assert rolled[0]["m"] == dt.datetime(2023, 4, 1) and rolled[1]["m"] == dt.datetime(2025, 1, 1) and rolled[0]["w"].weekday() == 6


def test_encoders(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 3.0), ("a", 1, 2.0), (None, 2, 9.0)], "c string, k int, y double")
    ordinal = encode.OrdinalEncoder("c", suffix="_code").fit(df)
    new = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    assert [r["c_code"] for r in ordinal.transform(new).orderBy(F.desc_nulls_last("c")).collect()] == [0, 2, 0]
    assert {r["c"] for r in ordinal.inverse(ordinal.transform(new).drop("c")).collect()} == {"b", "#na#"}
    hot = encode.OneHotEncoder(["c", "k"]).fit(df)
    assert set(hot.transform(df).columns) == {"y", "c_a", "c_b", "k_1", "k_2"}
    assert {r["c"] for r in hot.inverse(hot.transform(df)).collect()} == {"a", "b", None}
    means = {r["c"]: r["c_mean"] for r in encode.TargetEncoder("y", "c", "_mean").fit(df.where("c is not null")).transform(df).collect()}
    assert means == {"a": 1.5, "b": 3.0, None: None}
    flags = spark.createDataFrame([(a, 0, c) for a, c in zip([0, 0, 1, 0, 0], [0, 1, 0, 0, 1], strict=True)], "a int, b int, c int")
    assert encode.drop_if_true(flags, "a").columns == ["b", "c"] and encode.drop_if_true(flags, "a").count() == 4


@pytest.mark.parametrize("kind", scale.KINDS)
def test_scalers(spark, kind):
    df = spark.createDataFrame([(i, i % 3, float(i * i % 17), i / 7) for i in range(60)], "id int, g int, a double, b double")
    for ids in (None, "g"):
        model = scale.Scaler(["a", "b"], kind, ids=ids, where="id < 50").fit(df)
        there = model.transform(df)
        back = {r["id"]: r for r in model.inverse(there).collect()}
        assert there.columns == df.columns
        assert all(back[r["id"]]["a"] == pytest.approx(r["a"], abs=1e-9) for r in df.collect())


def test_power_and_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 200)], "a double")
    assert scale.fit_power(df, "a", scale.box_cox) == pytest.approx(0.7, abs=0.2)
    q = df.select(scale.quantile_transform(df, "a", 10).alias("q")).agg(F.min("q"), F.max("q"), F.avg("q")).first()
    assert (q[0], q[1]) == (0, 1) and q[2] == pytest.approx(0.5, abs=0.01)
    assert scale.narrow(df.selectExpr("cast(a as long) a", "a b")).dtypes == [("a", "smallint"), ("b", "float")]
    assert scale.safe_to_cast(df, "a", "tinyint") == {"a": False}


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(400)], "id long, label int")
    one, two = splits.random_split(df, "id", seed=3, stratify="label"), splits.random_split(df.repartition(7), "id", seed=3, stratify="label")
    assert one.exceptAll(two).isEmpty() and one.where("split = 'valid'").count() == 80
    assert splits.k_fold(df, "id", 5, stratify="label").groupBy("fold", "label").count().agg(F.min("count"), F.max("count")).first() == (20, 20)
    wf = splits.walk_forward(df, "id", 3, valid=40, test=20, gap=5)
    assert splits.overlap(wf.where("fold = 1"), "id").isEmpty()
    assert {(r[0], r[1]): r[2] for r in wf.groupBy("fold", "split").count().collect()}[0, "train"] == 400 - 3 * 60 - 5
    moving = splits.walk_forward(df, "id", 2, valid=40, train=100, anchored=False).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in moving} == {"valid": 80, "train": 200}
    uneven = df.where("label < 2 or id % 3 = 0")
    assert splits.balance(uneven, "label", "id").groupBy("label").count().select("count").distinct().count() == 1
    assert splits.balance(uneven, "label", "id", oversample=False).groupBy("label").count().select("count").distinct().count() == 1
    assert splits.long_term_borders(0, 96, "ETTh1") == {"train": (0, 8640), "valid": (8544, 11520), "test": (11424, 14400)}


def test_forecasting_split_keeps_a_gap(spark):
    df = spark.createDataFrame([(e, d) for e in range(3) for d in range(100 - 20 * e)], "e int, d int")
    out = splits.forecasting_split(df, "d", 5, valid=0.1, test=0.2)
    ends = {r["split"]: (r[1], r[2]) for r in out.where("split is not null").groupBy("split").agg(F.min("d"), F.max("d")).collect()}
    assert ends["valid"][0] - ends["train"][1] == 5 and ends["test"][0] - ends["valid"][1] == 5


def test_statistics(spark):
    rows = [("a", float(x)) for x in range(30)] + [("b", float(x) * 1.1 + 2) for x in range(30)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = metrics.welch(df, "v", "g", "a", "b")
    assert t["t"] == pytest.approx(-1.4433, abs=2e-3) and t["p"] == pytest.approx(0.1543, abs=2e-3)
    assert metrics._beta_cdf(0.5, 2, 3) == pytest.approx(0.6875) and metrics._beta_cdf(0.9, 5, 1) == pytest.approx(0.9**5)
    ks = metrics.kolmogorov_smirnov(df, "v", "g", "a", "b")
    assert 0 < ks["d"] < 0.3 and ks["p"] > 0.1
    z = spark.createDataFrame([([2.0 * s, 0.0], int(s < 0)) for s in (1, 1, 1, -1, -1, -1)] + [([2.0, 0.0], 1)], "z array<double>, t int")
    assert metrics.fit_temperature(z, "z", "t") == pytest.approx(2 / 1.7918, abs=0.05)
    assert metrics.center_loss(spark.createDataFrame([([0.0, 0.0], 0), ([2.0, 0.0], 0)], "x array<double>, l int"), "x", "l").first()[0] == 1


def test_pipeline(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "id int, c string, v double")
    model = Pipeline([scale.Scaler("v"), encode.OrdinalEncoder("c", suffix="_code")]).fit(df)
    out = model.transform(df)
    model.save(spark, str(tmp_path / "p"))
    again = PipelineModel.load(spark, str(tmp_path / "p"))
    assert again.transform(df).exceptAll(out).isEmpty()
    assert [round(r["v"]) for r in again.inverse(out).orderBy("id").collect()] == list(range(20))


def test_importance(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), 2.0 * i) for i in range(60)], "id int, a double, b double, y double")
    scored = lambda d: score(d, lambda f: f["a"] * 2, ["a", "b"], ["id", "y"])
    out = permutation_importance(df, "id", ["a", "b"], scored, lambda d: d.agg(metrics.mae("prediction", "y").alias("mae")), blocks=2)
    got = {r["feature"]: r["change"] for r in out.collect()}
    assert got["a"] > 1 and got["b"] == 0


def test_step_importance(spark):
    from chronoloom.functions import augment, arrays
    from chronoloom.plans.pipeline import step_importance

    df = spark.createDataFrame([(i, [float(i), 1.0, float(i % 5)], float(i), 5.0, 1.0) for i in range(40)], "id int, x array<double>, y double, h double, l double")
    out = step_importance(df, "id", ["x"], 3, lambda d: d.withColumn("prediction", F.get("x", 0)), lambda d: d.agg(metrics.mae("prediction", "y").alias("mae")), blocks=1)
    got = {r["first_step"]: r["change"] for r in out.collect()}
    assert got[0] > 1 and got[1] == got[2] == 0
    bar = df.withColumns(augment.swap_high_low({"h": "l"}, F.col("id"))).first()
    assert (bar["h"], bar["l"]) == (1.0, 5.0) and arrays.savgol_window(10, 9, 2) == 9
