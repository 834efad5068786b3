"""Frames: sizes and values that follow from plain slicing."""

import math

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import arrays
from chronoloom.operators import windows


@pytest.fixture(scope="module")
def sequence(spark):
    return spark.createDataFrame([(t, t, 10 * t, 100 * t) for t in range(20)], "t int, f1 long, f2 long, f3 long")


def test_history_and_one_step(sequence):
    out = windows.sliding_windows(sequence, "t", ["f1", "f2", "f3"], 8, y=["f1"], horizon=1, y_is_x_checked=False).orderBy("window").collect()
    assert len(out) == 12 and out[0]["f1_x"] == list(range(8)) and [r["f1_y"] for r in out] == list(range(8, 20))


def test_sparse_lags(sequence):
    out = windows.sparse_windows(sequence, "t", "f1", [-4, -2, -1, 0], y=["f2", "f3"], horizons=[1, 2, 4]).orderBy("t").collect()
    assert len(out) == 12 and out[0]["f1_x"] == [0, 2, 3, 4] and out[0]["f2_y"] == [50, 60, 80]
    with pytest.raises(ValueError):
        windows.sparse_windows(sequence, "t", "f1", [0, 1])


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7, 11])
def test_no_overlap_with_remainder(spark, window):
    df = spark.createDataFrame([(i, i / 10, i) for i in range(11)], "row int, col double, target int")
    cut = windows.sliding_windows(df, "row", "col", window, stride=None).count()
    padded = windows.sliding_windows(df, "row", "col", window, stride=None, pad_remainder=True).collect()
    assert cut == 11 // window and len(padded) == math.ceil(11 / window)
    assert all(round(r["col"][0] * 10) == r["window"] * window for r in padded)


@pytest.mark.parametrize(("padding", "x", "y"), [("pre", [[4, 5, 6], [6, 7, 8]], [[7, 8, 9, 10], [9, 10, 11, 12]]), ("post", [[3, 4, 5], [5, 6, 7]], [[6, 7, 8, 9], [8, 9, 10, 11]])])
def test_anchors(spark, padding, x, y):
    df = spark.createDataFrame([(i, i, i) for i in range(13)], "sample_id int, var1 long, target int")
    how = {"y": "target", "horizon": 4, "stride": 2, "start": 3, "padding": padding}
    out = windows.sliding_windows(df, "sample_id", "var1", 3, **how).orderBy("window").collect()
    assert [r["var1"] for r in out] == x and [r["target"] for r in out] == y
    assert windows.sliding_windows(df, "sample_id", "var1", 3, pad_remainder=True, **how).count() == 3
    assert windows.sliding_windows(df, "sample_id", "var1", 10, pad_remainder=True, **how).count() == 1


def test_short_entities_go(spark):
    df = spark.createDataFrame([(d, t, float(t)) for d, n in ((0, 100), (1, 4), (2, 100)) for t in range(n)], "device int, time int, v double").orderBy(F.rand(1))
    out = windows.sliding_windows(df, "time", "v", 5, ids="device").groupBy("device").count().collect()
    assert {r[0]: r[1] for r in out} == {0: 96, 2: 96}


def test_forecasting_pairs(spark):
    df = spark.createDataFrame([(t, float(t)) for t in range(100)], "t int, v double")
    out = windows.forecasting_pairs(df, "t", 10, 5, x="v", y="v").collect()
    assert len(out) == 86 and all(r["v_y"] == [r["v_x"][-1] + k for k in range(1, 6)] for r in out)
    assert windows.forecasting_pairs(spark.range(966).selectExpr("id t", "double(id) v"), "t", 104, 60, x="v", y="v").count() == 803


def test_nulls_keep_their_places(spark):
    df = spark.createDataFrame([(t, None if t % 2 else float(t)) for t in range(6)], "t int, v double")
    assert windows.sliding_windows(df, "t", "v", 6).first()["v"] == [0, None, 2, None, 4, None]


def test_leaks_are_refused(sequence):
    with pytest.raises(ValueError):
        windows.sliding_windows(sequence, "t", "f1", 3, y="f1", horizon=0)


def test_on_the_fly(sequence):
    assert windows.windows_on_the_fly(sequence, "t", "f1", 5, stride=2).count() == 8
    assert windows.windows_on_the_fly(sequence, "t", "f1", 5, drop_start=3, drop_end=4).count() == 9


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0, 16.0],)], "x array<double>")
    one = lambda c: df.select(c.alias("y")).first()["y"]
    assert one(arrays.roll("x", 2)) == [8, 16, 1, 2, 4]
    assert one(arrays.patches("x", 2, 2)) == [[0, 1], [2, 4], [8, 16]]
    assert one(arrays.patches("x", 3, 2, pad_before=False, reduce="mean")) == [pytest.approx(7 / 3), pytest.approx(28 / 3)]
    assert one(arrays.interpolated(F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)))) == [1, 1, 2, 3]
    assert one(arrays.savgol_smoothed(F.transform("x", lambda v: v), 5, 4)) == pytest.approx([1, 2, 4, 8, 16])
    assert one(F.transform(arrays.markov_field("x", 2), lambda r: F.size(r))) == [5] * 5
    assert sum(one(arrays.softmax("x"))) == pytest.approx(1)
    assert one(arrays.take("x", [0, -1, 2])) == [1, 16, 4]
    assert one(arrays.mark_padding(F.array(*[F.lit(v) for v in (1.0, 0.0, 1.0, 1.0)]))) == [1, 0, -1, -1]
    assert one(arrays.most_frequent(F.array(*[F.lit(v) for v in (3, 1, 3, 1, 2)]))) == 1


@pytest.mark.parametrize("how", [{}, {"y": "f2", "horizon": 3, "stride": 2, "start": 1}, {"y": "f2", "horizon": -2, "padding": "pre"}, {"y": "f2", "horizon": 4, "padding": "pre", "stride": 3}])
def test_chunks_of_a_series(spark, how):
    df = spark.createDataFrame([(t, float(t * t % 17), float(t)) for t in range(101)], "t int, f1 double, f2 double").repartition(5)
    one, two = (windows.sliding_windows(df, "t", "f1", 6, chunk=c, **how).orderBy("window").collect() for c in (8, 100_000))
    three = windows.sliding_windows(df.withColumn("e", F.lit(1)), "t", "f1", 6, ids="e", **how).drop("e").orderBy("window").collect()
    assert one == two == three and len(one) > 20


def test_numbers_of_a_series(spark):
    from chronoloom.operators.frame import number_series

    df = spark.range(1000).selectExpr("case when id < 3 then null when id < 400 then 7 else id end k", "id").repartition(7)
    got = number_series(df, ["k", "id"], "rn", "n", slices=16).orderBy("rn").collect()
    assert [r["id"] for r in got] == list(range(1000)) and [r["rn"] for r in got] == list(range(1, 1001)) and got[0]["n"] == 1000
