"""Splines, wavelets, reshaping, tabular preparation and sinks."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import kernels
from chronoloom.operators import reshape
from chronoloom.plans.tabular import Tabular
from chronoloom.sources import sinks


def test_spline_and_wavelet():
    x = np.arange(6.0)
    assert np.allclose(kernels.natural_spline(x, 3 * x + 1, np.linspace(0, 5, 21)), 3 * np.linspace(0, 5, 21) + 1)
    y = np.array([1.0, 3, 2, 5, 4, 4])
    assert np.allclose(kernels.natural_spline(x, y, x), y)
    v = np.random.default_rng(0).normal(size=32)
    a, d = kernels.dwt(v)
    assert np.allclose(kernels.idwt(a, d), v) and np.isclose((a**2).sum() + (d**2).sum(), (v**2).sum())
    assert np.abs(kernels.dwt(np.ones(16))[1]).max() < 1e-9
    noisy = np.sin(np.arange(256) / 20) + 0.2 * np.random.default_rng(1).normal(size=256)
    clean = kernels.frequency_denoise(3)(noisy, None)
    assert np.abs(clean - np.sin(np.arange(256) / 20)).mean() < np.abs(noisy - np.sin(np.arange(256) / 20)).mean()


@pytest.mark.parametrize("f", [kernels.magnitude_warp(0.2), kernels.time_warp(0.3), kernels.time_noise(0.5), kernels.window_warp(0.3), kernels.frequency_noise(0.5)])
def test_warps(spark, f):
    df = spark.createDataFrame([(i, [float(np.sin(j / 3 + i)) for j in range(40)], "a") for i in range(6)] + [(7, None, "b"), (8, [], "b")], "id long, x array<double>, other string")
    one, two = (kernels.apply(d, "x", "id", f, seed=3) for d in (df, df.repartition(3)))
    assert one.columns == df.columns and one.exceptAll(two).isEmpty()
    rows = {r["id"]: r["x"] for r in one.collect()}
    assert rows[7] is None and rows[8] == [] and all(len(rows[i]) == 40 for i in range(6))
    assert rows[0] != [float(np.sin(j / 3)) for j in range(40)]


def test_samples(spark):
    df = spark.createDataFrame([(i, 10 * i + k, 100 * i + k, k, "ab"[k == 2]) for k, i in enumerate([1, 1, 1, 2, 2, 2, 3, 3, 3])], "sample_id int, var1 long, var2 long, t int, y string").orderBy(F.rand(2))
    out = reshape.to_samples(df, "sample_id", "t", ["var1", "var2"], "y", length=3).orderBy("sample_id").collect()
    assert (out[0]["var1"], out[0]["var2"], out[0]["y"]) == ([10, 11, 12], [100, 101, 102], "a")
    with pytest.raises(ValueError):
        reshape.to_samples(df.where("t > 0"), "sample_id", "t", "var1", length=0)


def test_small_things(spark):
    df = spark.createDataFrame([(i, [1.0, None if i == 1 else 2.0, 3.0, 4.0], "ab"[i % 2]) for i in range(4)], "id long, x array<double>, k string")
    assert [r["x"][1] for r in reshape.copy_missing(df, "x", "id").orderBy("id").collect()] == [2.0, None, None, 2.0]
    assert reshape.zero_blocks(df, ["x"], 4, 2, keep=True).count() == 12
    lost = {r["k"]: r["x"] for r in reshape.drop_by_key(df.where("id <> 1"), "x", "k", {"a": 1.0}, "id").collect()}
    assert lost == {"a": [None] * 4, "b": [1.0, 2.0, 3.0, 4.0]}
    assert {(r["value"], r["code"]) for r in reshape.codes(df, "k").collect()} == {("a", 0), ("b", 1)}
    assert {(r["value"], r["position"]) for r in reshape.first_rows(df, "k", "id", ["b", "z"]).collect()} == {("b", 1)}
    assert spark.range(1).select(reshape.human_size(F.lit(1536)).alias("s")).first()["s"] == "1.50 KB"
    big = spark.range(5000).withColumn("w", F.when(F.col("id") < 50, 1000.0).otherwise(0.001)).withColumn("v", F.col("id") % 10 * 1.0)
    assert reshape.sample_rows(big, 40, "id", weight="w").where("id < 50").count() == 40
    assert reshape.bootstrap(big, "id").count() == pytest.approx(5000, rel=0.1)
    stats = reshape.random_statistics(big, "v", "id", 20)
    assert stats["mean_mean"] == pytest.approx(4.5, abs=0.2) and stats["std_mean"] == pytest.approx(2.87, abs=0.2)
    line = spark.createDataFrame([(float(i), 2.0 * i + 1, 0) for i in range(5)], "x double, y double, g int")
    assert all(r[0] == pytest.approx(r[1]) for r in reshape.trend(line, "x", "y", "g").select("y", "trend").collect())


def test_tabular(spark):
    rows = [("private", "hs", 39, 40.0, "<50k"), ("gov", None, 50, None, ">=50k"), ("private", "ba", 38, 40.0, "<50k"), ("new", "hs", None, 20.0, "<50k"), ("gov", "ba", 28, 45.0, ">=50k")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, workclass string, education string, age int, hours double, salary string")
    model = Tabular(["workclass", "education"], ["age", "hours"], ["salary"], "id < 3").fit(df)
    out = {r["id"]: r for r in model.transform(df).collect()}
    assert out[3]["workclass"] == 0 and out[1]["education"] == 0 and out[0]["workclass"] == 2
    assert out[1]["hours_na"] and "age_na" not in out[0].asDict() and out[3]["age"] == pytest.approx((39 - (39 + 50 + 38) / 3) / np.std([39, 50, 38], ddof=1), abs=1e-5)


def test_sinks(spark, tmp_path):
    df = sinks.made_up(spark, 20, 2, 5)
    back = sinks.save(df.withColumn("split", F.when(F.col("sample_id") < 15, "train").otherwise("test")), str(tmp_path / "t"), by="split")
    assert back.where("split = 'test'").count() == 5
    for name, wrap in (("a.npy", lambda b: b), ("b.npy", gzip.compress)):
        f = io.BytesIO()
        np.save(f, np.arange(12.0).reshape(3, 2, 2))
        (tmp_path / name).write_bytes(wrap(f.getvalue()))
        assert sinks.read_npy(spark, str(tmp_path / name)).orderBy("row").collect()[2]["values"] == [8, 9, 10, 11]


def test_order_rows_and_times(spark):
    rows = [(1, 2.0, "b"), (2, None, "A"), (3, float("nan"), "c"), (4, -1.0, None), (5, 7.0, "B")]
    df = spark.createDataFrame(rows, "k long, v double, s string")
    ids = lambda d: [r["k"] for r in d.collect()]
    assert ids(reshape.order_rows(df, ["v", "k"])) == [4, 1, 5, 2, 3]
    assert ids(reshape.order_rows(df, ["v", "k"], [False, True], na_position="first")) == [2, 3, 5, 1, 4]
    assert ids(reshape.order_rows(df.where("k <> 1"), "s", key=lambda c: F.lower(c.cast("string")))) == [2, 5, 3, 4]
    with pytest.raises(ValueError):
        reshape.order_rows(df, "v", na_position="middle")
    df = spark.createDataFrame([("2024-01-05", "x", "05/01/2024", 1), (None, "2024-01-01", "31/12/2023", 2)], "a string, b string, c string, n int")
    got = reshape.to_times(df, ["a", "b", "c", "n"])
    assert [f.dataType.typeName() for f in got.schema] == ["timestamp", "string", "string", "integer"]
    c = [r["c"] for r in reshape.to_times(df, "c", "dd/MM/yyyy").collect()]
    assert [(t.year, t.month, t.day) for t in c] == [(2024, 1, 5), (2023, 12, 31)]
