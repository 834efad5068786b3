"""Readers, poses, random augmentations, convolution features and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import augment
from chronoloom.operators import features, pose
from chronoloom.sources import series
from chronoloom.streaming.windows import sliding, tumbling

TS = "@problemName x\n@timeStamps false\n@univariate false\n@classLabel true a b\n@data\n1,2,3:4,?,6:a\n7,8,9:1,1,1:b\n"
TSF = "@relation x\n@attribute series_name string\n@attribute start_timestamp date\n@frequency monthly\n@horizon 12\n@missing true\n@equallength false\n@data\nT1:1990-01-31 00-00-00:1,?,3\n"


def test_ts(spark, tmp_path):
    (tmp_path / "a.ts").write_text(TS)
    rows = series.read_ts(spark, str(tmp_path / "a.ts"))
    wide = series.to_arrays(rows, ["sample_id", "label"]).orderBy("sample_id").collect()
    assert [(r["label"], r["x0"], r["x1"]) for r in wide] == [("a", [1, 2, 3], [4, None, 6]), ("b", [7, 8, 9], [1, 1, 1])]
    timed = TS.replace("false\n@univ", "true\n@univ").replace("1,2,3:4,?,6:a\n7,8,9:1,1,1:b", "(0,1.0),(1,2.0):(0,?):a")
    assert list(series.parse_ts(timed.splitlines())) == [(0, 0, 0, "0", 1.0, "a"), (0, 0, 1, "1", 2.0, "a"), (0, 1, 0, "0", None, "a")]
    assert next(series.parse_ts(TS.replace("@classLabel true a b", "@targetlabel true").replace(":a", ":1.5").replace(":b", ":2").splitlines()))[-1] == "1.5"


@pytest.mark.parametrize("text", ["", "1,2:a\n", TS.replace("@univariate false\n", ""), TS.replace("7,8,9:1,1,1:b", "7,8,9:b"), TS.replace(":b\n", ":c\n")])
def test_bad_ts(text):
    with pytest.raises(series.ParseError):
        list(series.parse_ts(text.splitlines()))


def test_tsf(spark, tmp_path):
    (tmp_path / "a.tsf").write_text(TSF)
    df = series.read_tsf(spark, str(tmp_path / "a.tsf"))
    assert df.first()["horizon"] == 12
    long = series.explode_series(df.withColumn("s", F.col("attributes")["start_timestamp"]), start="s", every=series.FREQUENCIES["monthly"], keep=["series_id"])
    assert [(str(r["time"])[:10], r["value"]) for r in long.orderBy("step").collect()] == [("1990-01-31", 1.0), ("1990-02-28", None), ("1990-03-31", 3.0)]


@pytest.mark.parametrize("text", ["", TSF.replace("string", "text"), TSF.replace("T1:", ""), TSF.replace("1,?,3", "?,?"), TSF.replace("@data\n", "")])
def test_bad_tsf(text):
    with pytest.raises(series.ParseError):
        list(series.parse_tsf(text.splitlines()))


def person(x, y, score=0.9):
    k = [[x + 10 * (j % 5), y + (60 if j in pose.HIPS else 0) + 3 * j] for j in range(pose.JOINTS)]
    return {"bbox": [[x, y, x + 60, y + 120]], "bbox_score": score, "keypoints": k, "keypoint_scores": [score] * pose.JOINTS}


def test_pose(spark, tmp_path):
    frames = [{"instances": [person(100 + t, 100), person(300, 250, 0.7)]} for t in range(12)]
    frames[4] = {"instances": []}
    frames[6]["instances"][1]["keypoints"] = frames[6]["instances"][1]["keypoints"][:5]
    del frames[7]["instances"][0]["bbox"]
    (tmp_path / "a.json").write_text(json.dumps(frames))
    paths, lost = pose.select_files(spark, str(tmp_path), spark.createDataFrame([("a",), ("b",)], "stem string"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.json"] and lost == ["b"]
    read = pose.read_frames(spark, str(tmp_path / "a.json"))
    found = {r["frame"]: len(r["candidates"]) for r in pose.candidates(read).collect()}
    assert len(found) == 12 and found[4] == 0 and found[6] == 1 and found[0] == 2
    out = pose.tracks(read).toPandas()
    assert len(out) == 12 * pose.JOINTS and np.isfinite(out[["x", "y"]]).all().all()
    hips = out[out.joint.isin(pose.HIPS)].groupby("frame")[["x", "y"]].mean()
    assert np.abs(hips.to_numpy()).max() < 1e-4


def test_follow():
    assert pose.follow([[(0.5, 0.5, 0.5), (0.1, 0.1, 0.5)], [], [(0.1, 0.1, 0.55), (0.5, 0.5, 0.5)]]) == [0, None, 1]


@pytest.mark.parametrize("name", sorted(augment.CHOICES))
def test_augmentations(spark, name):
    df = spark.createDataFrame([(i, [float(j * (i + 1) % 11) for j in range(40)]) for i in range(8)], "id long, x array<double>")
    make = lambda seed, d=df: {r["id"]: r["y"] for r in d.select("id", augment.CHOICES[name]("x", F.col("id"), 0.3, seed=seed).alias("y")).collect()}
    one = make(1)
    assert one == make(1, df.repartition(3)) and one != make(2)
    assert all(len(v) == 40 and None not in v for v in one.values())


def test_masks(spark):
    df = spark.range(400).select("id", augment.subsequence_mask(60, F.col("id"), 0.15, 3.0, seed=1).alias("m"), augment.future_mask(60, F.col("id"), 0.2).alias("f"), augment.variable_mask(5, F.col("id"), 0.3).alias("v"), augment.create_mask(60, F.col("id"), variable=True, future=True).alias("c"))
    rows = df.collect()
    m = np.array([r["m"] for r in rows])
    starts = (m[:, 1:] & ~m[:, :-1]).sum()
    assert m.mean() == pytest.approx(0.15, abs=0.03) and m.sum() / starts == pytest.approx(3, abs=0.6)
    assert all(sorted(r["f"]) == r["f"] for r in rows) and all(len(r["c"]) == 60 for r in rows)


def test_mixes(spark):
    df = spark.createDataFrame([(i, [float(i)] * 10, float(i % 2), "ab"[i % 2]) for i in range(40)], "id long, x array<double>, y double, label string")
    mixed = augment.mixup(df, "x", "y", "id", blocks=2).collect()
    assert len(mixed) == 40 and all(0 <= r["mix"] <= 0.5 for r in mixed) and any(r["x"][0] != r["id"] for r in mixed)
    cut = augment.cutmix(df, "x", "id", within="label", blocks=1).collect()
    assert all((v - r["id"]) % 2 == 0 for r in cut for v in r["x"]) and all(r["mix"] == 0.3 for r in cut)


def test_convolution_features(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.sin(np.arange(64) * (0.2 + 0.3 * (i % 2))) + 0.3 * rng.normal(size=64)).tolist(), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    model = features.MiniRocket(["x"], features=168, sample=40).fit(df, "id")
    out = model.transform(df, ["id", "y"])
    got = out.orderBy("id").collect()
    x = np.array([[r[1]] for r in rows])
    assert np.allclose([r["features"] for r in got], model.apply(x)) and len(got[0]["features"]) == 168
    # one kernel by plain convolution
    k, d = model.kernels[5], model.plan[0][0]
    w = np.full(9, -1.0)
    w[k] = 2
    plain = [sum(w[j] * (x[0, 0, t + (j - 4) * d] if 0 <= t + (j - 4) * d < 64 else 0) for j in range(9)) for t in range(64)]
    assert np.allclose(features._dilated(x[:1, 0], model.kernels[5:6], d, True)[0, 0], plain)
    predict = features.ridge_fit(out.where("id < 60"), "features", "y", 0.1)
    held = predict(out.where("id >= 60")).select("id", "y", "prediction").collect()
    assert sum(r["y"] == r["prediction"] for r in held) >= 18
    assert len(features.Rocket(["x"], 10).model(64).transform(df, ["id"]).first()["features"]) == 20
    assert len(features.MultiRocketModel(model, features.MiniRocket(["x"], 168).fit_array(np.diff(x, axis=2))).apply(x)[0]) == 2 * 4 * 168
    assert np.isfinite(features.Hydra(["x"], 4, 4).apply(x)).all()
    assert features.poolings(np.array([[1.0, -1, 2, 3]]), np.zeros(1)).tolist() == [[[0.75, 2.0, pytest.approx((0 + 2 + 3) / 3 / 4), 0.5]]]


def test_convolutions_take_few_samples_at_once(spark):
    """Whatever the size of Arrow's batches; nulls within a series are 0, columns may be slices."""
    df = spark.range(0, 1000, 1, 1).select("id", F.array(F.col("id").cast("double"), F.lit(None).cast("double"), F.lit(2.0)).alias("x"))
    at_once = lambda x: np.stack([np.full(len(x), float(len(x))), x[:, 0, 0], x[:, 0, 1]], 1)
    rows = features._map(df, ["x"], at_once, "y", ["id"]).collect()
    assert [r["y"][1:] for r in rows] == [[float(i), 0.0] for i in range(1000)]
    assert max(r["y"][0] for r in rows) <= 256


def test_streams(spark, tmp_path):
    rows = [(k, t, float(10 * k + t)) for t in range(6) for k in (1, 2)]
    for i in range(2):
        spark.createDataFrame(rows[6 * i : 6 * i + 6], "k long, t long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long, t long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sliding(source, "k", "t", "v", 3).writeStream.format("memory").queryName("slid").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["at"]): r["x"] for r in spark.sql("select * from slid").collect()}
    assert got == {(k, t): [10 * k + t - 2.0, 10 * k + t - 1.0, 10 * k + t + 0.0] for k in (1, 2) for t in range(2, 6)}
    timed = source.withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    q = tumbling(timed, "ts", "2 minutes", ["k"], "v").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from tumbled").first()[0] == 12
