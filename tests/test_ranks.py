"""Exact ranks in slices, kernels and the choice of a person, against NumPy and values worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import frame, metrics, pose, scale

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    skewed = [None if i % 11 == 0 else float(7 if i % 3 else rng.normal()) for i in range(2000)]  # a third of distinct values, many ties
    return skewed, spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(skewed)], "id long, a double, b long").repartition(4)


def test_quantiles(spark, table):
    values, df = table
    got = {r["variable"]: r["q"] for r in frame.quantiles(df.withColumn("none", F.lit(None).cast("double")), ["a", "b", "none"], SHARES).collect()}
    assert got["a"] == pytest.approx(np.quantile([v for v in values if v is not None], SHARES))
    assert got["b"] == pytest.approx(np.quantile([i % 4 for i in range(2000)], SHARES)) and "none" not in got
    assert frame.quantiles(df.limit(0), "a", SHARES).count() == 0


def test_running_totals(spark, table):
    runs = table[1].groupBy("a").agg(F.count("*").alias("m"))
    got = sorted(frame.running(runs, "a", {"upto": "m"}).collect(), key=lambda r: (r["a"] is not None, r["a"]))
    assert [r["upto"] for r in got] == np.cumsum([r["m"] for r in got]).tolist() and got[0]["a"] is None


def test_whole_table_fits(spark, table):
    values, df = table
    known = np.array([v for v in values if v is not None])
    lo, mid, hi = np.quantile(known, [0.25, 0.5, 0.75])
    model = scale.Scaler("a", kind="robust", eps=0.0).fit(df).stats.first()
    assert (model["a__center"], model["a__scale"]) == pytest.approx((mid, hi - lo))
    clipped = [r["a"] for r in scale.clip_outliers(df, "a").orderBy("id").collect()]
    assert clipped == pytest.approx([None if v is None else min(max(v, lo - 1.5 * (hi - lo)), hi + 1.5 * (hi - lo)) for v in values])
    empty = scale.Scaler("a", kind="robust", where="a > 1e9").fit(df).transform(df)
    assert empty.count() == len(values) and empty.where("a is not null").isEmpty()


def test_kernel_window():
    assert metrics.kernel_window("gaussian", 5, 1.0) == pytest.approx([math.exp(-2) + math.exp(-4.5), math.exp(-0.5) + math.exp(-8), 1, math.exp(-0.5) + math.exp(-8), math.exp(-2) + math.exp(-4.5)])
    # from a half width of 4, what passes the end by one place comes back: places 4 and 5
    assert metrics.kernel_window("gaussian", 9, 2.0)[0] == pytest.approx(math.exp(-2) + math.exp(-25 / 8), abs=1e-4)
    assert metrics.kernel_window("triang", 5) == pytest.approx([1 / 3, 2 / 3, 1, 2 / 3, 1 / 3])
    assert metrics.kernel_window("laplace", 3, 2.0) == pytest.approx([math.exp(-0.5), 1, math.exp(-0.5)])
    with pytest.raises(ValueError):
        metrics.kernel_window("box")


def test_first_frame_prefers_the_centre():
    # 0.60 + 0.15 against 0.65 + 0.15 * (1 - 0.8)
    assert pose.follow([[(0.5, 0.5, 0.60), (0.9, 0.9, 0.65)]]) == [0]


def test_candidates_of_odd_sizes(spark, tmp_path):
    points = [[float(10 * j), float(5 * j)] for j in range(20)]
    people = [
        {"bbox_score": 0.5, "keypoints": points, "keypoint_scores": [0.5] * 17 + [9.0] * 3},  # more joints than count
        {"keypoints": points[:17]},  # no scores: 1 each
        {"bbox_score": 2.0, "keypoints": points[:17], "keypoint_scores": [1.5] * 17},  # beyond 1
        {"keypoints": points[:16]},  # too few
    ]
    (tmp_path / "a.json").write_text(json.dumps([{"instances": people}]))
    found = pose.candidates(pose.read_frames(spark, str(tmp_path / "a.json"))).first()["candidates"]
    assert [len(c["keypoints"]) for c in found] == [17, 17, 17] == [len(c["scores"]) for c in found]
    assert found[1]["scores"] == [1.0] * 17
    own = [0.25 * 0.5 + 0.25 * 0.5, 0.25 * 1.0, 0.25 * 2.0 + 0.25 * 1.5]
    assert [c["fixed"] - found[1]["fixed"] for c in found] == pytest.approx([o - own[1] for o in own])


def test_quantiles_of_entities(spark):
    """One entity has nine tenths of the rows, one has no values, one is null; slices are small."""
    rng = np.random.default_rng(8)
    rows = [("big" if i % 10 else ("small", None, "empty")[i // 10 % 3], float(rng.integers(0, 400) if i % 4 else rng.normal()), float(i)) for i in range(3000)]
    rows = [(k, None if k == "empty" else a, b) for k, a, b in rows]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(4)
    for lower, method in ((False, "linear"), (True, "inverted_cdf")):
        got = {(r["k"], r["variable"]): r["q"] for r in frame.quantiles(df, ["a", "b"], SHARES, "k", lower=lower, slices=16).collect()}
        assert ("empty", "a") not in got and len(got) == 7
        for (k, c), q in got.items():
            own = [r[1 if c == "a" else 2] for r in rows if r[0] == k]
            assert q == pytest.approx(np.quantile(own, SHARES, method=method))
    assert frame.quantiles(df.limit(0), "a", SHARES, "k").count() == 0


def test_both_kinds_of_quantiles_at_once(spark):
    """One pass for linear and least values; infinite values, negative zeros and NaN, the greatest, are ranked as Spark orders them."""
    values = [-math.inf, -0.0, 0.0, 1.0, 2.0, math.inf, math.nan] + [float(i % 37) - 18 for i in range(900)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values * 2)], "k int, v double").repartition(3)
    both = {r["k"]: r["q"] for r in frame.quantiles(df, "v", [0.3, 0.5, 0.3, 1.0], "k", lower=[False, False, True, True], slices=8).collect()}
    for k in (0, 1):
        own = sorted([v for i, v in enumerate(values * 2) if i % 2 == k], key=lambda v: (v != v, v))
        want = [own[math.ceil(0.3 * len(own)) - 1], own[-1]]
        assert both[k][:2] == pytest.approx(np.quantile([v if v == v else math.inf for v in own], [0.3, 0.5])) and both[k][2] == want[0] and math.isnan(both[k][3])


def test_normal_quantiles(spark):
    from statistics import NormalDist

    shares = [1e-7, 1e-4, 0.02, 0.0243, 0.3, 0.5, 0.9, 0.9999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in [*shares, None, 0.0, 1.0]], "p double").select("p", scale.normal_quantile("p").alias("z")).withColumn("back", scale.normal_share("z"))
    got = df.collect()
    for r in got[: len(shares)]:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-8) and r["back"] == pytest.approx(r["p"], abs=1e-14)
    assert got[-3]["z"] is None and got[-3]["back"] is None and got[-2]["z"] == pytest.approx(-got[-1]["z"])


def test_quantile_scaler(spark):
    rng = np.random.default_rng(2)
    values = [None, *np.exp(rng.normal(size=1500)).tolist()]
    df = spark.createDataFrame([(i, v, 5.0 if i % 3 else float(i), None) for i, v in enumerate(values)], "id long, a double, tied double, none double")
    model = scale.QuantileScaler(["a", "tied", "none"], 200).fit(df)
    z = model.transform(df)
    got = z.orderBy("id").collect()
    a = np.array([r["a"] for r in got[1:]])
    assert got[0]["a"] is None and abs(np.median(a)) < 0.02 and abs(np.std(a) - 1) < 0.1 and all(r["none"] is None for r in got)
    assert len({r["tied"] for r in got if r["id"] % 3}) == 1
    back = {r["id"]: r["a"] for r in model.inverse(z).collect()}
    assert all(back[i] == pytest.approx(v, rel=1e-7) for i, v in enumerate(values) if v is not None)
    flat = scale.QuantileScaler("a", 200, normal=False).fit(df).transform(df).select(F.min("a"), F.max("a")).first()
    assert tuple(flat) == (0.0, 1.0)
