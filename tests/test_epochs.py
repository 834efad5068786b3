"""Permutations, epochs, draws: each row once, exact numbers, no blocks, the same for a seed."""

import collections

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import augment
from chronoloom.operators import epochs


def table(spark, n):
    return spark.range(n).select((F.col("id") * 7).alias("k"), (F.col("id") % 10).cast("double").alias("v"), F.col("id").cast("string").alias("s")).repartition(5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 10, 17, 100, 101, 1000])
def test_places_are_a_permutation(spark, n):
    at = spark.range(n).select("id", *[epochs.place(F.col("id"), n, s).alias(f"p{s}") for s in (0, 1)])
    rows = at.withColumn("back", epochs.place(F.col("p0"), n, 0, inverse=True)).collect()
    assert sorted(r["p0"] for r in rows) == sorted(r["p1"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)
    if n >= 100:
        moved = [r["p0"] for r in sorted(rows, key=lambda r: r["id"])]
        assert moved != [r["p1"] for r in sorted(rows, key=lambda r: r["id"])] and sum(a == b for a, b in enumerate(moved)) < 10
        # places are spread: each tenth of the rows goes to each tenth of the places
        cells = collections.Counter((i * 10 // n, p * 10 // n) for i, p in enumerate(moved))
        assert n < 1000 or (len(cells) == 100 and max(cells.values()) < 30)


def test_epochs(spark):
    out = epochs.epochs(table(spark, 103), "k", 10, 3, seed=4).collect()
    by = collections.defaultdict(dict)
    for r in out:
        by[r["epoch"]][r["batch"], r["position"]] = r["k"]
    assert sorted(by) == [0, 1, 2]
    for e in by.values():
        assert sorted(e.values()) == [7 * i for i in range(103)]
        assert sorted(e) == [(i // 10, i % 10) for i in range(103)]
    assert by[0] != by[1] != by[2]
    again = {(r["batch"], r["position"]): r["k"] for r in epochs.epochs(table(spark, 103).repartition(2), "k", 10, 1, seed=4, first=2).collect()}
    assert again == by[2]  # an epoch can be asked for alone
    other = {(r["batch"], r["position"]): r["k"] for r in epochs.epochs(table(spark, 103), "k", 10, seed=5).collect()}
    assert other != by[0]
    full = epochs.epochs(table(spark, 103), "k", 10, drop_last=True)
    assert full.count() == 100 and full.where("batch = 10").isEmpty()
    plain = epochs.epochs(table(spark, 25), "k", 10, shuffle=False).collect()
    assert all(r["k"] == 7 * (r["batch"] * 10 + r["position"]) for r in plain)
    assert epochs.epochs(table(spark, 0), "k", 10).count() == 0


def test_batches(spark):
    got = epochs.batches(table(spark, 25), "k", ["v", "s"], 10, 2).collect()
    assert sorted((r["epoch"], r["batch"], len(r["v"]), len(r["s"])) for r in got) == [(e, b, n, n) for e in (0, 1) for b, n in ((0, 10), (1, 10), (2, 5))]
    assert all(float(s) % 10 == v for r in got for v, s in zip(r["v"], r["s"], strict=True))
    assert "Exchange rangepartitioning" not in epochs.epochs(table(spark, 25), "k", 10)._jdf.queryExecution().toString().split("Physical")[1]


def test_shuffled(spark):
    n = 500
    out = epochs.shuffled(table(spark, n), "k", ["v", "s"], seed=1)
    assert out.columns == ["k", "v", "s"]
    rows = out.collect()
    assert sorted(r["s"] for r in rows) == sorted(map(str, range(n))) and collections.Counter(r["v"] for r in rows) == {float(d): 50 for d in range(10)}
    assert {r["k"] for r in rows} == {7 * i for i in range(n)}
    assert sum(r["s"] == str(r["k"] // 7) for r in rows) < 10 and sum(float(r["s"]) % 10 == r["v"] for r in rows) < 100  # each column by itself
    whole = epochs.shuffled(table(spark, n), "k", ["v", "s"], seed=1, together=True).collect()
    assert all(float(r["s"]) % 10 == r["v"] for r in whole) and sum(r["s"] == str(r["k"] // 7) for r in whole) < 10
    far = [abs(int(r["s"]) - r["k"] // 7) for r in whole]
    assert max(far) > n // 2 and n / 4 < sum(far) / n < n / 2.4  # no blocks: a third of the table apart, as of any two rows


def test_rolled_and_within(spark):
    assert sorted((r["k"] // 7, r["s"]) for r in epochs.rolled(table(spark, 20), "k", "s", 3).collect()) == sorted(((i + 3) % 20, str(i)) for i in range(20))
    x = spark.range(30).select("id", F.expr("sequence(1, 50)").alias("x"))
    rows = [r["x"] for r in epochs.shuffled_within(x, "x", "id").collect()]
    assert all(sorted(r) == list(range(1, 51)) for r in rows) and len(set(map(tuple, rows))) == 30


def test_draws(spark):
    n, m = 5000, 100
    rows = epochs.draws(table(spark, m), "k", n, seed=2).collect()
    assert sorted(r["draw"] for r in rows) == list(range(n))
    counts = collections.Counter(r["k"] for r in rows)
    assert len(counts) == m and sum((counts[7 * i] - n / m) ** 2 / (n / m) for i in range(m)) < 149  # chi-square, 99.9 %
    assert max(collections.Counter(r["k"] for r in epochs.draws(table(spark, 3), "k", 100).collect()).values()) > 20  # no cap of draws
    assert sorted(map(tuple, rows)) == sorted(map(tuple, epochs.draws(table(spark, m).repartition(2), "k", n, seed=2).collect()))
    assert epochs.draws(table(spark, 0), "k", 5).count() == 0


@pytest.mark.parametrize("slices", [1, 7, 256])
def test_weighted_draws(spark, slices):
    """A third of the weight on one row, null and no weights, and so on."""
    weights = [50.0, 0.0, None, -1.0] + [1.0] * 80 + [10.0, 10.0]
    df = spark.createDataFrame(list(enumerate(weights)), "k long, w double").repartition(4)
    rows = epochs.draws(df, "k", 3000, weight="w", seed=3, slices=slices).collect()
    assert sorted(r["draw"] for r in rows) == list(range(3000))
    counts = collections.Counter(r["k"] for r in rows)
    assert not {1, 2, 3} & set(counts)
    total = sum(w for w in weights if w and w > 0)
    assert sum((counts[i] - 3000 * w / total) ** 2 / (3000 * w / total) for i, w in enumerate(weights) if w and w > 0) < 127
    assert epochs.draws(df.where("w <= 0"), "k", 5, weight="w").count() == 0


def test_weighted_draws_against_a_line(spark):
    """Each point is on its row's stretch of the line."""
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(50)], "k long, w double")
    unit = {r["id"]: r["u"] for r in spark.range(200).select("id", epochs._unit(F.col("id"), 9).alias("u")).collect()}
    ends, total = {}, 0.0
    for i in range(50):
        ends[i] = (total, total + i % 4)
        total += i % 4
    for r in epochs.draws(df, "k", 200, weight="w", seed=9, slices=13).collect():
        lo, hi = ends[r["k"]]
        assert lo <= unit[r["draw"]] * total < hi


def test_augmentations_by_batch(spark):
    names = ["noise", "scale", "shift", "drop_steps"]
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 100).alias("batch"), F.floor(F.col("id") / 200).alias("epoch"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sin(i * F.col("id"))).alias("x"))
    got = df.withColumns({"y": augment.rand_augment_batches("x", "k", "batch", names, 2, 4, seed=9), "picked": augment.drawn(names, "batch", 2, seed=9)})
    own, rows = F.struct("k", "batch"), got.collect()
    ways = {r["batch"]: tuple(r["picked"]) for r in rows}
    assert all(len(set(w)) == 2 for w in ways.values()) and all(ways[r["batch"]] == tuple(r["picked"]) for r in rows)
    assert len(set(ways.values())) == 12  # all ordered pairs come up in 100 batches
    for a, b in sorted(set(ways.values()))[::5]:
        want = df.withColumn("y", augment.CHOICES[b](augment.CHOICES[a]("x", own, 0.4, seed=9), own, 0.4, seed=110))
        want = {r["k"]: r["y"] for r in want.collect()}
        assert all(r["y"] == want[r["k"]] for r in rows if ways[r["batch"]] == (a, b))
    again = {r["k"]: r["y"] for r in got.repartition(7).collect()}
    assert all(again[r["k"]] == r["y"] for r in rows)
    other = df.select(augment.drawn(names, F.struct("epoch", "batch"), 2, seed=9).alias("p"), "batch").collect()
    assert any(tuple(r["p"]) != ways[r["batch"]] for r in other)
    with pytest.raises(ValueError):
        augment.drawn(names, "batch", 5)
    assert spark.createDataFrame([(1, None, [1.0])], "k long, batch long, x array<double>").select(augment.rand_augment_batches("x", "k", "batch", names).alias("y")).first()["y"] is not None
