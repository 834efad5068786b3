"""Windows of entities too long for one task, descending ones, functions of targets and of all windows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import windows
from chronoloom.operators.frame import number_panel, numbered


@pytest.fixture(scope="module")
def panel(spark):
    """One entity with nine tenths of the rows, ties in the first order column, a null entity, entities of one row."""
    rows = [(1, i // 3, i, float(i)) for i in range(900)] + [(2, i, i, 10.0 * i) for i in range(60)] + [(None, i, i, -1.0 * i) for i in range(37)] + [(10 + i, 5, 0, 1.0) for i in range(3)]
    return spark.createDataFrame(rows, "id long, t long, k long, v double").repartition(6)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("slices", [2, 16, 256])
def test_numbers(panel, slices):
    a, b = numbered(panel, "id", ["t", "k"], "n", "all"), number_panel(panel, "id", ["t", "k"], "n", "all", slices)
    assert rows(a.select("id", "t", "k", F.col("n").cast("long"), F.col("all").cast("long"))) == rows(b.select("id", "t", "k", "n", "all"))


@pytest.mark.parametrize("how", [{}, {"stride": 3, "start": 2}, {"horizon": [1, 4], "padding": "pre", "stride": 2}, {"horizon": -2, "y_is_x_checked": False}, {"ascending": False}])
@pytest.mark.parametrize("chunk", [20, 101, 5000])
def test_chunks_give_the_same_windows(panel, how, chunk):
    how = {"horizon": 2, "y_is_x_checked": False} | how
    own = windows.sliding_windows(panel, ["t", "k"], "v", 5, ids="id", y="v", **how)
    cut = windows.sliding_windows(panel, ["t", "k"], "v", 5, ids="id", y="v", chunked=True, chunk=chunk, **how)
    assert rows(cut) == rows(own) and own.count() > 100


def test_no_task_holds_an_entity(spark, panel):
    """What the frames are made in: no group of rows is larger than a chunk and what its windows reach."""
    cut = windows.sliding_windows(panel, ["t", "k"], "v", 5, ids="id", y="v", horizon=2, chunked=True, chunk=50, y_is_x_checked=False)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    framed = [line for line in plan.splitlines() if "Window" in line and "collect_list" in line]
    assert framed and all("_chunk" in line for line in framed)
    assert not [line for line in plan.splitlines() if "row_number" in line and "_slice" not in line]


def test_descending(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "t long, v double")
    got = windows.sliding_windows(df, "t", "v", 3, y="v", horizon=1, ascending=False, y_is_x_checked=False).orderBy("window").collect()
    assert [(r["t"], r["v_x"], r["v_y"]) for r in got] == [(3, [5.0, 4.0, 3.0], 2.0), (2, [4.0, 3.0, 2.0], 1.0), (1, [3.0, 2.0, 1.0], 0.0)]


def test_target_function_and_processor(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t long, v double")
    got = windows.sliding_windows(df, "t", "v", 2, y="v", horizon=3, y_func=F.array_max, y_is_x_checked=False).collect()
    assert all(r["v_y"] == r["v_x"][-1] + 3 for r in got) and len(got) == 6
    # a function of the targets may look into the window
    inner = windows.sliding_windows(df, "t", "v", 3, y="v", horizon=[-1, 0], y_func=lambda y: F.get(y, 1) - F.get(y, 0)).collect()
    assert {r["v_y"] for r in inner} == {1.0}

    def batch(frames):
        for f in frames:
            keep = f[f["v_y"] > 5]
            yield pd.DataFrame({"t": keep["t"], "total": keep["v_x"].map(sum) + keep["v_y"]})

    done = windows.sliding_windows(df, "t", "v", 2, y="v", horizon=1, y_is_x_checked=False, processor=lambda d: d.mapInPandas(batch, "t long, total double"))
    assert {r["t"]: r["total"] for r in done.collect()} == {t: t + t - 1 + t + 1.0 for t in range(5, 9)}


def test_padded_panels_are_not_chunked(panel):
    with pytest.raises(ValueError, match="padded"):
        windows.sliding_windows(panel, ["t", "k"], "v", 5, ids="id", pad_remainder=True, chunked=True)
