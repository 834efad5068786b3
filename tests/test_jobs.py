"""The jobs: against their SQL, twice, over growing input, with odd rows and after a batch that broke off."""

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, conversation_series, forecast_frames
from jobs.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def files(spark, path):
    return {r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    table = "events" if "frames" in name else "conversations"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(names)
    plain = lambda r: str([None if r[c] is None else round(r[c], 5) + 0.0 if isinstance(r[c], float) else str(r[c]) for c in sorted(names)])
    got = sorted(plain(r) for r in out.collect())
    assert got == sorted(map(plain, want)) and len(got) > 100


def test_frames_do_not_see_ahead(spark, tmp_path):
    """No target of a split is a training target; a rerun gives the same rows and no more."""
    how = common.settings("forecast_frames") | {"history": 3}
    first = forecast_frames.run(spark, f"{SF}/events.parquet", str(tmp_path), **how)
    before = rows(spark.read.parquet(f"{tmp_path}/frames"))
    assert forecast_frames.run(spark, f"{SF}/events.parquet", str(tmp_path), **how) == first
    out = spark.read.parquet(f"{tmp_path}/frames")
    assert rows(out) == before and len(before) == first["written"] and first["read"] == 10_000
    spans = {r["split"]: (r["a"], r["b"]) for r in out.groupBy("split").agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    gap = how["horizon"]
    assert (spans["valid"][0] - spans["train"][1]).days >= gap and (spans["test"][0] - spans["valid"][1]).days >= gap
    # scaled by training alone, and back
    s = spark.read.parquet(f"{tmp_path}/scaler").first()
    days = forecast_frames.panel(spark.read.parquet(f"{SF}/events.parquet"), ["error"])
    back = out.select("user_id", "day", (F.col("x_total_3") * s["total__scale"] + s["total__center"]).alias("v")).join(days, ["user_id", "day"])
    assert back.where("abs(v - total) > 0.01").isEmpty() and back.count() == len(before)


def test_frames_of_odd_events(spark, tmp_path):
    events = [(d, u, t, v) for u in (1, 2) for d in range(1, 31) for t, v in (("view", 1.0 * d), ("error", 1e9))]
    table = spark.createDataFrame(events, "d int, user_id long, event_type string, value double").select(F.make_timestamp_ntz(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("ts"), "user_id", "event_type", "value")
    odd = spark.createDataFrame([(None, 1, "view", 1.0), (None, None, None, None)], table.schema)
    one = spark.createDataFrame([(7, "view")], "user_id long, event_type string").select(F.make_timestamp_ntz(*map(F.lit, (2024, 1, 5, 0, 0, 0))).alias("ts"), "user_id", "event_type", F.lit(None).cast("double").alias("value"))
    path = f"{tmp_path}/events"
    table.unionByName(odd).unionByName(one).withColumn("day", F.lit("x")).write.parquet(path)
    done = forecast_frames.run(spark, path, f"{tmp_path}/out", **common.settings("forecast_frames"))
    out = spark.read.parquet(f"{tmp_path}/out/frames")
    assert done["written"] == out.count() > 0
    assert {r["user_id"] for r in out.collect()} == {1, 2}  # too short a series has no frame
    assert out.agg(F.max("x_total_1")).first()[0] < 10  # values of errors don't count


def conversations(spark, ids, turns=4, text="some words, are they?"):
    return spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"{text} " * (1 + (c + t) % 3)) for c in ids for t in range(turns)], "conv_id long, turn long, role string, text string")


def plain(spark, source, width=10, window=3):
    """What one run over everything gives."""
    return rows(conversation_series.series(conversation_series.measures(spark.read.parquet(source), width), window).drop("part"))


HOW = {"width": 10, "window": 3, "files": 2}


def test_series_take_only_what_is_new(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    conversations(spark, range(30)).coalesce(1).write.parquet(source)
    first = conversation_series.run(spark, source, target, **HOW)
    assert first == {"read": 120, "written": 120, "batches": 1} and rows(conversation_series.output(spark, target)) == plain(spark, source)
    held = files(spark, f"{target}/series")
    # new conversations, and late turns of one that is known
    conversations(spark, range(30, 35)).coalesce(1).write.mode("append").parquet(source)
    late = spark.createDataFrame([(15, 4, "user", "late"), (15, 2, "user", "a turn that came again and is longer than it was, by many words and more words")], "conv_id long, turn long, role string, text string")
    late.coalesce(1).write.mode("append").parquet(source)
    second = conversation_series.run(spark, source, target, **HOW)
    assert second["read"] == 22 and second["batches"] == 1 and second["written"] == 20 + 41
    assert rows(conversation_series.output(spark, target)) == plain(spark, source)
    kept = files(spark, f"{target}/series")
    assert {f for f in held if "part=0/" in f or "part=2/" in f} <= kept and not {f for f in held if "part=1/" in f} & kept
    # nothing new: nothing is read or written
    assert conversation_series.run(spark, source, target, **HOW) == {"read": 0, "written": 0, "batches": 0}
    assert files(spark, f"{target}/series") == kept


def test_a_batch_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    """The first try fails once its turns are written; the next run takes the same files again, and none twice."""
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    conversations(spark, range(12)).repartition(3).write.parquet(source)
    own, calls = common.write, []

    def broken(df, path, *a, **b):
        calls.append(path)
        if len(calls) == 4:
            raise RuntimeError("broken off")
        return own(df, path, *a, **b)

    monkeypatch.setattr(common, "write", broken)
    with pytest.raises(Exception, match="broken off"):
        conversation_series.run(spark, source, target, **HOW)
    conversation_series.run(spark, source, target, **HOW)
    assert rows(conversation_series.output(spark, target)) == plain(spark, source)
    assert spark.read.parquet(f"{target}/turns").count() == 48


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    one, two = conversations(spark, range(5)), conversations(spark, range(5), 6, "other")
    got = []
    for k, parts in enumerate(((one, two), (two, one))):
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
            conversation_series.run(spark, f"{tmp_path}/in{k}", f"{tmp_path}/out{k}", **HOW)
        got.append(rows(conversation_series.output(spark, f"{tmp_path}/out{k}")))
    assert got[0] == got[1] and len(got[0]) == 30


def test_series_of_odd_turns(spark, tmp_path):
    odd = [(1, 0, None, None), (1, 1, "user", ""), (None, 0, "user", "x"), (2, None, "user", "x"), (-3, 5, "user", "?" * 70_000), (1, 0, None, None), (4, 0, "user", "a b \n\t c")]
    spark.createDataFrame([(*r, "extra") for r in odd], "conv_id long, turn long, role string, text string, part string").write.parquet(f"{tmp_path}/in")
    conversation_series.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", **HOW)
    got = {(r["conv_id"], r["turn"]): (r["role"], r["n_chars"], r["n_words"], r["n_questions"], r["n_turns"]) for r in conversation_series.output(spark, f"{tmp_path}/out").collect()}
    assert got == {(1, 0): ("", 0, 0, 0, 2), (1, 1): ("user", 0, 0, 0, 2), (-3, 5): ("user", 70_000, 1, 70_000, 1), (4, 0): ("user", 8, 2, 0, 1)}


def test_settings(tmp_path):
    own = tmp_path / "x.toml"
    own.write_text("window = 5\n")
    assert common.settings("conversation_series", str(own))["window"] == 5
    own.write_text("windows = 5\n")
    with pytest.raises(ValueError, match="windows"):
        common.settings("conversation_series", str(own))


def test_command_line(tmp_path):
    """In a process of its own, as the session is made and stopped there."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-m", "jobs.conversation_series", "--source", f"{SF}/conversations.parquet", "--target", str(tmp_path)], cwd=root, env=os.environ | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 536 turns" in done.stderr and "wrote 536 rows of the series" in done.stderr and (tmp_path / "series").is_dir()
