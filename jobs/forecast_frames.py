"""From events to the frames of a forecaster: daily panels, completed calendars, scaling by training days, windows, splits.

    python -m jobs.forecast_frames --source events.parquet --target frames

Writes ``frames`` (by split and part of the entities) and ``scaler`` (what undoes the scaling). A rerun replaces both by the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import calendar, encode, splits, windows
from chronoloom.operators.scale import Scaler

from . import common

NAME = "forecast_frames"
VALUES = ("total", "n")


def panel(events: DataFrame, missing: list[str]) -> DataFrame:
    """(user_id, day, total, n): the sum of values and the number of events of each day from an entity's first to its last.

    Days without events, or without a value, have 0. Events without a user or time belong to no series and go.
    """
    value = F.when(~F.coalesce(F.col("event_type").isin(missing), F.lit(False)), F.col("value"))
    days = events.where("user_id is not null and ts is not null").groupBy("user_id", F.to_date("ts").alias("day"))
    days = days.agg(F.sum(value).cast("double").alias("total"), F.count("*").cast("double").alias("n"))
    return calendar.add_missing_timestamps(days, "day", "D", "user_id", fill_value=0.0)


def frames(days: DataFrame, history: int, horizon: int, valid: int, test: int) -> tuple[DataFrame, DataFrame]:
    """(frames, scaler): a row for each entity and day with full history and horizon, scaled by the days of training alone.

    The history of total and n is x_total_1 (oldest) and so on, total's next days y_1 and so on. Between splits the days whose targets
    would reach into the next are left out.
    """
    training = splits.forecasting_split(days, "day", horizon, valid=valid, test=test)
    model = Scaler(list(VALUES), where="split = 'train'").fit(training)
    pairs = windows.forecasting_pairs(model.transform(days), "day", history, horizon, ids="user_id", x=list(VALUES), y="total")
    pairs = splits.forecasting_split(pairs, "day", horizon, valid=valid, test=test).where("split is not null")
    x = [F.get(f"{c}_x" if c == "total" else c, i).alias(f"x_{c}_{i + 1}") for c in VALUES for i in range(history)]
    y = [F.get("total_y", i).alias(f"y_{i + 1}") for i in range(horizon)] if horizon > 1 else [F.col("total_y").alias("y_1")]
    return pairs.select("user_id", "day", encode.part("day", "weekday").cast("int").alias("weekday"), *x, *y, "split"), model.stats


def run(spark: SparkSession, source: str, target: str, *, history: int, horizon: int, valid: int, test: int, missing: list[str], parts: int, digits: int) -> dict:
    """The job. The numbers of rows read and written."""
    events = spark.read.parquet(source).select("ts", "user_id", "event_type", "value")
    read = events.count()  # from the files' footers
    common.log.info("read %d events of %s", read, source)
    out, stats = frames(panel(events, missing), history, horizon, valid, test)
    out = out.withColumns({c: F.round(c, digits) for c in out.columns if c[:2] in ("x_", "y_")})
    part = F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")
    scaler = common.write(stats, f"{target}/scaler", [], "the scaler")
    written = common.write(out.withColumn("part", part).repartition("split", "part"), f"{target}/frames", ["split", "part"], "frames")
    return {"read": read, "written": written, "scaler": scaler}


def job1_forecast_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of all events, as they stand after a second run into the same folder."""
    target = common.folder(spark, "job1")
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", target, **common.settings(NAME))
    return spark.read.parquet(f"{target}/frames").drop("part").withColumn("split", F.col("split").cast("string"))


def _sql(history: int, horizon: int, valid: int, test: int, missing: list[str], digits: int, **_) -> str:
    gap = horizon - 1
    cells = [f"lag({c}, {history - i}) OVER w AS x_{c}_{i}" for c in VALUES for i in range(1, history + 1)]
    cells += [f"lead(total, {h}) OVER w AS y_{h}" for h in range(1, horizon + 1)]
    names = [f"x_{c}_{i}" for c in VALUES for i in range(1, history + 1)] + [f"y_{h}" for h in range(1, horizon + 1)]
    off = ", ".join(f"'{m}'" for m in missing)
    return f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN coalesce(event_type IN ({off}), false) THEN NULL ELSE value END) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT user_id, min(day) AS lo, max(day) AS hi FROM e GROUP BY 1)),
p AS (SELECT s.user_id, s.day, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM s LEFT JOIN e ON s.user_id = e.user_id AND s.day = e.day),
c AS (SELECT day, row_number() OVER (ORDER BY day) AS code, count(*) OVER () AS k FROM (SELECT DISTINCT day FROM p)),
m AS (SELECT avg(total) AS total_c, stddev_samp(total) + 1e-6 AS total_s, avg(n) AS n_c, stddev_samp(n) + 1e-6 AS n_s FROM p JOIN c USING (day) WHERE code <= k - {test} - {valid} - {2 * gap}),
z AS (SELECT user_id, day, (total - total_c) / total_s AS total, (n - n_c) / n_s AS n FROM p, m),
f AS (SELECT user_id, day, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS rows, {", ".join(cells)} FROM z WINDOW w AS (PARTITION BY user_id ORDER BY day)),
g AS (SELECT * FROM f WHERE rn >= {history} AND rn + {horizon} <= rows),
h AS (SELECT day, row_number() OVER (ORDER BY day) AS code, count(*) OVER () AS k FROM (SELECT DISTINCT day FROM g)),
r AS (SELECT g.*, CASE WHEN code > k - {test} THEN 'test' WHEN code > k - {test} - {gap} - {valid} AND code <= k - {test} - {gap} THEN 'valid' WHEN code <= k - {test} - {valid} - {2 * gap} THEN 'train' END AS split FROM g JOIN h USING (day))
SELECT user_id, day, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS weekday, {", ".join(f"round({x}, {digits}) AS {x}" for x in names)}, split FROM r WHERE split IS NOT NULL"""


JOB1_SQL = _sql(**common.settings(NAME))

if __name__ == "__main__":
    common.main(NAME, run, __doc__.splitlines()[0])
