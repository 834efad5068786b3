"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Events are the panel: an entity is a user, the order is (ts, event_id), and the value of an error event counts as missing.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, augment
from .operators import calendar, encode, epochs, extract, fills, frame, metrics, reshape, scale, splits, windows
from .operators.frame import over
from .operators.scale import QuantileScaler, Scaler, box_cox, clip, clip_outliers, fill_median, signed_log, yeo_johnson
from .sources import series

QUERIES: dict = {}
ORACLES: dict = {}
IDS, ORDER = ["user_id"], ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
EV = "e AS (SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"
DAILY = "d AS (SELECT o_orderpriority AS id, o_orderdate AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)"


def query(sql: str | None = None):
    """Registers a function of (spark, directory), under its name without the leading underscore."""

    def add(f):
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))).select("event_id", "ts", "user_id", "event_type", "value", "v")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("id"), F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded as DuckDB does: the scaled double is, not its shortest decimal form, from which a tie may differ by its last bit."""
    scale = float(10**digits)
    return df.withColumns({c: F.round(F.col(c) * scale) / scale for c, t in df.dtypes if t in ("double", "float")})


def panel():
    """The events' window."""
    return over(IDS, ORDER)


# Windows


@query(f"""WITH a AS (SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m,
    max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x, lead(value) {W} AS y, row_number() {W} AS rn FROM events)
SELECT event_id, user_id, round(m, 6) AS x_mean, x AS x_max, y FROM a WHERE rn >= 4 AND y IS NOT NULL""")
def sliding_window_agg(spark, sf):
    out = windows.window_aggregates(read(spark, sf, "events"), ORDER, "value", 4, ids=IDS, horizon=1, aggregates=("mean", "max"))
    return out.select("event_id", "user_id", F.round("x_mean", 6).alias("x_mean"), "x_max", "y")


@query(f"""WITH {EV}, a AS (SELECT event_id, user_id, list(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x, row_number() {W} AS rn FROM e)
SELECT user_id, event_id, rn - 5 AS "window", len(x) AS n, coalesce(x[1], -1) AS first_x, coalesce(x[5], -1) AS last_x FROM a WHERE rn >= 5""")
def sliding_window_array(spark, sf):
    out = windows.sliding_windows(events(spark, sf), ORDER, "v", 5, ids=IDS)
    return out.select("user_id", "event_id", "window", F.size("v").cast("long").alias("n"), F.coalesce(F.get("v", 0), F.lit(-1.0)).alias("first_x"), F.coalesce(F.get("v", 4), F.lit(-1.0)).alias("last_x"))


def _strided(anchor: str) -> str:
    first = "0" if anchor == "post" else "(n - 2 - 2 - 5) % 3"
    return f"""WITH a AS (SELECT event_id, user_id, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n, lag(value, 4) {W} AS x0, value AS x4, lead(value, 1) {W} AS y1, lead(value, 2) {W} AS y2 FROM events)
SELECT user_id, event_id, (rn - 2 - 5 - {first}) // 3 AS "window", x0, x4, y1, y2 FROM a
WHERE rn - 2 - 5 - {first} >= 0 AND (rn - 2 - 5 - {first}) % 3 = 0 AND rn + 2 <= n AND n - 2 - 2 >= 5"""


def _strided_query(spark, sf, anchor):
    out = windows.sliding_windows(read(spark, sf, "events"), ORDER, "value", 5, ids=IDS, y="value", horizon=2, stride=3, start=2, padding=anchor, y_is_x_checked=False)
    return out.select("user_id", "event_id", "window", F.get("value_x", 0).alias("x0"), F.get("value_x", 4).alias("x4"), F.get("value_y", 0).alias("y1"), F.get("value_y", 1).alias("y2"))


@query(_strided("post"))
def window_stride_start(spark, sf):
    return _strided_query(spark, sf, "post")


@query(_strided("pre"))
def window_stride_start_pre(spark, sf):
    return _strided_query(spark, sf, "pre")


@query(f"""WITH a AS (SELECT event_id, user_id, row_number() {W} AS rn, lag(value, 6) {W} AS a, lag(value, 2) {W} AS b, value AS c, lead(value, 1) {W} AS d, lead(value, 4) {W} AS e, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, a, b, c, d, e FROM a WHERE rn > 6 AND rn + 4 <= n""")
def window_sparse_lags(spark, sf):
    out = windows.sparse_windows(read(spark, sf, "events"), ORDER, "value", [-6, -2, 0], ids=IDS, y="value", horizons=[1, 4])
    return out.select("event_id", "user_id", *[F.get("value_x", i).alias(n) for i, n in enumerate("abc")], F.get("value_y", 0).alias("d"), F.get("value_y", 1).alias("e"))


@query(f"""WITH a AS (SELECT event_id, user_id, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n,
    sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS y FROM events)
SELECT user_id, event_id, round(x, 4) AS x_sum, round(y, 4) AS y_sum FROM a WHERE rn >= 10 AND rn + 5 <= n""")
def multi_horizon_targets(spark, sf):
    out = windows.forecasting_pairs(read(spark, sf, "events"), ORDER, 10, 5, ids=IDS, x="value", y="value")
    return out.select("user_id", "event_id", F.round(arrays.total("value_x"), 4).alias("x_sum"), F.round(arrays.total("value_y"), 4).alias("y_sum"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, 1 + greatest(0, CAST(ceil((n - 1 - 7) / 4.0) AS BIGINT)) AS n_windows, 7 * (1 + greatest(0, CAST(ceil((n - 1 - 7) / 4.0) AS BIGINT))) AS n_steps,
    greatest(0, 7 + 1 + 4 * greatest(0, CAST(ceil((n - 1 - 7) / 4.0) AS BIGINT)) - n - 1) AS n_padded FROM n""")
def window_padded_remainder(spark, sf):
    out = windows.sliding_windows(read(spark, sf, "events"), ORDER, "value", 7, ids=IDS, y="event_type", horizon=1, stride=4, pad_remainder=True, y_is_x_checked=False)
    flags = F.aggregate("padding_flag", F.lit(0).cast("long"), lambda a, e: a + e)
    return out.groupBy("user_id").agg(F.count("*").alias("n_windows"), F.sum(F.size("value")).alias("n_steps"), F.sum(flags).alias("n_padded"))


@query(f"""WITH a AS (SELECT event_id, user_id, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, rn - 1 AS position FROM a WHERE rn >= 6 AND rn + 3 <= n AND (n - 3 - rn) % 4 = 0""")
def usable_anchors(spark, sf):
    return windows.usable_anchors(read(spark, sf, "events"), ORDER, 6, 3, ids=IDS, stride=4).select("event_id", "user_id", "position")


@query("""SELECT 'click' AS source, CAST(0 AS BIGINT) AS source_no, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS source_row FROM events WHERE event_type = 'click'
UNION ALL SELECT 'view', 1, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 FROM events WHERE event_type = 'view'""")
def meta_union(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", "event_type")
    out = windows.union_sources({k: e.where(F.col("event_type") == k) for k in ("click", "view")}, ["ts", "event_id"])
    return out.select("source", "source_no", "event_id", "source_row")


# Duplicates, calendars, fills


@query("SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def dedup_keep_last(spark, sf):
    return fills.drop_duplicates(read(spark, sf, "orders"), ["o_custkey", "o_orderdate"], "o_orderkey", "last").select("o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def dedup_keep_first(spark, sf):
    return fills.drop_duplicates(read(spark, sf, "orders"), ["o_custkey", "o_orderdate"], "o_orderkey", "first").select("o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2 HAVING count(*) = 1")
def dedup_keep_none(spark, sf):
    return fills.drop_duplicates(read(spark, sf, "orders"), ["o_custkey", "o_orderdate"], "o_orderkey", False).select("o_custkey", "o_orderdate", "o_orderkey")


@query(f"""WITH {DAILY}, b AS (SELECT id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), s AS (SELECT id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b)
SELECT s.id, s.day, round(coalesce(total, -1), 4) AS total FROM s LEFT JOIN d ON s.id = d.id AND s.day = d.day""")
def add_missing_timestamps_by_id(spark, sf):
    return rounded(calendar.add_missing_timestamps(daily(spark, sf), "day", "D", "id", fill_value=-1), 4)


@query(f"""WITH {DAILY}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), i AS (SELECT DISTINCT id FROM d), s AS (SELECT id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b, i)
SELECT s.id, s.day, round(coalesce(total, -1), 4) AS total FROM s LEFT JOIN d ON s.id = d.id AND s.day = d.day""")
def add_missing_timestamps_global(spark, sf):
    return rounded(calendar.add_missing_timestamps(daily(spark, sf), "day", "D", "id", range_by_group=False, fill_value=-1), 4)


@query(f"""WITH {DAILY}, b AS (SELECT id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), s AS (SELECT id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b),
j AS (SELECT s.id, s.day, total FROM s LEFT JOIN d ON s.id = d.id AND s.day = d.day)
SELECT id, day, round(last_value(total IGNORE NULLS) OVER (PARTITION BY id ORDER BY day), 4) AS total FROM j""")
def asfreq_ffill(spark, sf):
    return rounded(calendar.prepare(daily(spark, sf), "day", "1D", ids="id", method="ffill", columns="total"), 4)


def _fill_query(kind):
    return lambda spark, sf: events(spark, sf).select("event_id", {"ffill": fills.ffill, "bfill": fills.bfill, "fbfill": fills.fbfill}[kind]("v", panel()).alias("v"))


FF = "last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BF = "first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
for _kind, _sql in (("ffill", FF), ("bfill", BF), ("fbfill", f"coalesce({FF}, {BF})")):
    QUERIES[_kind] = _fill_query(_kind)
    ORACLES[_kind] = f"WITH {EV} SELECT event_id, {_sql} AS v FROM e"


@query(f"WITH {EV} SELECT event_id, user_id, coalesce({FF}, 0) AS v FROM e")
def fill_missing_value(spark, sf):
    return fills.fill_missing(events(spark, sf), "v", ORDER, IDS).select("event_id", "user_id", "v")


@query(f"""WITH {EV}, r AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e),
g AS (SELECT event_id, rn - coalesce(max(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
    coalesce(min(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1) - rn AS b FROM r)
SELECT event_id, f AS v_dt_fwd, b AS v_dt_bwd, least(f, b) AS v_dt_nearest FROM g""")
def gap_columns(spark, sf):
    return fills.gaps(events(spark, sf), "v", ORDER, IDS).select("event_id", "v_dt_fwd", "v_dt_bwd", "v_dt_nearest")


@query(f"WITH {EV} SELECT event_id, round(avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS v FROM e")
def rolling_mean(spark, sf):
    return events(spark, sf).select("event_id", F.round(fills.rolling_mean("v", panel(), 5), 6).alias("v"))


@query(f"SELECT event_id, round(coalesce(value - lag(value, 2) {W}, 0), 6) AS d, round(coalesce(ln(value) - ln(lag(value) {W}), 0), 6) AS r FROM events WHERE value > 0")
def diff_and_log_return(spark, sf):
    return rounded(read(spark, sf, "events").where("value > 0").select("event_id", fills.diff("value", panel(), 2).alias("d"), fills.log_return("value", panel()).alias("r")))


@query(f"""WITH r AS (SELECT event_id, user_id, ts, value, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT r.event_id, r.value, k.k, q.value AS x FROM r, range(-2, 3) k(k) JOIN r q ON q.user_id = r.user_id AND q.rn = least(greatest(r.rn + k.k, 1), r.n))
SELECT event_id, round(avg(x), 6) AS value_trend, round(any_value(value) - avg(x), 6) AS value_residual FROM p GROUP BY event_id""")
def moving_avg_decompose(spark, sf):
    return rounded(fills.decompose(read(spark, sf, "events"), "value", ORDER, IDS, 5).select("event_id", "value_trend", "value_residual"))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() {W} AS rn FROM e),
k AS (SELECT event_id, v, rn, max(CASE WHEN v IS NOT NULL THEN rn END) {W} AS p, min(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q, {FF} AS a, {BF} AS b FROM r)
SELECT event_id, round(coalesce(v, CASE WHEN p IS NULL THEN b WHEN q IS NULL THEN a ELSE a + (b - a) * (rn - p) / (q - p) END, 0), 6) AS v FROM k""")
def interpolate(spark, sf):
    return rounded(fills.interpolate(events(spark, sf), "v", ORDER, IDS).select("event_id", "v"))


@query("SELECT event_id, round((value - avg(value) OVER u) / sqrt(var_pop(value) OVER u + 1e-5), 6) AS value FROM events WINDOW u AS (PARTITION BY user_id)")
def rev_in(spark, sf):
    return rounded(fills.rev_in(read(spark, sf, "events"), "value", IDS).select("event_id", "value"))


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-10 12:00:00'")
def filter_by_datetime(spark, sf):
    return calendar.filter_by_time(read(spark, sf, "events"), "ts", "2024-01-03", "2024-01-10 12:00:00").select("event_id", "ts", "value")


@query("SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1")
def datetime_bounds(spark, sf):
    return calendar.bounds(read(spark, sf, "events"), "ts", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-12'")
def forecast_rows(spark, sf):
    return calendar.forecast_rows(read(spark, sf, "events"), "ts", ("2024-01-08", "2024-01-10"), 5, 2, "D").select("event_id", "ts")


# Encodings


@query("""SELECT o_orderkey, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month, weekofyear(o_orderdate) AS d_week, day(o_orderdate) AS d_day, isodow(o_orderdate) - 1 AS d_dayofweek, dayofyear(o_orderdate) AS d_dayofyear,
    CAST(o_orderdate = last_day(o_orderdate) AS BIGINT) AS d_is_month_end, CAST(day(o_orderdate) = 1 AS BIGINT) AS d_is_month_start,
    CAST(o_orderdate = date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS BIGINT) AS d_is_quarter_end, CAST(o_orderdate = date_trunc('quarter', o_orderdate) AS BIGINT) AS d_is_quarter_start,
    CAST(month(o_orderdate) = 12 AND day(o_orderdate) = 31 AS BIGINT) AS d_is_year_end, CAST(dayofyear(o_orderdate) = 1 AS BIGINT) AS d_is_year_start FROM orders""")
def datetime_parts(spark, sf):
    out = encode.date_parts(read(spark, sf, "orders"), "o_orderdate", "d_")
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("d_")])


@query("""SELECT event_id, round(sin((isodow(ts) - 1) * (2 * pi()) / 7), 6) AS dow_sin, round(cos((isodow(ts) - 1) * (2 * pi()) / 7), 6) AS dow_cos, round(sin(hour(ts) * (2 * pi()) / 24), 6) AS hour_sin,
    round(cos(dayofyear(ts) * (2 * pi()) / 366), 6) AS doy_cos, microsecond(ts) % 1000000 AS us, (microsecond(ts) % 1000000) // 1000 AS ms, year(ts) % 10 AS y FROM events""")
def time_encoding(spark, sf):
    dow, hour, doy = (encode.time_encoding("ts", n) for n in ("weekday", "hour", "dayofyear"))
    return rounded(read(spark, sf, "events").select("event_id", dow[0].alias("dow_sin"), dow[1].alias("dow_cos"), hour[0].alias("hour_sin"), doy[1].alias("doy_cos"), encode.part("ts", "microsecond").alias("us"), encode.part("ts", "millisecond").alias("ms"), encode.part("ts", "year").alias("y")))


@query("SELECT o_orderkey, datediff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS steps FROM orders")
def steps_since_start(spark, sf):
    df, _ = encode.steps_since(read(spark, sf, "orders"), "o_orderdate", "D", name="steps")
    return df.select("o_orderkey", "steps")


@query(f"""WITH r AS (SELECT event_id, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, round(sin(2 * pi() * i / n), 6) + 0.0 AS pos_sin, round(cos(2 * pi() * i / n), 6) + 0.0 AS pos_cos, round(CASE WHEN n > 1 THEN -1 + 2 * i / (n - 1) ELSE -1 END, 6) AS pos_linear FROM r""")
def positions(spark, sf):
    df = encode.positions(encode.positions(read(spark, sf, "events"), ORDER, IDS), ORDER, IDS, linear=True)
    return rounded(df.select("event_id", "pos_sin", "pos_cos", "pos_linear"))


@query("SELECT event_id, CAST(event_type = 'click' AS TINYINT) AS event_type_click, CAST(event_type = 'error' AS TINYINT) AS event_type_error, CAST(event_type = 'view' AS TINYINT) AS event_type_view FROM events")
def one_hot(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type")
    return encode.OneHotEncoder("event_type").fit(e).transform(e).select("event_id", "event_type_click", "event_type_error", "event_type_view")


@query("""WITH c AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 10 < 8 AND o_orderpriority <> '5-LOW'))
SELECT o_orderkey, coalesce(code, 0) AS code FROM orders LEFT JOIN c ON p = o_orderpriority""")
def ordinal_encode(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    model = encode.OrdinalEncoder("o_orderpriority", suffix="_code").fit(o.where("o_orderkey % 10 < 8 and o_orderpriority <> '5-LOW'"))
    return model.transform(o).select("o_orderkey", F.col("o_orderpriority_code").alias("code"))


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) AS m FROM part WHERE p_partkey % 3 > 0 GROUP BY 1) SELECT p_partkey, round(m, 6) AS p_brand_mean FROM part LEFT JOIN m USING (p_brand)""")
def target_encode(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    model = encode.TargetEncoder("p_retailprice", "p_brand", "_mean").fit(p.where("p_partkey % 3 > 0"))
    return rounded(model.transform(p).select("p_partkey", "p_brand_mean"))


@query(f"WITH {EV} SELECT event_id, CAST(v IS NULL AS SMALLINT) AS v_missing FROM e")
def missingness_flags(spark, sf):
    return encode.missing_flags(events(spark, sf), "v").select("event_id", "v_missing")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 40) AND NOT (l_discount > 0.08)")
def drop_if_true(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 40).cast("int").alias("a"), (F.col("l_discount") > 0.08).cast("int").alias("b"))
    return encode.drop_if_true(df, ["a", "b"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def relabel(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", encode.relabel("o_orderstatus", {"F": "final", "O": "open"}).alias("status"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT p_partkey, p_size % 10 / 10 AS last_digit FROM part")
def number_digits(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.get(encode.digits("p_size", 3), 2).alias("last_digit"))


# Scales


def _global(center: str, scale: str, value: str = "value") -> str:
    return f"WITH s AS (SELECT {center} AS c, {scale} AS k FROM events WHERE event_id % 5 < 4) SELECT event_id, round(({value} - c) / k, 6) AS value FROM events, s"


def _scaled(kind, **how):
    def run(spark, sf):
        e = read(spark, sf, "events").select("event_id", "user_id", "value")
        return rounded(Scaler("value", kind, where="event_id % 5 < 4", **how).fit(e).transform(e).select("event_id", "value"))

    return run


for _name, _kind, _sql in (
    ("standard_scale", "standard", _global("avg(value)", "stddev_samp(value) + 1e-6")),
    ("robust_scale", "robust", _global("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25) + 1e-6")),
    ("fence_scale", "fence", _global("quantile_cont(value, 0.5)", "greatest(4 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 1e-6)")),
    ("minmax_scale", "minmax", _global("min(value) + (max(value) - min(value)) / 2", "(max(value) - min(value)) / 2")),
):
    QUERIES[_name], ORACLES[_name] = _scaled(_kind), _sql


@query("""SELECT event_id, round((value - avg(value) OVER u) / greatest(stddev_samp(value) OVER u, 1e-8), 6) AS value FROM events WINDOW u AS (PARTITION BY user_id)""")
def per_id_standardize(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "value")
    return rounded(Scaler("value", "clamped", ids="user_id", eps=1e-8).fit(e).transform(e).select("event_id", "value"))


@query("SELECT event_id, round(value, 6) AS value FROM events")
def scale_round_trip(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "value")
    model = Scaler("value", "robust", ids="user_id").fit(e)
    return rounded(model.inverse(model.transform(e)).select("event_id", "value"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value FROM events, q""")
def clip_iqr(spark, sf):
    return rounded(clip_outliers(read(spark, sf, "events").select("event_id", "value"), "value"))


@query(f"WITH {EV}, m AS (SELECT user_id, quantile_disc(v, 0.5) AS m FROM e GROUP BY 1) SELECT event_id, coalesce(v, m) AS v FROM e JOIN m USING (user_id)")
def nan_to_median(spark, sf):
    return fill_median(events(spark, sf).select("event_id", "user_id", "v"), "v", "user_id").select("event_id", "v")


def _horner(of, x):
    out = str(of[0])
    for c in of[1:]:
        out = f"({out} * {x} + {c})"
    return out


_SHARE = "0.5 + exp(-{0} * {0} / 2) / sqrt(2 * pi()) * {0} * list_reduce(list_prepend(1.0::DOUBLE, [(2 * k + 1)::DOUBLE FOR k IN range(80, 0, -1)]), lambda a, d: {0} * {0} / d * a + 1)"


@query(f"""WITH q AS (SELECT quantile_cont(o_totalprice::DOUBLE, [i / 100 FOR i IN range(101)]) AS q FROM orders WHERE o_orderkey % 5 < 4), n AS (SELECT o_orderkey, o_totalprice::DOUBLE AS x, q, len(list_filter(q, lambda e: e <= x)) AS j, len(list_filter(q, lambda e: e < x)) AS i FROM orders, q),
s AS (SELECT o_orderkey, CASE WHEN x <= q[1] THEN 0.0 WHEN x >= q[101] THEN 1.0 ELSE ((j - 1 + (x - q[j]) / (q[j + 1] - q[j])) + (i - 1 + (x - q[i]) / (q[i + 1] - q[i]))) / 200 END AS share, greatest(q[1], least(q[101], x)) AS back FROM n),
p AS (SELECT *, greatest(1e-7, least(1 - 1e-7, share)) AS p, sqrt(-2 * ln(least(p, 1 - p))) AS r, p - 0.5 AS m FROM s),
z AS (SELECT *, {_horner(scale._TAIL, "r")} / {_horner(scale._TAIL_BELOW, "r")} AS t, CASE WHEN p < 0.02425 THEN t WHEN p > 1 - 0.02425 THEN -t ELSE {_horner(scale._CENTRE, "(m * m)")} * m / {_horner(scale._CENTRE_BELOW, "(m * m)")} END AS z FROM p)
SELECT o_orderkey, round(z - ({_SHARE.format("z")} - p) * sqrt(2 * pi()) * exp(z * z / 2), 6) AS z, round(back, 2) AS back FROM z""")  # fmt: skip
def quantile_normal(spark, sf):
    """Prices to a normal distribution, fitted on four fifths of the orders, and back."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("z"))
    model = QuantileScaler("z", 100, where="o_orderkey % 5 < 4").fit(o)
    z = model.transform(o).withColumn("back", F.col("z"))
    back = model.inverse(z.select("o_orderkey", F.col("back").alias("z"))).select("o_orderkey", F.round("z", 2).alias("back"))
    return z.drop("back").withColumn("z", F.round("z", 6)).join(back, "o_orderkey")


@query("""WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.9) AS b, quantile_disc(l_extendedprice, 0.5) AS d FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(a, 4) AS a, round(m, 4) AS m, round(b, 4) AS b, round(CAST(d AS DOUBLE), 4) AS d FROM q""")
def grouped_quantiles(spark, sf):
    """Exact quantiles of few groups with very many rows each."""
    items, ids = read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]
    q = frame.quantiles(items, "l_extendedprice", [0.1, 0.5, 0.9, 0.5], ids, lower=[False, False, False, True])
    return q.select(*ids, *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate("ambd")])


@query("SELECT event_id, round(sign(value - 10) * ln(1 + abs(value - 10)), 6) AS l, round(CASE WHEN value - 10 >= 0 THEN (pow(value - 9, 0.5) - 1) / 0.5 ELSE -(pow(11 - value, 1.5) - 1) / 1.5 END, 6) AS y, round((pow(value + 1, 0.3) - 1) / 0.3, 6) AS b, greatest(least(value, 6.0), 2.0) AS c FROM events")
def value_transforms(spark, sf):
    e = read(spark, sf, "events").withColumns({"d": F.col("value") - 10, "u": F.col("value") + 1})
    return e.select("event_id", F.round(signed_log("d"), 6).alias("l"), F.round(yeo_johnson("d", 0.5), 6).alias("y"), F.round(box_cox("u", 0.3), 6).alias("b"), clip("value", 2.0, 6.0).alias("c"))


# Splits


@query(f"""WITH r AS (SELECT event_id, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT *, n - CAST(round(n * 0.2) AS INT) AS last, n - CAST(round(n * 0.2) AS INT) - CAST(round(n * 0.1) AS INT) AS f FROM r)
SELECT event_id, CASE WHEN rn > last THEN 'test' WHEN rn > f AND rn <= last - 2 THEN 'valid' WHEN rn <= f - 2 THEN 'train' END AS split FROM b""")
def ts_split(spark, sf):
    return splits.ordered_split(read(spark, sf, "events"), ORDER, IDS, valid=0.1, test=0.2, horizon=3).select("event_id", "split")


@query("""WITH d AS (SELECT o_orderdate AS day, count(*) AS n_orders FROM orders GROUP BY 1), r AS (SELECT day, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM d),
f AS (SELECT day, rn, n, fold, n - (2 - fold) * 150 AS e FROM r, range(3) t(fold))
SELECT day, fold, CASE WHEN rn > e - 50 AND rn <= e THEN 'test' WHEN rn > e - 150 AND rn <= e - 50 THEN 'valid' ELSE 'train' END AS split FROM f WHERE rn <= e AND (rn > e - 150 OR rn <= e - 150 - 10)""")
def walk_forward(spark, sf):
    days = read(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    return splits.walk_forward(days, "day", 3, valid=100, test=50, gap=10).select("day", "fold", "split")


@query("""WITH a AS (SELECT DISTINCT o_orderdate AS day FROM orders), c AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM a),
b AS (SELECT day, k, n - CAST(round(n * 0.2) AS INT) + 1 AS t, n - CAST(round(n * 0.2) AS INT) + 1 - 4 - CAST(round(n * 0.1) AS INT) AS v FROM c)
SELECT o_orderkey, CASE WHEN k >= t THEN 'test' WHEN k >= v AND k <= t - 5 THEN 'valid' WHEN k <= v - 5 THEN 'train' END AS split FROM orders JOIN b ON o_orderdate = day""")
def forecasting_split(spark, sf):
    return splits.forecasting_split(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 5, valid=0.1, test=0.2).select("o_orderkey", "split")


@query("""WITH d AS (SELECT DISTINCT o_orderdate AS day FROM orders), r AS (SELECT day, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM d),
b AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS a, n - CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS z FROM r)
SELECT day, 'train' AS split FROM b WHERE rn >= 30 AND rn + 7 <= a UNION ALL SELECT day, 'valid' FROM b WHERE rn - 30 >= a - 30 AND rn + 7 <= z UNION ALL SELECT day, 'test' FROM b WHERE rn - 30 >= z - 30 AND rn + 7 <= n""")
def long_term_split(spark, sf):
    days = read(spark, sf, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    return splits.long_term_split(days, "day", 30, 7).select("day", "split")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS split FROM orders")
def predefined_split(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return splits.predefined_split({"train": o.where(F.col("o_orderdate") < cut), "test": o.where(F.col("o_orderdate") >= cut)}).select("o_orderkey", "split")


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS split FROM orders) SELECT o_custkey, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leakage_check(spark, sf):
    s = read(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "train").otherwise("test").alias("split"))
    return splits.overlap(s, "o_custkey").select("o_custkey", F.size("splits").cast("long").alias("n_splits"))


@query("SELECT event_type, count(*) AS n, round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 6) AS weight FROM events GROUP BY 1")
def class_weights(spark, sf):
    return rounded(splits.class_weights(read(spark, sf, "events"), "event_type"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, (SELECT max(n) FROM c) AS n FROM c")
def balance_oversample(spark, sf):
    return splits.balance(read(spark, sf, "events"), "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, CAST(round(n * 0.2) AS BIGINT) AS n_valid, n - CAST(round(n * 0.2) AS BIGINT) AS n_train FROM c")
def stratified_split(spark, sf):
    s = splits.random_split(read(spark, sf, "events"), "event_id", valid=0.2, seed=7, stratify="event_type")
    return s.groupBy("event_type").agg(metrics.count_if(F.col("split") == "valid").alias("n_valid"), metrics.count_if(F.col("split") == "train").alias("n_train"))


@query(f"""WITH a AS (SELECT event_id, user_id, value, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT *, rn <= CAST(round(n * 0.8) AS INT) AS train FROM a)
SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM t WHERE train GROUP BY 1""")
def fcst_stats(spark, sf):
    s = splits.ordered_split(read(spark, sf, "events"), ORDER, IDS, valid=0.2).where("split = 'train'")
    return rounded(s.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")))


# Metrics

SCORE = "s AS (SELECT d.doc_id, quality, toxic, least(n_chars / 4000.0, 1.0) AS p FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, sf):
    d, lab = read(spark, sf, "documents").select("doc_id", "n_chars"), read(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "quality", "toxic", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p"))


@query(f"WITH {SCORE} SELECT quality AS actual, CAST(p > 0.3 AS INT) AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM s GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return rounded(metrics.confusion(scored(spark, sf).withColumn("c", (F.col("p") > 0.3).cast("int")), "quality", "c", normalize=True))


@query(f"""WITH {SCORE}, c AS (SELECT CAST(count(*) FILTER (p > 0.3 AND quality = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p <= 0.3 AND quality = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (p > 0.3 AND quality = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (p <= 0.3 AND quality = 1) AS DOUBLE) AS fn FROM s)
SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
    round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f_beta, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(scored(spark, sf), "p", "quality", 0.3))


@query(f"""WITH {SCORE}, x AS (SELECT p > 0.3 AS a, quality = 1 AS b FROM s UNION ALL SELECT p > 0.3, toxic = 1 FROM s), c AS (SELECT CAST(count(*) FILTER (a AND b) AS DOUBLE) AS tp, CAST(count(*) FILTER (a AND NOT b) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT a AND b) AS DOUBLE) AS fn FROM x)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f_beta FROM c""")
def multilabel_metrics(spark, sf):
    df = scored(spark, sf).select(F.array("p", "p").alias("s"), F.array("quality", "toxic").alias("a"))
    return rounded(metrics.multilabel_metrics(df, "s", "a", 0.3, beta=2.0).select("precision", "recall", "f_beta"))


@query(f"""WITH {SCORE} SELECT round(avg(abs(p - quality)), 6) AS mae, round(avg((p - quality) * (p - quality)), 6) AS mse, round(avg(abs(p - quality) / greatest(p, 1e-8)), 6) AS mape, round(avg(CASE WHEN abs(p - quality) < 0.5 THEN 0.5 * (p - quality) * (p - quality) ELSE 0.5 * (abs(p - quality) - 0.25) END), 6) AS huber,
    round(avg(ln(cosh(p - quality))), 6) AS log_cosh, round(avg(-quality * pow(greatest(p, 1e-8), -0.5) / -0.5 + pow(greatest(p, 1e-8), 0.5) / 0.5), 6) AS tweedie FROM s""")
def regression_losses(spark, sf):
    q = F.col("quality").cast("double")
    return rounded(scored(spark, sf).agg(metrics.mae("p", q).alias("mae"), metrics.mse("p", q).alias("mse"), metrics.mape(q, "p").alias("mape"), metrics.huber("p", q, 0.5).alias("huber"), metrics.log_cosh("p", q).alias("log_cosh"), metrics.tweedie("p", q).alias("tweedie")))


@query(f"""WITH {SCORE}, b AS (SELECT ceil(p * 10) AS b, count(*) AS n, avg(p) AS c, avg(quality) AS a FROM s WHERE p > 0 GROUP BY 1) SELECT round(sum(n * abs(c - a)) / (SELECT count(*) FROM s), 6) AS ece FROM b""")
def ece(spark, sf):
    return rounded(metrics.expected_calibration_error(scored(spark, sf), "p", "quality"))


@query(f"WITH {SCORE}, t AS (SELECT * FROM s ORDER BY p DESC, doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1 + 1e-9) AS BIGINT)) FROM s)) SELECT round((SELECT avg(quality) FROM t) / avg(quality), 6) AS lift FROM s")
def lift_topk(spark, sf):
    return rounded(metrics.top_share_lift(scored(spark, sf), "p", "quality", 0.1, "doc_id"))


@query(f"""WITH {SCORE}, k AS (SELECT greatest(1, CAST(floor(count(*) * (1 - 0.9) + 1e-9) AS BIGINT)) AS k FROM s WHERE quality = 0), t AS (SELECT p AS t FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn FROM s WHERE quality = 0), k WHERE rn = k)
SELECT round(count(*) FILTER (p > t AND quality = 1) / count(*) FILTER (quality = 1), 6) AS recall FROM s, t""")
def recall_at_specificity(spark, sf):
    return rounded(metrics.recall_at_specificity(scored(spark, sf), "p", "quality", 0.9))


@query(f"""WITH {SCORE}, g AS (SELECT p, sum(quality) AS h, count(*) AS m FROM s GROUP BY 1), c AS (SELECT h, sum(h) OVER (ORDER BY p DESC) AS tp, sum(m) OVER (ORDER BY p DESC) AS k FROM g) SELECT round(sum(h * tp / k) / sum(h), 6) AS ap FROM c""")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(scored(spark, sf), "p", "quality"))


@query("""WITH x AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z, label AS t FROM embeddings), l AS (SELECT z[t + 1] - ln(list_sum(list_transform(z, lambda v: exp(v)))) AS lp FROM x) SELECT round(avg(-pow(1 - exp(lp), 2) * lp), 6) AS focal FROM l""")
def focal_loss(spark, sf):
    z = read(spark, sf, "embeddings").select(F.col("label").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("z"))
    return rounded(z.agg(metrics.focal("z", "t").alias("focal")))


@query(f"WITH f AS (SELECT value, lag(value, 2) {W} AS p FROM events) SELECT round(avg(abs(value - p)), 6) AS mae FROM f")
def naive_forecast_error(spark, sf):
    f = metrics.naive_forecast(read(spark, sf, "events"), "value", ORDER, IDS, 2)
    return rounded(f.agg(metrics.mae("forecast", "value").alias("mae")))


@query(f"""WITH {SCORE}, r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS b FROM s) SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, sf):
    return rounded(metrics.spearman(scored(spark, sf), "p", "quality"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(sqrt(count(l_tax)) * avg(l_tax) / stddev_samp(l_tax), 6) AS t FROM lineitem")
def pearson_t_score(spark, sf):
    return rounded(read(spark, sf, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), metrics.t_score("l_tax").alias("t")))


@query("""WITH l AS (SELECT 'l_quantity' AS variable, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem), q AS (SELECT variable, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1)
SELECT q.variable, any_value(n) AS n, round(any_value(mean), 4) AS mean, round(any_value(std), 4) AS std, round(any_value(m), 4) AS p50, round(any_value(a - 1.5 * (b - a)), 4) AS lower, round(any_value(b + 1.5 * (b - a)), 4) AS upper, round(avg(CAST(v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS INT)), 6) AS outlier_share FROM l JOIN q USING (variable) GROUP BY q.variable""")
def feature_profile(spark, sf):
    p = metrics.profile(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return p.select("variable", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p50", "lower", "upper")], F.round("outlier_share", 6).alias("outlier_share"))


@query("""SELECT user_id, round(sum(value), 4) AS sum_values, round(median(value), 6) AS median, round(avg(value), 6) AS mean, count(*) AS length, round(stddev_pop(value), 6) AS standard_deviation, round(var_pop(value), 4) AS variance, round(sqrt(avg(value * value)), 6) AS root_mean_square, max(value) AS maximum, max(abs(value)) AS absolute_maximum, min(value) AS minimum FROM events GROUP BY 1""")
def minimal_features(spark, sf):
    m = metrics.minimal_features(read(spark, sf, "events"), "value", "user_id")
    digits = {"sum_values": 4, "variance": 4}
    return m.withColumns({c: F.round(c, digits.get(c, 6)) for c, t in m.dtypes if t == "double" and c not in ("maximum", "absolute_maximum", "minimum")})


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_id, CASE WHEN value = hi THEN 20 ELSE CAST(floor((value - lo) / (hi - lo) * 20) AS INT) + 1 END AS b FROM events, e), c AS (SELECT b, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT c.b, any_value(c.n) AS n, sum(o.n * exp(-(o.b - c.b) * (o.b - c.b) / 2.0)) AS s FROM c JOIN c o ON abs(o.b - c.b) <= 2 GROUP BY 1), m AS (SELECT sum(n / s) / sum(n) AS m FROM s)
SELECT event_id, round(1 / s / m, 6) AS lds_weight FROM b JOIN s USING (b), m""")
def lds_weights(spark, sf):
    out = metrics.label_distribution_weights(read(spark, sf, "events"), "value", 20, kernel=[math.exp(-d * d / 2) for d in range(-2, 3)])
    return rounded(out.select("event_id", "lds_weight"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_id, CASE WHEN value = hi THEN 20 ELSE CAST(floor((value - lo) / (hi - lo) * 20) AS INT) + 1 END AS b FROM events, e), c AS (SELECT b, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT c.b, any_value(c.n) AS n, sum(o.n * CASE abs(o.b - c.b) WHEN 0 THEN 1 WHEN 1 THEN exp(-0.5) + exp(-8) ELSE exp(-2) + exp(-4.5) END) AS s FROM c JOIN c o ON abs(o.b - c.b) <= 2 GROUP BY 1), m AS (SELECT sum(n / s) / sum(n) AS m FROM s)
SELECT event_id, round(1 / s / m, 6) AS lds_weight FROM b JOIN s USING (b), m""")
def lds_weights_reflected(spark, sf):
    out = metrics.label_distribution_weights(read(spark, sf, "events"), "value", 20, kernel=metrics.kernel_window("gaussian", 5, 1.0))
    return rounded(out.select("event_id", "lds_weight"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 9")
def top_losses(spark, sf):
    return metrics.top_losses(read(spark, sf, "events"), "value", 9, tie="event_id").select("event_id", "value")


# Arrays

EMB = "SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings"


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _array(name, expr, sql):
    QUERIES[name] = lambda spark, sf: vectors(spark, sf).select("vec_id", expr(F.col("x")))
    ORACLES[name] = f"WITH v AS ({EMB}) SELECT vec_id, {sql} FROM v"


_array("array_resample", lambda x: F.round(arrays.total(arrays.resample(x, 96)), 6).alias("s"), "round(list_sum(list_transform(range(96), lambda i: x[CAST(floor(i * len(x) / 96) AS INT) + 1])), 6) AS s")
_array("blur_smooth", lambda x: F.round(F.get(arrays.blur(x), 0) + F.get(arrays.smooth(x), 63) + F.get(arrays.blur(x), 7), 6).alias("s"), "round((x[1] + x[2]) / 2 + (x[63] + 5 * x[64] + x[64]) / 7 + (x[7] + x[9]) / 2, 6) AS s")
_array("array_padding", lambda x: F.round(arrays.total(arrays.pad(x, 68, 1.0)) + arrays.total(arrays.pad(x, 5)), 6).alias("s"), "round(list_sum(x) + 4 + list_sum(x[60:64]), 6) AS s")
_array("array_roll", lambda x: F.round(F.get(arrays.roll(x, 3), 0) * 2 + F.get(arrays.roll(x, -2), 63), 6).alias("s"), "round(x[62] * 2 + x[2], 6) AS s")
_array("patches", lambda x: F.round(arrays.total(arrays.patches(x, 6, 4, reduce="max")), 6).alias("s"), "round(greatest(0, list_max(x[1:4])) + list_sum(list_transform(range(15), lambda i: list_max(x[4 * i + 3:4 * i + 8]))), 6) AS s")
_array("gramian_field", lambda x: F.round(arrays.total(F.flatten(arrays.gramian(arrays.rescaled(x)))), 4).alias("s"), "round(list_sum(list_transform(list_transform(x, lambda e: -1 + 2 * (e - list_min(x)) / (list_max(x) - list_min(x))), lambda e: e)) ** 2 - list_sum(list_transform(list_transform(x, lambda e: -1 + 2 * (e - list_min(x)) / (list_max(x) - list_min(x))), lambda e: sqrt(greatest(0, 1 - e * e)))) ** 2, 4) AS s")
_array("recurrence_plot", lambda x: F.round(arrays.total(F.flatten(arrays.recurrence(x))), 6).alias("s"), "round(list_sum(list_transform(x, lambda a: list_sum(list_transform(x, lambda b: abs(a - b))))), 6) AS s")
_array("explode_arrays", lambda x: F.inline(F.transform(x, lambda v, i: F.struct(i.cast("long").alias("step"), v.alias("v")))), "unnest(range(len(x))) AS step, unnest(x) AS v")


@query(f"""WITH v AS ({EMB}) SELECT l.vec_id, l.x[1] AS a, r.x[2] AS b FROM v l JOIN v r USING (vec_id)""")
def mixed_join(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.get("x", 0).alias("a")).join(v.select("vec_id", F.get("x", 1).alias("b")), "vec_id")


def _order_sum(x):
    """Elements times their places from 1: no two orders of an array are likely to agree."""
    return F.round(arrays.total(F.transform(x, lambda e, i: e * (i + 1))), 6).alias("s")


def _ordered(places: int, element: str) -> str:
    return f"round(list_sum(list_transform(range(1, {places + 1}), lambda i: i * ({element}))), 6) AS s"


_array("horizontal_flip", lambda x: _order_sum(augment.horizontal_flip(x)), _ordered(64, "x[65 - i]"))
_array("vertical_flip", lambda x: _order_sum(augment.vertical_flip(x)), _ordered(64, "-x[i]"))
_array("resized_by_factor", lambda x: _order_sum(augment.resize(x, 1.5)), _ordered(96, "x[(i - 1) * 64 // 96 + 1]"))
_array("down_up_sample", lambda x: _order_sum(augment.down_up(x, 0.5)), _ordered(64, "x[(i - 1) // 2 * 2 + 1]"))
_array("masked_steps", lambda x: _order_sum(augment.masked(x, F.transform(x, lambda e: e < 0), 0.25)), _ordered(64, "CASE WHEN x[i] < 0 THEN 0.25 ELSE x[i] END"))
_array("patch_means", lambda x: _order_sum(arrays.patches(x, 8, reduce="mean")), _ordered(8, "list_avg(x[8 * i - 7:8 * i])"))
_array("patch_minima", lambda x: _order_sum(arrays.patches(x, 8, 4, reduce="min", pad_before=False, value=9.0)), _ordered(15, "list_min(x[4 * i - 3:4 * i + 4])"))
_array("take_steps", lambda x: _order_sum(arrays.take(x, [0, 5, -1])), "round(x[1] + 2 * x[6] + 3 * x[64], 6) AS s")
_array("softmax", lambda x: _order_sum(arrays.softmax(x)), _ordered(64, "exp(x[i]) / list_sum(list_transform(x, lambda e: exp(e)))"))
_array("mean_deviation", lambda x: F.round(arrays.mean_deviation(x), 6).alias("s"), "round(list_avg(list_transform(x, lambda e: abs(e - list_avg(x)))), 6) AS s")
_array("keep_if", lambda x: (arrays.keep_if(x, lambda e: e > -0.3).cast("int") + 2 * arrays.keep_if(x, lambda e: e > 0.3, every=False).cast("int")).alias("s"), "CAST(list_min(x) > -0.3 AS INT) + 2 * CAST(list_max(x) > 0.3 AS INT) AS s")
_array("joint_recurrence", lambda x: F.round(arrays.total(F.flatten(arrays.joint_recurrence(x, F.reverse(x)))), 6).alias("s"), "round(list_sum(list_transform(range(1, 65), lambda i: list_sum(list_transform(range(1, 65), lambda j: abs(x[i] - x[j]) * abs(x[65 - i] - x[65 - j]))))), 6) AS s")
_array("mark_padding", lambda x: _order_sum(arrays.mark_padding(F.transform(x, lambda e: (e > 0).cast("double")))), _ordered(64, "CASE WHEN i > list_max(list_transform(range(1, 65), lambda j: CASE WHEN x[j] > 0 THEN 0 ELSE j END)) THEN -1 ELSE CAST(x[i] > 0 AS INT) END"))
QUERIES["gramian_difference"] = lambda spark, sf: vectors(spark, sf).select("vec_id", _order_sum(F.get(arrays.gramian(arrays.rescaled("x"), difference=True), 0)))
ORACLES["gramian_difference"] = f"""WITH v AS ({EMB}), z AS (SELECT vec_id, list_transform(x, lambda e: -1 + 2 * (e - list_min(x)) / (list_max(x) - list_min(x))) AS z FROM v)
SELECT vec_id, {_ordered(64, "sqrt(greatest(0, 1 - z[1] * z[1])) * z[i] - z[1] * sqrt(greatest(0, 1 - z[i] * z[i]))")} FROM z"""


@query(f"""WITH v AS ({EMB}), m AS (SELECT vec_id, list_transform(x, lambda e: CASE WHEN e >= -0.1 THEN e END) AS x FROM v),
b AS (SELECT vec_id, x, coalesce(lag(x) OVER (ORDER BY vec_id), last_value(x) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM m)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] IS NULL OR x[i] IS NULL THEN 0 ELSE i * x[i] END)), 6) AS s FROM b""")
def self_missingness(spark, sf):
    holes = vectors(spark, sf).withColumn("x", F.transform("x", lambda e: F.when(e >= -0.1, e)))
    return reshape.copy_missing(holes, "x", "vec_id").select("vec_id", _order_sum(F.col("x")))


@query("SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings")
def one_hot_round_trip(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", arrays.from_one_hot(arrays.one_hot("label", 16)).cast("long").alias("label"))


@query(f"WITH v AS ({EMB}), l AS (SELECT unnest(range(64)) AS step, unnest(x) AS a, unnest(list_reverse(x)) AS b FROM v) SELECT step, round(sum(a * b), 6) AS s, count(*) AS n FROM l GROUP BY 1")
def arrays_to_long(spark, sf):
    long = series.to_long(vectors(spark, sf).withColumn("y", F.reverse("x")), ["vec_id"], ["x", "y"])
    return rounded(long.groupBy(F.col("step").cast("long").alias("step")).agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.count("*").alias("n")))


@query(f"WITH v AS ({EMB}) SELECT vec_id, {_ordered(64, 'x[i]')} FROM v")
def long_to_arrays(spark, sf):
    long = series.to_long(vectors(spark, sf), ["vec_id"], ["x"]).withColumn("dim", F.lit(0))
    return series.to_arrays(long, ["vec_id"], value="x", dims=1).select("vec_id", _order_sum(F.col("x0")))


# Samples, codes and tables


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c),
s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY 1) SELECT user_id, len(x) AS n, x[1] AS first_x, x[len(x)] AS last_x, event_type FROM s JOIN m USING (user_id) WHERE k = 1""")
def long_to_samples(spark, sf):
    out = reshape.to_samples(read(spark, sf, "events"), "user_id", ORDER, "value", "event_type")
    return out.select("user_id", F.size("value").cast("long").alias("n"), F.get("value", 0).alias("first_x"), F.element_at("value", -1).alias("last_x"), "event_type")


@query("WITH r AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events) SELECT event_type AS value, min(p) AS position FROM r WHERE event_type IN ('error', 'view') GROUP BY 1")
def first_rows_of_values(spark, sf):
    return reshape.first_rows(read(spark, sf, "events"), "event_type", ORDER, ["error", "view"])


@query("""WITH l AS (SELECT DISTINCT 'p_brand' AS variable, p_brand AS value FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part) SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS code FROM l WHERE value IS NOT NULL""")
def code_table(spark, sf):
    return reshape.codes(read(spark, sf, "part"), ["p_brand", "p_type"])


@query(f"""WITH v AS ({EMB}), b AS (SELECT vec_id, x, unnest(range(4)) AS b FROM v) SELECT vec_id, b AS block, round(list_sum(x) - list_sum(x[b * 16 + 1:b * 16 + 16]), 6) AS s FROM b""")
def zeroed_blocks(spark, sf):
    out = reshape.zero_blocks(vectors(spark, sf), ["x"], 64, 16)
    return out.select("vec_id", F.col("block").cast("long").alias("block"), F.round(arrays.total("x"), 6).alias("s"))


@query("SELECT l_orderkey, l_linenumber, round(regr_intercept(l_extendedprice, l_quantity) OVER w + regr_slope(l_extendedprice, l_quantity) OVER w * l_quantity, 3) AS line FROM lineitem WINDOW w AS (PARTITION BY l_linenumber)")
def trend_line(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return reshape.trend(rows, "l_quantity", "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", F.round("trend", 3).alias("line"))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n, value FROM events) SELECT (rn - 1) // 64 AS batch, count(*) AS n, round(sum(value), 4) AS s FROM r WHERE rn <= n - n % 64 GROUP BY 1")
def ordered_batches(spark, sf):
    out = splits.batches(read(spark, sf, "events"), ORDER, 64, drop_last=True)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))


@query("""SELECT 'o_custkey' AS variable, count(*) AS n, count(*) - count(o_custkey) AS n_missing, count(DISTINCT o_custkey) AS n_distinct FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders""")
def table_summary(spark, sf):
    return series.summary(read(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, o_orderdate AS day FROM orders")
def steps_round_trip(spark, sf):
    df, start = encode.steps_since(read(spark, sf, "orders"), "o_orderdate", "D", name="steps")
    return df.select("o_orderkey", encode.time_at(F.col("steps"), start, "D").alias("day"))


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'click') > 0 AS INT) AS click, CAST(count(*) FILTER (event_type = 'purchase') > 0 AS INT) AS purchase FROM events GROUP BY 1")
def multi_hot(spark, sf):
    kinds = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    hot = encode.multi_hot("k", ["click", "purchase"])
    return kinds.select("user_id", F.get(hot, 0).alias("click"), F.get(hot, 1).alias("purchase"))


# More metrics


@query(f"WITH {SCORE} SELECT round(avg(CAST((p > 0.3) = (quality = 1) AND (p > 0.3) = (toxic = 1) AS INT)), 6) AS exact FROM s")
def exact_match(spark, sf):
    df = scored(spark, sf).select(F.array("p", "p").alias("s"), F.array("quality", "toxic").alias("a"))
    return rounded(df.agg(metrics.exact_match("s", "a", 0.3).alias("exact")))


@query(f"WITH {SCORE}, c AS (SELECT quality, avg(CAST(CAST(p > 0.3 AS INT) = quality AS INT)) AS a FROM s GROUP BY 1) SELECT round(avg(a), 6) AS mean_class_accuracy FROM c")
def mean_class_accuracy(spark, sf):
    return rounded(metrics.mean_class_accuracy(scored(spark, sf).withColumn("c", (F.col("p") > 0.3).cast("int")), "quality", "c"))


@query(f"WITH {SCORE} SELECT CAST(greatest(1, ceil(p * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_confidence, round(avg(quality), 6) AS share_correct FROM s GROUP BY 1")
def calibration_curve(spark, sf):
    return rounded(metrics.calibration_curve(scored(spark, sf), "p", "quality"))


@query(f"WITH {EV} SELECT round(avg(abs(value - 1 - v)), 6) AS mae, round(avg(CASE WHEN abs(value - 20 - v) < 2 THEN 0.5 * (value - 20 - v) ** 2 ELSE 2 * (abs(value - 20 - v) - 1) END), 6) AS huber FROM e WHERE v IS NOT NULL")
def masked_losses(spark, sf):
    e = events(spark, sf)
    return rounded(e.agg(metrics.masked(metrics.mae, F.col("value") - 1, "v").alias("mae"), metrics.masked(metrics.huber, F.col("value") - 20, "v", 2.0).alias("huber")))


@query("""WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS c FROM x GROUP BY 1, 2) SELECT round(sum((v - c) ** 2) / (SELECT count(*) FROM embeddings), 6) AS loss FROM x JOIN c USING (label, i)""")
def center_loss(spark, sf):
    z = read(spark, sf, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rounded(metrics.center_loss(z, "x", "label"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CASE WHEN value = hi THEN 25 ELSE CAST(floor((value - lo) / (hi - lo) * 25) AS BIGINT) + 1 END AS bin, count(*) AS n FROM events, e GROUP BY 1""")
def histogram(spark, sf):
    return metrics.histogram(read(spark, sf, "events"), "value", 25)


@query("""WITH r AS (SELECT event_id, user_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) - value AS u, sum(value) OVER (PARTITION BY user_id) AS t FROM events) SELECT user_id, count(*) AS n FROM r WHERE u < t * 0.4 GROUP BY 1""")
def hardest_share(spark, sf):
    return metrics.hardest_share(read(spark, sf, "events"), "value", 0.4, "user_id", "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT value, sum(CAST(event_type = 'click' AS INT)) AS a, sum(CAST(event_type = 'view' AS INT)) AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
r AS (SELECT sum(a) OVER (ORDER BY value) / (SELECT sum(a) FROM c) AS a, sum(b) OVER (ORDER BY value) / (SELECT sum(b) FROM c) AS b FROM c) SELECT round(max(abs(a - b)), 6) AS d FROM r""")
def two_sample_distance(spark, sf):
    d = metrics.kolmogorov_smirnov(read(spark, sf, "events"), "value", "event_type", "click", "view")["d"]
    return rounded(spark.createDataFrame([(float(d),)], "d double"))


@query("""WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'click'), b AS (SELECT * FROM g WHERE g = 'view')
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df FROM a, b""")
def welch_test(spark, sf):
    w = metrics.welch(read(spark, sf, "events"), "value", "event_type", "click", "view")
    return spark.createDataFrame([(w["t"], w["df"])], "t double, df double").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


# Without SQL: results of these are tested against NumPy or by their invariants.


@query()
def markov_transition(spark, sf):
    return vectors(spark, sf).select("vec_id", arrays.markov_field("x", 4).alias("field"))


@query()
def savgol_smooth(spark, sf):
    return vectors(spark, sf).select("vec_id", arrays.savgol_smoothed("x", 7, 2).alias("x"))


@query()
def minirocket_features(spark, sf):
    from .operators.features import MiniRocket

    v = vectors(spark, sf)
    return MiniRocket(["x"], features=168, sample=200).fit(v, "vec_id").transform(v, ["vec_id"])


@query()
def rand_augment(spark, sf):
    return vectors(spark, sf).select("vec_id", augment.rand_augment("x", F.col("vec_id"), n=2, seed=5).alias("x"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT e.range AS epoch, unnest(generate_series(0, (n - 1) // 32)) AS batch, n FROM n, range(2) e)
SELECT epoch, batch, least(32, n - 32 * batch) AS n_rows, least(32, n - 32 * batch) AS n_alike FROM b""")
def rand_augment_batches(spark, sf):
    """Two epochs in batches, each changed in the two ways drawn for it: rows, and those that agree with these ways one after the other."""
    ways = {"flip": lambda x, *_, **__: augment.horizontal_flip(x), "negate": lambda x, *_, **__: augment.vertical_flip(x), "roll": lambda x, *_, **__: arrays.roll(x, 3)}
    by = F.struct("epoch", "batch")
    out = epochs.epochs(vectors(spark, sf), "vec_id", 32, 2, seed=1)
    out = out.withColumns({"y": augment.rand_augment_batches("x", "vec_id", by, n=2, choices=ways, seed=4), "picked": augment.drawn(list(ways), by, 2, seed=4)})
    alike = F.lit(False)
    for a, b in itertools.permutations(ways, 2):
        alike |= (F.concat_ws(" ", "picked") == f"{a} {b}") & (F.col("y") == ways[b](ways[a](F.col("x"))))
    return out.groupBy(F.col("epoch").cast("long").alias("epoch"), "batch").agg(F.count("*").alias("n_rows"), F.count_if(alike).alias("n_alike"))


@query()
def subsequence_mask(spark, sf):
    return vectors(spark, sf).select("vec_id", augment.masked("x", augment.subsequence_mask(64, F.col("vec_id"), seed=3)).alias("x"))


# Panels in which one entity has most rows, descending windows, targets by a function

SKEWED = "e AS (SELECT CASE WHEN event_id % 10 = 0 THEN user_id ELSE -1 END AS id, event_id, ts, value FROM events)"


@query(f"""WITH {SKEWED}, a AS (SELECT id, event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY id) AS n, lag(value, 7) OVER w AS x0, value AS x7, lead(value, 1) OVER w AS y1, lead(value, 3) OVER w AS y3 FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, event_id))
SELECT id, event_id, (rn - 8) // 2 AS "window", x0, x7, y1, y3 FROM a WHERE rn >= 8 AND rn + 3 <= n AND (rn - 8) % 2 = 0""")
def window_skewed_panel(spark, sf):
    """One entity has nine tenths of the rows; its windows are made in chunks."""
    e = read(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.col("user_id")).otherwise(-1).alias("id"), "event_id", "ts", "value")
    out = windows.sliding_windows(e, ORDER, "value", 8, ids="id", y="value", horizon=3, stride=2, chunked=True, chunk=1000, y_is_x_checked=False)
    return out.select("id", "event_id", "window", F.get("value_x", 0).alias("x0"), F.get("value_x", 7).alias("x7"), F.get("value_y", 0).alias("y1"), F.get("value_y", 2).alias("y3"))


@query(f"""WITH a AS (SELECT user_id, event_id, row_number() {W.replace("ts, event_id", "ts DESC, event_id DESC")} AS rn, avg(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM events)
SELECT user_id, event_id, rn - 4 AS "window", round(m, 6) AS x_mean FROM a WHERE rn >= 4""")
def window_descending(spark, sf):
    out = windows.sliding_windows(read(spark, sf, "events"), ORDER, "value", 4, ids=IDS, ascending=False)
    return out.select("user_id", "event_id", "window", F.round(arrays.mean("value"), 6).alias("x_mean"))


@query(f"""WITH a AS (SELECT user_id, event_id, row_number() {W} AS rn, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS y FROM events)
SELECT user_id, event_id, rn - 6 AS "window", list_max(y) - list_min(y) AS spread FROM a WHERE rn >= 6 AND rn + 4 <= n AND list_max(y) > 150""")
def window_target_function(spark, sf):
    """The target is the next four values' spread; windows without a large one are left out."""
    spread = lambda y: F.struct((F.array_max(y) - F.array_min(y)).alias("spread"), F.array_max(y).alias("most"))
    out = windows.sliding_windows(read(spark, sf, "events"), ORDER, "value", 6, ids=IDS, y="value", horizon=4, y_is_x_checked=False, y_func=spread, processor=lambda d: d.where("value_y.most > 150"))
    return out.select("user_id", "event_id", "window", "value_y.spread")


# Epochs, permutations, draws


@query("""WITH n AS (SELECT count(*) AS n, sum(event_id) AS s FROM events), b AS (SELECT e.range AS epoch, unnest(generate_series(0, (n - 1) // 256)) AS batch, n, s FROM n, range(3) e)
SELECT epoch, batch, least(256, n - 256 * batch) AS n_rows, CAST(s AS BIGINT) AS epoch_sum, n AS epoch_rows FROM b""")
def epoch_batches(spark, sf):
    """Each row once in each of three epochs: batches' sizes, and each epoch's rows and sum of keys."""
    out = epochs.epochs(read(spark, sf, "events").select("event_id", "ts"), ORDER, 256, 3, seed=1)
    per = out.groupBy("epoch", "batch").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("s"), F.count_distinct("event_id").alias("d"))
    every = per.groupBy("epoch").agg(F.sum("s").alias("epoch_sum"), F.sum("d").alias("epoch_rows"))
    return per.join(every, "epoch").select(F.col("epoch").cast("long").alias("epoch"), "batch", "n_rows", "epoch_sum", "epoch_rows")


@query("SELECT event_type, value, count(*) AS n FROM (SELECT event_type, value FROM events) GROUP BY 1, 2")
def shuffled_rows(spark, sf):
    """Pairs of columns that move together keep their counts, and other columns their own."""
    out = epochs.shuffled(read(spark, sf, "events").select("event_id", "ts", "event_type", "value"), ORDER, ["event_type", "value"], together=True, seed=3)
    return out.groupBy("event_type", "value").agg(F.count_distinct("event_id").alias("n"))


@query("""WITH a AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT a.event_id, b.value FROM a JOIN a b ON a.r = (b.r + 100) % b.n""")
def rolled_rows(spark, sf):
    return epochs.rolled(read(spark, sf, "events").select("event_id", "ts", "value"), ORDER, "value", 100).select("event_id", "value")


@query("SELECT 50000 AS n_draws, 50000 AS n_numbers, 0 AS n_unknown, 0 AS n_weightless")
def weighted_draws(spark, sf):
    """As many draws as were asked for, each of a row of the table with some weight."""
    e = read(spark, sf, "events").select("event_id", "ts", "event_type", "value").withColumn("w", F.when(F.col("event_type") != "error", F.col("value")))
    out = epochs.draws(e, ORDER, 50_000, weight="w", seed=5)
    known = out.join(e.select("event_id").withColumn("known", F.lit(1)), "event_id", "left")
    return known.agg(F.count("*").cast("int").alias("n_draws"), F.count_distinct("draw").cast("int").alias("n_numbers"), F.sum(F.col("known").isNull().cast("int")).cast("int").alias("n_unknown"), F.sum((F.coalesce("w", F.lit(0.0)) <= 0).cast("int")).cast("int").alias("n_weightless"))


# Features of whole series by a table of settings

SQL_FEATURES = {
    **dict.fromkeys(("length", "sum_values", "mean", "median", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum", "abs_energy", "variation_coefficient", "skewness", "kurtosis", "count_above_mean", "count_below_mean")),
    **dict.fromkeys(("share_of_distinct_values", "absolute_sum_of_changes", "mean_abs_change", "mean_change", "mean_second_derivative", "first_location_of_maximum", "first_location_of_minimum", "last_location_of_maximum")),
    "quantile": [{"q": 0.1}, {"q": 0.75}],
    "ratio_beyond_sigma": [{"r": 1}],
    "complexity": [{"normalize": False}, {"normalize": True}],
    "time_reversal_asymmetry": [{"lag": 1}],
    "c3": [{"lag": 2}],
    "number_crossing": [{"m": 50}],
    "number_peaks": [{"n": 1}],
    "linear_trend": [{"attr": a} for a in ("slope", "intercept", "r")],
    "autocorrelation": [{"lag": 1}, {"lag": 4}],
    "partial_autocorrelation": [{"lag": 1}],
}


def _series(spark, sf):
    """Each user's values in order, errors left out, as an array."""
    e = events(spark, sf).where("v is not null").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "v"))).alias("s"))
    return e.select("user_id", F.transform("s", lambda r: r["v"]).alias("v"))


@query(f"""WITH {EV}, a AS (SELECT user_id, v, row_number() {W} - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, avg(v) OVER (PARTITION BY user_id) AS mu, stddev_pop(v) OVER (PARTITION BY user_id) AS sd,
    lag(v) {W} AS b1, lag(v, 2) {W} AS b2, lag(v, 4) {W} AS b4, lead(v) {W} AS f1, max(v) OVER (PARTITION BY user_id) AS hi, min(v) OVER (PARTITION BY user_id) AS lo FROM e WHERE v IS NOT NULL),
g AS (SELECT user_id, any_value(n) AS n, any_value(mu) AS mu, any_value(sd) AS sd, sum(v) AS s, median(v) AS md, sum(v * v) AS ss, max(v) AS hi, min(v) AS lo, max(abs(v)) AS ahi, skewness(v) AS sk, kurtosis(v) AS ku,
    sum(CASE WHEN v > mu THEN 1 ELSE 0 END) AS above, sum(CASE WHEN v < mu THEN 1 ELSE 0 END) AS below, count(DISTINCT v) AS dist, sum(abs(v - b1)) AS ac, avg(abs(v - b1)) AS mac, sum(v - b1) AS ch, sum(v - 2 * b1 + b2) AS ch2,
    min(t) FILTER (v = hi) AS fhi, min(t) FILTER (v = lo) AS flo, max(t) FILTER (v = hi) AS lhi, quantile_cont(v, 0.1) AS q1, quantile_cont(v, 0.75) AS q3, avg(CASE WHEN abs(v - mu) > sd THEN 1.0 ELSE 0.0 END) AS rb,
    sum((v - b1) * (v - b1)) AS cc, avg(v * v * b1 - b1 * b2 * b2) AS tra, avg(v * b2 * b4) AS c3, sum(CASE WHEN (v > 50) <> (b1 > 50) THEN 1 ELSE 0 END) AS crossing, sum(CASE WHEN v > b1 AND v > f1 THEN 1 ELSE 0 END) AS peaks,
    regr_slope(v, t) AS slope, regr_intercept(v, t) AS icpt, corr(v, t) AS r, avg((v - mu) * (b1 - mu)) AS a1, avg((v - mu) * (b4 - mu)) AS a4, sum((v - mu) * (b1 - mu)) AS s1, var_pop(v) AS var FROM a GROUP BY 1)
SELECT user_id, {", ".join(f"round(CAST({e} AS DOUBLE), 6) AS v__{c}" for c, e in [
    ("length", "n"), ("sum_values", "s"), ("mean", "mu"), ("median", "md"), ("standard_deviation", "sd"), ("variance", "var"), ("root_mean_square", "sqrt(ss / n)"), ("maximum", "hi"), ("absolute_maximum", "ahi"), ("minimum", "lo"), ("abs_energy", "ss"),
    ("variation_coefficient", "sd / mu"), ("skewness", "sk"), ("kurtosis", "ku"), ("count_above_mean", "above"), ("count_below_mean", "below"), ("share_of_distinct_values", "dist / n"), ("absolute_sum_of_changes", "ac"), ("mean_abs_change", "mac"),
    ("mean_change", "ch / (n - 1)"), ("mean_second_derivative", "ch2 / (2 * (n - 2))"), ("first_location_of_maximum", "fhi / n"), ("first_location_of_minimum", "flo / n"), ("last_location_of_maximum", "(lhi + 1) / n"), ("quantile__q_0_1", "q1"), ("quantile__q_0_75", "q3"),
    ("ratio_beyond_sigma__r_1", "rb"), ("complexity__normalize_False", "sqrt(cc)"), ("complexity__normalize_True", "sqrt(cc) / sd"), ("time_reversal_asymmetry__lag_1", "tra"), ("c3__lag_2", "c3"), ("number_crossing__m_50", "crossing"), ("number_peaks__n_1", "peaks"),
    ("linear_trend__attr_slope", "slope"), ("linear_trend__attr_intercept", "icpt"), ("linear_trend__attr_r", "r"), ("autocorrelation__lag_1", "a1 / var"), ("autocorrelation__lag_4", "a4 / var"), ("partial_autocorrelation__lag_1", "s1 / (n * var)")])}
FROM g WHERE n >= 12""")  # fmt: skip
def series_features(spark, sf):
    """Those features of users with 12 values or more that SQL can say."""
    return rounded(extract.extract(_series(spark, sf).where("size(v) >= 12"), "v", SQL_FEATURES))


@query()
def series_features_comprehensive(spark, sf):
    """All of them, entropies and spectra included, for every user."""
    return extract.extract(_series(spark, sf), "v", "comprehensive")
