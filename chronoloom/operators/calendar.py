"""Calendars: complete time axes, bounds and ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fills import drop_duplicates, fill_missing
from .frame import Names, listed

#: Frequency codes and their units. Fixed values.
UNITS = {"Y": "year", "YS": "year", "Q": "quarter", "QS": "quarter", "M": "month", "MS": "month", "W": "week", "D": "day", "h": "hour", "H": "hour", "min": "minute", "T": "minute", "s": "second", "S": "second", "ms": "millisecond", "us": "microsecond"}


def interval(freq: str, times: int = 1) -> str:
    """A frequency such as 'D', '4h' or '10min' as an interval literal."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
    if not m or m[2] not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}")
    n, unit = int(m[1] or 1) * times, UNITS[m[2]]
    if unit == "quarter":
        n, unit = 3 * n, "month"
    return f"INTERVAL {n} {unit}"


def bounds(df: DataFrame, time: str, ids: Names = None) -> DataFrame:
    """(ids, lo, hi)."""
    return df.groupBy(*listed(ids)).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))


def add_missing_timestamps(df: DataFrame, time: str, freq: str, ids: Names = None, *, range_by_group: bool = True, start: str | None = None, end: str | None = None, fill_value: float | None = None) -> DataFrame:
    """A row for each step of the calendar from the first to the last timestamp, of each entity or of all.

    Raises if an entity has a timestamp twice. Rows off the calendar go, as they have no step. New rows have nulls, or
    the fill value in numeric columns.
    """
    ids = listed(ids)
    if not df.groupBy(*ids, time).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicated {time}; drop duplicates first")
    kind = df.schema[time].dataType
    if ids and range_by_group:
        spine = bounds(df, time, ids)
    else:  # one range: a single row, joined with the entities
        span = bounds(df, time)
        spine = df.select(*ids).distinct().join(F.broadcast(span)) if ids else span
    lo = F.to_timestamp_ntz(F.lit(start)).cast(kind) if start else F.col("lo")
    hi = F.to_timestamp_ntz(F.lit(end)).cast(kind) if end else F.col("hi")
    spine = spine.where("lo is not null").withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select(*ids, F.explode(F.expr(f"sequence(lo, hi, {interval(freq)})")).alias(time)).withColumn(time, F.col(time).cast(kind))
    out = spine.join(df, [*ids, time], "left").select(*df.columns)
    return out if fill_value is None else out.fillna(fill_value, [c for c in df.columns if c not in (*ids, time)])


def prepare(df: DataFrame, time: str, freq: str = "1D", *, ids: Names = None, order: Names = None, keep: str = "last", method: str | None = None, columns: Names = None) -> DataFrame:
    """Duplicates out (by ``order``, or the time), calendar completed, and filled by the method if there is one."""
    ids = listed(ids)
    df = drop_duplicates(df, [*ids, time], listed(order) or time, keep)
    df = add_missing_timestamps(df, time, freq, ids)
    return fill_missing(df, columns, time, ids, method, None) if method else df


def filter_by_time(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included."""
    df = df.where(F.col(time) >= F.lit(start).cast(df.schema[time].dataType)) if start else df
    return df.where(F.col(time) <= F.lit(end).cast(df.schema[time].dataType)) if end else df


def forecast_bounds(df: DataFrame, time: str, at: str | tuple[str, str], history: int, horizon: int, freq: str = "D") -> tuple:
    """The first and last timestamp that forecasts at a time (or from one to another) need: history steps back, horizon steps on."""
    first, last = (at, at) if isinstance(at, str) else at
    row = df.select(F.lit(first).cast("timestamp_ntz").alias("a"), F.lit(last).cast("timestamp_ntz").alias("b")).limit(1)
    back = f"a - {interval(freq, history - 1)}" if history > 1 else "a"
    got = row.select(F.expr(back).alias("lo"), F.expr(f"b + {interval(freq, horizon)}").alias("hi")).first()
    return (got["lo"], got["hi"]) if got else (None, None)


def forecast_rows(df: DataFrame, time: str, at: str | tuple[str, str], history: int, horizon: int, freq: str = "D") -> DataFrame:
    """The rows that forecasts at the given times need; the range reaches the scan."""
    lo, hi = forecast_bounds(df, time, at, history, horizon, freq)
    return df if lo is None else df.where(F.col(time).between(F.lit(lo), F.lit(hi)))


def roll_forward(start: Column, freq: str) -> Column:
    """The first point of the frequency at or after a time: Sundays for weeks, first days for months, quarters and years."""
    day = F.date_trunc("day", start)
    unit = {"W": None, "MS": "month", "QS": "quarter", "YS": "year"}.get(freq, "")
    if unit is None:
        return F.date_add(start.cast("date"), (7 - F.weekday(start) - 1) % 7).cast("timestamp_ntz")
    if not unit:
        return start
    floor = F.date_trunc(unit, start)
    step = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.when(floor == day, floor).otherwise(F.add_months(floor.cast("date"), step)).cast("timestamp_ntz")
