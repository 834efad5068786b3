"""Encoders: dates, positions, categories, missingness. What is fitted is a small table or a list, and is broadcast if small."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import Names, listed, over, string_columns, whole

#: Parts of a date and the values that close their circle. Fixed values.
CYCLES = {"microsecond": 1e6, "millisecond": 1e3, "second": 60, "minute": 60, "hour": 24, "day": 31, "weekday": 7, "dayofyear": 366, "week": 53, "month": 12, "year": 10}
#: A fitted vocabulary of at most so many values is broadcast.
SMALL = 200_000


def part(time: str | Column, name: str) -> Column:
    """A part of a timestamp as a long: weekday from Monday 0, the ISO week, the year within its decade."""
    t = F.col(time) if isinstance(time, str) else time
    micro = F.date_format(t, "SSSSSS").cast("long")
    got = {
        "microsecond": lambda: micro, "millisecond": lambda: F.floor(micro / 1000), "second": lambda: F.floor(F.second(t)), "minute": lambda: F.minute(t), "hour": lambda: F.hour(t),
        "day": lambda: F.dayofmonth(t), "weekday": lambda: F.weekday(t), "dayofyear": lambda: F.dayofyear(t), "week": lambda: F.weekofyear(t), "month": lambda: F.month(t), "year": lambda: F.year(t) % 10,
    }
    return got[name]().cast("long")


def sincos(value: Column, cycle: float) -> tuple[Column, Column]:
    a = value * (2 * math.pi) / cycle
    return F.sin(a), F.cos(a)


def time_encoding(time: str, name: str, cycle: float | None = None) -> tuple[Column, Column]:
    """Sine and cosine of a part of a timestamp."""
    return sincos(part(time, name), cycle or CYCLES[name])


def date_parts(df: DataFrame, time: str, prefix: str | None = None, *, with_time: bool = False, drop: bool = True) -> DataFrame:
    """Adds year, month, ISO week, day, weekday, day of year, and whether it is a month's, quarter's or year's first or last."""
    t, p = F.col(time), f"{time}_" if prefix is None else prefix
    day = t.cast("date")
    quarter_start = F.date_trunc("quarter", t).cast("date")
    flag = lambda c: c.cast("int")
    out = {
        "year": F.year(t), "month": F.month(t), "week": F.weekofyear(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "dayofyear": F.dayofyear(t),
        "is_month_end": flag(day == F.last_day(t)), "is_month_start": flag(F.dayofmonth(t) == 1),
        "is_quarter_end": flag(day == F.date_sub(F.add_months(quarter_start, 3), 1)), "is_quarter_start": flag(day == quarter_start),
        "is_year_end": flag((F.month(t) == 12) & (F.dayofmonth(t) == 31)), "is_year_start": flag(F.dayofyear(t) == 1),
    }
    if with_time:
        out |= {"hour": F.hour(t), "minute": F.minute(t), "second": F.second(t)}
    df = df.withColumns({f"{p}{k}": v.cast("long") for k, v in out.items()})
    return df.drop(time) if drop else df


#: Units of fixed length in microseconds. Fixed values.
UNIT_MICROS = {"W": 604_800_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}


def steps_since(df: DataFrame, time: str, unit: str = "D", start: str | None = None, name: str | None = None) -> tuple[DataFrame, object]:
    """Adds whole units since the start (the first timestamp if not given), and returns that start for the inverse."""
    if start is None:
        start = df.agg(F.min(time)).first()[0]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    steps = F.floor((micros(F.col(time)) - micros(F.lit(start).cast("timestamp_ntz"))) / UNIT_MICROS[unit]).cast("long")
    return df.withColumn(name or f"{unit}_since_start", steps), start


def time_at(steps: Column, start, unit: str = "D") -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp")) + steps * UNIT_MICROS[unit]).cast("timestamp_ntz")


def positions(df: DataFrame, order: Names, ids: Names = None, *, linear: bool = False, lo: float = -1, hi: float = 1) -> DataFrame:
    """Adds pos_sin and pos_cos of the row's place in its entity, or pos_linear from lo to hi."""
    w = over(ids, order)
    i, n = F.row_number().over(w) - 1, F.count("*").over(whole(ids))
    if linear:
        return df.withColumn("pos_linear", F.when(n > 1, lo + (hi - lo) * i / (n - 1)).otherwise(float(lo)))
    s, c = sincos(i / n, 1)
    return df.withColumns({"pos_sin": s, "pos_cos": c})


def encode_values(c: str, ids: Names = None, *, linear: bool = False, lo: float = -1, hi: float = 1) -> tuple[Column, ...]:
    """A variable scaled from its least to its greatest value, as sine and cosine or as a line."""
    w = whole(ids)
    share = (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    return (lo + (hi - lo) * share,) if linear else sincos(share, 1)


def missing_flags(df: DataFrame, columns: Names, suffix: str = "_missing") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("short") for c in listed(columns)})


def drop_if_true(df: DataFrame, columns: Names) -> DataFrame:
    """Rows whose flags are all 0 or null, without the flags."""
    flags = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in listed(columns)), F.lit(0))
    return df.where(flags == 0).drop(*listed(columns))


def relabel(c: str, names: dict) -> Column:
    """Labels by the dict; unknown ones stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) if names else F.col(c)


def small(df: DataFrame) -> DataFrame:
    """A fitted table, broadcast if it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


@dataclass
class OrdinalEncoder:
    """Categories in their order as 1, 2, ...; missing and unseen ones as 0 (or, without add_na, 0, 1, ... and -1)."""

    columns: Names = None
    add_na: bool = True
    suffix: str = ""

    def fit(self, df: DataFrame) -> OrdinalModel:
        from pyspark.sql import Window

        out = {}
        for c in listed(self.columns) or string_columns(df):
            seen = df.where(F.col(c).isNotNull()).select(c).distinct()
            # distinct values only: the numbering's one task has a vocabulary, not the table
            out[c] = seen.withColumn("code", (F.row_number().over(Window.orderBy(c)) - (0 if self.add_na else 1)).cast("long"))
        return OrdinalModel(out, self.add_na, self.suffix)


@dataclass
class OrdinalModel:
    tables: dict[str, DataFrame]
    add_na: bool
    suffix: str

    def transform(self, df: DataFrame) -> DataFrame:
        for c, t in self.tables.items():
            t = small(t.withColumnRenamed(c, "_value").withColumnRenamed("code", "_code"))
            df = df.join(t, F.col(c) == F.col("_value"), "left").withColumn(f"{c}{self.suffix}", F.coalesce("_code", F.lit(0 if self.add_na else -1).cast("long"))).drop("_value", "_code")
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for c, t in self.tables.items():
            t = small(t.withColumnRenamed(c, "_value").withColumnRenamed("code", "_code"))
            df = df.join(t, F.col(f"{c}{self.suffix}") == F.col("_code"), "left").withColumn(c, F.coalesce("_value", F.lit("#na#"))).drop("_value", "_code")
        return df


@dataclass
class OneHotEncoder:
    """Columns c_<category> of 0 and 1 for the categories of the fit; others give 0 everywhere."""

    columns: Names = None
    drop: bool = True
    most: int = 1000

    def fit(self, df: DataFrame) -> OneHotModel:
        out = {}
        for c in listed(self.columns) or string_columns(df):
            rows = df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(self.most + 1).collect()
            if len(rows) > self.most:
                raise ValueError(f"{c} has more than {self.most} categories")
            out[c] = [r[0] for r in rows]
        return OneHotModel(out, self.drop)


@dataclass
class OneHotModel:
    categories: dict[str, list]
    drop: bool

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("byte"), F.lit(0).cast("byte")) for c, vs in self.categories.items() for v in vs})
        return df.drop(*self.categories) if self.drop else df

    def inverse(self, df: DataFrame) -> DataFrame:
        for c, vs in self.categories.items():
            df = df.withColumn(c, F.coalesce(*[F.when(F.col(f"{c}_{v}") == 1, F.lit(v)) for v in vs])).drop(*[f"{c}_{v}" for v in vs])
        return df


@dataclass
class TargetEncoder:
    """Each category's mean target over the fit's rows; unseen categories are null."""

    target: str
    columns: Names = None
    suffix: str = ""

    def fit(self, df: DataFrame) -> TargetModel:
        return TargetModel({c: df.groupBy(c).agg(F.avg(self.target).alias("_mean")) for c in listed(self.columns) or string_columns(df)}, self.suffix)


@dataclass
class TargetModel:
    tables: dict[str, DataFrame]
    suffix: str

    def transform(self, df: DataFrame) -> DataFrame:
        for c, t in self.tables.items():
            df = df.join(small(t.withColumnRenamed(c, "_value")), F.col(c).eqNullSafe(F.col("_value")), "left").withColumn(f"{c}{self.suffix}", F.col("_mean")).drop("_value", "_mean")
        return df


def multi_hot(labels: str, vocabulary: list[str]) -> Column:
    """An array of labels as an array of 0 and 1."""
    return F.array(*[F.coalesce(F.array_contains(labels, v).cast("int"), F.lit(0)) for v in vocabulary])


def digits(c: str, n: int, normalize: bool = True) -> Column:
    """A number's last n decimal digits with its sign, over 10 if normalised."""
    value, sign = F.abs(F.col(c).cast("long")), F.when(F.col(c) < 0, -1.0).otherwise(1.0)
    powers = F.array(*[F.lit(10**k) for k in range(n - 1, -1, -1)])
    return F.transform(powers, lambda p: sign * (F.floor(value / p) % 10) / (10 if normalize else 1))
