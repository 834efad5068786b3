"""Scalers: fit gives the statistics as a table of one row (or one for each entity), transform and its inverse join that.

One aggregation fits all columns. The statistics are taken where a predicate holds, so that a split's training rows alone count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import Names, continuous_columns, listed, quantile_row, quantiles

#: Scalers' centres and scales. standard: sample deviation plus eps; clamped: the deviation, eps at least; robust: interquartile
#: range plus eps; fence: the width between the outlier fences, four ranges, eps at least; minmax: to the range.
KINDS = ("standard", "clamped", "robust", "fence", "minmax", "maxabs")


@dataclass
class Scaler:
    columns: Names = None
    kind: str = "standard"
    ids: Names = None
    where: str | Column | None = None
    eps: float = 1e-6
    quantiles: tuple[float, float] = (0.25, 0.75)
    range: tuple[float, float] = (-1.0, 1.0)
    clip: bool = False
    exact: bool = True

    def fit(self, df: DataFrame) -> ScalerModel:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        ids = listed(self.ids)
        columns = listed(self.columns) or [c for c in continuous_columns(df) if c not in ids]
        rows = df.where(self.where) if self.where is not None else df
        at = (self.quantiles[0], 0.5, self.quantiles[1])
        ranked = self.kind in ("robust", "fence") and self.exact
        if ranked:  # in slices, as all values of a column or an entity may be too many for one task
            rows = quantile_row(rows, columns, at, ids)
        aggs = []
        for c in columns:
            if self.kind in ("standard", "clamped"):
                center, scale = F.avg(c), F.stddev_samp(c)
                scale = scale + self.eps if self.kind == "standard" else F.greatest(scale, F.lit(self.eps))
            elif self.kind in ("robust", "fence"):
                marks = F.array(*[F.lit(q) for q in at])
                q = F.first(c) if ranked else F.percentile_approx(c, marks, 100_000)
                center, scale = q[1], q[2] - q[0]
                scale = scale + self.eps if self.kind == "robust" else F.greatest(4 * scale, F.lit(self.eps))
            elif self.kind == "minmax":
                lo, hi = self.range
                scale = F.nullif((F.max(c) - F.min(c)) / (hi - lo), F.lit(0.0))
                center = F.min(c) - lo * (F.max(c) - F.min(c)) / (hi - lo)
            else:
                center, scale = F.lit(0.0), F.nullif(F.max(F.abs(c)).cast("double"), F.lit(0.0))
            aggs += [center.alias(f"{c}__center"), scale.alias(f"{c}__scale")]
        stats = rows.groupBy(*ids).agg(*aggs) if ids else rows.agg(*aggs)
        return ScalerModel(stats, columns, ids, self.range if self.clip and self.kind == "minmax" else None)


@dataclass
class ScalerModel:
    stats: DataFrame
    columns: list[str]
    ids: list[str] = field(default_factory=list)
    clip: tuple[float, float] | None = None

    def _with(self, df: DataFrame) -> DataFrame:
        # Without ids the statistics are one row by construction.
        return df.join(self.stats, self.ids, "left") if self.ids else df.join(F.broadcast(self.stats))

    def _without(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"{c}__{k}" for c in self.columns for k in ("center", "scale")])

    def transform(self, df: DataFrame) -> DataFrame:
        out = {c: (F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale") for c in self.columns}
        if self.clip:
            out = {c: F.least(F.greatest(v, F.lit(self.clip[0])), F.lit(self.clip[1])) for c, v in out.items()}
        return self._without(self._with(df).withColumns(out)).select(*df.columns)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._without(self._with(df).withColumns({c: F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__center") for c in self.columns})).select(*df.columns)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def clip_outliers(df: DataFrame, columns: Names, ids: Names = None, where: str | None = None) -> DataFrame:
    """Values beyond 1.5 interquartile ranges from the quartiles are moved to these fences."""
    columns, ids = listed(columns), listed(ids)
    rows = quantile_row(df.where(where) if where else df, columns, (0.25, 0.75), ids)
    q = {c: F.first(c) for c in columns}
    aggs = [x for c in columns for x in ((q[c][0] - 1.5 * (q[c][1] - q[c][0])).alias(f"{c}__lo"), (q[c][1] + 1.5 * (q[c][1] - q[c][0])).alias(f"{c}__hi"))]
    fences = rows.groupBy(*ids).agg(*aggs) if ids else rows.agg(*aggs)
    both = df.join(fences, ids, "left") if ids else df.join(F.broadcast(fences))
    return both.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(c, f"{c}__hi"), F.col(f"{c}__lo"))) for c in columns}).select(*df.columns)


def fill_median(df: DataFrame, columns: Names, ids: Names = None) -> DataFrame:
    """Nulls become the lower median, of the entity or of all."""
    columns, ids = listed(columns), listed(ids)
    rows = quantile_row(df, columns, [0.5], ids, lower=True)
    stats = rows.groupBy(*ids).agg(*[F.first(c)[0].cast(df.schema[c].dataType).alias(f"{c}__m") for c in columns])
    both = df.join(stats, ids, "left") if ids else df.join(F.broadcast(stats))
    return both.withColumns({c: F.coalesce(c, f"{c}__m") for c in columns}).select(*df.columns)


def signed_log(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.log1p(F.abs(c))


def signed_exp(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.expm1(F.abs(c))


def box_cox(c: str, power: float) -> Column:
    return F.log(c) if power == 0 else (F.pow(F.col(c), power) - 1) / power


def yeo_johnson(c: str, power: float) -> Column:
    x = F.col(c)
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, power) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, 2 - power) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def fit_power(df: DataFrame, c: str, kind=yeo_johnson, powers: list[float] | None = None) -> float:
    """The power of greatest likelihood on a grid, in one pass over the data."""
    powers = powers or [p / 10 for p in range(-20, 41)]
    jacobian = F.sum(F.signum(c) * F.log1p(F.abs(F.col(c)))) if kind is yeo_johnson else F.sum(F.log(c))
    row = df.where(F.col(c).isNotNull()).agg(F.count("*").alias("n"), jacobian.alias("j"), *[F.var_pop(kind(c, p)).alias(f"v{i}") for i, p in enumerate(powers)]).first()
    from math import log

    fit = {p: (p - 1) * row["j"] - row["n"] / 2 * log(row[f"v{i}"]) for i, p in enumerate(powers) if row[f"v{i}"]}
    return max(fit, key=fit.get) if fit else 1.0


def quantile_transform(df: DataFrame, c: str, points: int = 100, *, where: str | None = None) -> Column:
    """The share of fitted values up to a value, linear between ``points`` quantiles."""
    rows = df.where(where) if where else df
    row = quantiles(rows, c, [i / points for i in range(points + 1)]).first()
    q = row["q"] if row else []
    x, out = F.col(c).cast("double"), F.lit(1.0)
    for i in range(points - 1, -1, -1) if q else ():
        share = (i + (x - q[i]) / (q[i + 1] - q[i])) / points if q[i + 1] > q[i] else F.lit(i / points)
        out = F.when(x < q[i + 1], share).otherwise(out)
    return F.when(x.isNotNull(), F.greatest(out, F.lit(0.0)))


# Coefficients of Acklam's rational approximation to the inverse normal distribution, and where its tails begin. Fixed values.
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAILS = 0.02425
#: Shares nearer to 0 or 1 than this are moved here before they become normal; terms of the distribution's series.
EDGE, TERMS = 1e-7, 80


def normal_share(z: str | Column) -> Column:
    """The normal distribution at z, by its power series; for z from -6 to 6, beyond which it is 0 or 1 within 1e-9."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0))
    series = F.aggregate(F.array(*[F.lit(float(2 * k + 1)) for k in range(TERMS, 0, -1)]), F.lit(1.0), lambda a, d: x * x / d * a + 1)
    return F.when(z.isNotNull(), 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * x * series)


def normal_quantile(share: str | Column) -> Column:
    """Its inverse: a rational approximation, and one step by Newton's method. Shares are kept from 0 and 1."""
    share = F.col(share) if isinstance(share, str) else share
    p = F.greatest(F.least(share, F.lit(1 - EDGE)), F.lit(EDGE))

    def poly(of: tuple, x: Column) -> Column:
        out = F.lit(of[0])
        for c in of[1:]:
            out = out * x + c
        return out

    r = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(_TAIL, r) / poly(_TAIL_BELOW, r)
    q = p - 0.5
    centre = poly(_CENTRE, q * q) * q / poly(_CENTRE_BELOW, q * q)
    z = F.when(p < _TAILS, tail).when(p > 1 - _TAILS, -tail).otherwise(centre)
    step = lambda x: x - (normal_share(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
    return F.when(share.isNotNull(), F.get(F.transform(F.array(z), step), 0))


@dataclass
class QuantileScaler:
    """Values to the shares of the fitted values below them, linear between ``points`` + 1 quantiles, and these to a normal distribution.

    Ties get the middle of their shares. Values beyond the fitted ones get the ends'. where: the rows that count for the fit.
    Nulls stay; columns without fitted values become null.
    """

    columns: Names = None
    points: int = 1000
    normal: bool = True
    where: str | Column | None = None

    def fit(self, df: DataFrame) -> QuantileModel:
        columns = listed(self.columns) or continuous_columns(df)
        rows = df.where(self.where) if self.where is not None else df
        rows = quantile_row(rows, columns, [i / self.points for i in range(self.points + 1)])
        return QuantileModel(rows.agg(*[F.first(c).alias(f"{c}__q") for c in columns]), columns, self.points, self.normal)


@dataclass
class QuantileModel:
    marks: DataFrame
    columns: list[str]
    points: int
    normal: bool

    def _below(self, q: Column, x: Column, same: bool) -> Column:
        """How many marks are less than x (or the same), by bisection: one step for each bit of their number."""
        steps = F.array(*[F.lit(1 << b) for b in range(self.points.bit_length(), -1, -1)])
        mark = lambda i: F.get(q, i - 1)
        return F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= self.points + 1) & (mark(i + s) <= x if same else mark(i + s) < x), i + s).otherwise(i))

    def _share(self, q: Column, x: Column) -> Column:
        def way(n: Column) -> Column:
            lo, hi = F.get(q, n - 1), F.get(q, n)
            return F.when(n == 0, 0.0).when(n > self.points, 1.0).otherwise((n - 1 + (x - lo) / (hi - lo)) / self.points)

        once = lambda same: F.get(F.transform(F.array(self._below(q, x, same)), way), 0)
        middle = (once(True) + once(False)) / 2
        return F.when(x.isNull() | q.isNull(), None).when(x <= F.get(q, F.lit(0)), 0.0).when(x >= F.get(q, F.lit(self.points)), 1.0).otherwise(middle)

    def transform(self, df: DataFrame) -> DataFrame:
        both = df.join(F.broadcast(self.marks))  # one row by construction
        shares = both.withColumns({c: self._share(F.col(f"{c}__q"), F.col(c).cast("double")) for c in self.columns})
        return (shares.withColumns({c: normal_quantile(c) for c in self.columns}) if self.normal else shares).select(*df.columns)

    def inverse(self, df: DataFrame) -> DataFrame:
        both = df.join(F.broadcast(self.marks))
        both = both.withColumns({c: normal_share(c) for c in self.columns}) if self.normal else both

        def value(q: Column, share: Column) -> Column:
            at = share * self.points
            i = F.least(F.floor(at), F.lit(self.points - 1)).cast("int")
            within = F.get(q, i) + (at - i) * (F.get(q, i + 1) - F.get(q, i))
            near = 2 * EDGE if self.normal else 0.0
            return F.when(share.isNull(), None).when(share <= near, F.get(q, F.lit(0))).when(share >= 1 - near, F.get(q, F.lit(self.points))).otherwise(within)

        return both.withColumns({c: value(F.col(f"{c}__q"), F.col(c)) for c in self.columns}).select(*df.columns)


def narrow(df: DataFrame, columns: Names = None) -> DataFrame:
    """Whole numbers to the smallest type that holds them, doubles to floats; one pass finds the ranges."""
    from pyspark.sql.types import DoubleType, IntegerType, LongType, ShortType

    own = [f for f in df.schema if (columns is None or f.name in listed(columns)) and isinstance(f.dataType, LongType | IntegerType | ShortType | DoubleType)]
    whole_numbers = [f.name for f in own if not isinstance(f.dataType, DoubleType)]
    out = {f.name: F.col(f.name).cast("float") for f in own if isinstance(f.dataType, DoubleType)}
    if whole_numbers:
        row = df.agg(*[g(c).alias(f"{k}{i}") for i, c in enumerate(whole_numbers) for k, g in (("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(whole_numbers):
            out[c] = F.col(c).cast(smallest_type(row[f"lo{i}"] or 0, row[f"hi{i}"] or 0))
    return df.withColumns(out)


def smallest_type(lo: int, hi: int | None = None) -> str:
    hi = lo if hi is None else hi
    return next(t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << b) <= lo and hi < 1 << b)


def safe_to_cast(df: DataFrame, columns: Names, to: str = "float") -> dict[str, bool]:
    """Whether all whole values keep their value in a type."""
    most = {"float": 1 << 24, "double": 1 << 53, "tinyint": 127, "smallint": (1 << 15) - 1, "int": (1 << 31) - 1, "bigint": (1 << 63) - 1}[to]
    row = df.agg(*[F.max(F.abs(F.col(c).cast("decimal(38,6)"))).alias(c) for c in listed(columns)]).first()
    return {c: row[c] is None or row[c] <= most for c in listed(columns)}
