"""What all operators on panels share: keys, a total order, and one window specification for them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType

Names = str | Iterable[str] | None


def listed(names: Names) -> list[str]:
    """None, one name or many, as a list."""
    return [] if names is None else [names] if isinstance(names, str) else list(names)


def over(ids: Names, order: Names) -> WindowSpec:
    """The canonical window. Functions that look back and ahead all use it, so they share one exchange and one sort."""
    return Window.partitionBy(*listed(ids)).orderBy(*listed(order))


def whole(ids: Names) -> WindowSpec:
    return Window.partitionBy(*listed(ids))


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def nan_to_null(df: DataFrame, columns: Names = None) -> DataFrame:
    """NaN is null within the engine; this is for what comes from outside."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, FloatType | DoubleType)]
    own = [c for c in floats if columns is None or c in listed(columns)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in own})


def null_to_nan(df: DataFrame, columns: Names) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in listed(columns)})


def continuous_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def numbered(df: DataFrame, ids: Names, order: Names, name: str = "_rn", count: str | None = None) -> DataFrame:
    """Adds each row's number from 1 within its entity, and the entity's rows. A single series isn't sorted in one task."""
    if not listed(ids) and sliceable(df, listed(order)[0]):
        return number_series(df, order, name, count)
    df = df.withColumn(name, F.row_number().over(over(ids, order)))
    return df.withColumn(count, F.count("*").over(whole(ids))) if count else df


def sliceable(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType | DateType | TimestampType | TimestampNTZType)


def _key(df: DataFrame, column: str) -> Column:
    """A column to slice by, as a double."""
    if isinstance(df.schema[column].dataType, NumericType):
        return F.col(column).cast("double")
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def _sliced(df: DataFrame, column: str, source: DataFrame, slices: int) -> DataFrame:
    """Adds _slice, growing with the column; the bounds are approximate quantiles of the source's. Nulls are in slice -1."""
    from pyspark.ml.feature import Bucketizer

    bounds = source.select(_key(source, column).alias("_x")).where("_x is not null").approxQuantile("_x", [i / slices for i in range(1, slices)], 0.01)
    bounds = sorted({b + 0.0 for b in bounds if math.isfinite(b)})
    df = df.withColumn("_slice_key", _key(df, column) + 0.0)  # no negative zero: the search holds it less than zero
    if bounds:
        df = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_slice_key", outputCol="_slice_at", handleInvalid="keep").transform(df)
    slot = F.col("_slice_at").cast("int") if bounds else F.lit(0)
    return df.withColumn("_slice", F.when(F.col("_slice_key").isNotNull(), slot).otherwise(F.lit(-1))).drop("_slice_key", "_slice_at")


def running(df: DataFrame, order: str, sums: dict[str, str], by: str | None = None, source: DataFrame | None = None, slices: int = 256) -> DataFrame:
    """Adds running totals {name: column} in the order of a column of distinct values, nulls first, not in one task.

    Values are dealt out to slices, summed within these, and the slices before are added. ``source``, a table that has the order's
    column and is cheaper to read, gives the bounds. There is a row for each slice and value of ``by``, which must have few.
    """
    by_ = listed(by)
    if not sliceable(df, order):
        w = before(over(by_, order))
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    df = _sliced(df, order, df if source is None else source, slices)
    parts = df.groupBy(*by_, "_slice").agg(*[F.sum(c).alias(f"_all_{name}") for name, c in sums.items()])
    w = before(over(by_, "_slice"))
    parts = parts.select(*by_, "_slice", *[(F.sum(f"_all_{name}").over(w) - F.col(f"_all_{name}")).alias(f"_off_{name}") for name in sums])
    out = df.join(F.broadcast(parts), [*by_, "_slice"])
    own = before(over([*by_, "_slice"], order))
    return out.withColumns({name: F.sum(c).over(own) + F.col(f"_off_{name}") for name, c in sums.items()}).drop("_slice", *[f"_off_{name}" for name in sums])


def quantiles(df: DataFrame, columns: Names, shares: Iterable[float], ids: Names = None, *, lower: bool | Iterable[bool] = False, slices: int = 256) -> DataFrame:
    """([ids,] variable, q): exact quantiles of each column, linear between ranks, as an array, of the table or of each entity.

    Values are counted, the distinct ones ranked in slices, and the ranks asked for picked: no task holds a column's or an entity's
    values. lower: the least value whose share of the values reaches the one asked for; one answer for all shares, or one for each.
    Columns without values have no row.
    """
    columns, shares, ids = listed(columns), list(shares), listed(ids)
    lowers = [lower] * len(shares) if isinstance(lower, bool) else list(lower)
    long = df.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_x")).select(*ids, "_x.*").where("_v is not null")
    place = [F.greatest(F.ceil(F.col("_n") * F.lit(float(p))) - 1, F.lit(0)) if low else (F.col("_n") - 1) * F.lit(float(p)) for p, low in zip(shares, lowers, strict=True)]
    if ids:
        ranked = _ranked(long, [*ids, "variable"], [f(p) for p in place for f in (F.floor, F.ceil)], slices)
    else:
        runs = long.groupBy("variable", "_v").agg(F.count("*").alias("_m"))
        total = runs.groupBy("variable").agg(F.sum("_m").alias("_n"))  # a row for each column
        ranked = running(runs, "_v", {"_upto": "_m"}, "variable", long, slices).join(F.broadcast(total), "variable")
    at = lambda r: F.max(F.when((F.col("_upto") - F.col("_m") <= r) & (r < F.col("_upto")), F.col("_v")))
    ends = [x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"_lo{i}"), at(F.ceil(p)).alias(f"_hi{i}"))]
    found = ranked.groupBy(*ids, "variable", "_n").agg(*ends)
    value = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}"))
    return found.select(*ids, "variable", F.array(*[value(i, p) for i, p in enumerate(place)]).alias("q"))


#: So many slices of entities that hold a rank asked for are broadcast; with more, the values are shuffled to them.
FEW = 50_000


def _ranked(values: DataFrame, keys: list[str], ranks: list[Column], slices: int) -> DataFrame:
    """The distinct values (keys, _v, _m) of those slices that hold one of the ranks asked for, with _n, the key's rows, and _upto, those up to a value.

    Slices are of the whole table's values, so a key with most rows is in most slices; each (key, slice) is ranked on its own. Rows are
    counted by slice first: only the values of slices asked for are counted one by one.
    """
    values = _sliced(values, "_v", values, slices)
    own = [f"_of_{c}" for c in keys]
    parts = values.groupBy(*[F.col(c).alias(n) for c, n in zip(keys, own, strict=True)], F.col("_slice").alias("_s")).agg(F.count("*").alias("_all"))
    # slices at most for each key
    parts = parts.withColumn("_off", F.sum("_all").over(before(over(own, "_s"))) - F.col("_all")).withColumn("_n", F.sum("_all").over(whole(own)))
    asked = F.lit(False)
    for r in ranks:
        asked = asked | ((F.col("_off") <= r) & (r < F.col("_off") + F.col("_all")))
    parts = parts.where(asked)
    same = F.col("_slice") == F.col("_s")
    for c, n in zip(keys, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    few = parts.limit(FEW + 1).count() <= FEW
    out = values.join(F.broadcast(parts) if few else parts, same).groupBy(*keys, "_slice", "_v", "_n", "_off").agg(F.count("*").alias("_m"))
    return out.withColumn("_upto", F.sum("_m").over(before(over([*keys, "_slice"], "_v"))) + F.col("_off"))


def quantile_row(df: DataFrame, columns: Names, shares: Iterable[float], ids: Names = None, **how) -> DataFrame:
    """quantiles() as one row, or one for each entity: each column is the array of its quantiles, null if it has no values."""
    columns = listed(columns)
    return quantiles(df, columns, shares, ids, **how).groupBy(*listed(ids)).pivot("variable", columns).agg(F.first("q"))


def number_panel(df: DataFrame, ids: Names, order: Names, name: str = "_rn", count: str | None = None, slices: int = 256) -> DataFrame:
    """numbered() for entities too long for one task: each entity's rows are numbered in slices of the first order column, and those of
    its slices before are added. The slices' bounds are of the whole table, so an entity with most rows is in most slices."""
    ids, order = listed(ids), listed(order)
    df = _sliced(df, order[0], df, slices)
    counts = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in ids], F.col("_slice").alias("_s")).agg(F.count("*").alias("_m"))
    entity = [f"_of_{c}" for c in ids]
    # slices at most for each entity
    counts = counts.withColumn("_before", F.sum("_m").over(before(over(entity, "_s"))) - F.col("_m")).withColumn("_total", F.sum("_m").over(whole(entity)))
    same = F.col("_slice") == F.col("_s")
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = df.join(counts, same)
    out = out.withColumn(name, (F.row_number().over(over([*ids, "_slice"], order)) + F.col("_before")).cast("long"))
    out = out.withColumn(count, F.col("_total")) if count else out
    return out.drop("_slice", "_s", "_m", "_before", "_total", *entity)


def number_series(df: DataFrame, order: Names, name: str = "_rn", count: str | None = None, slices: int = 256) -> DataFrame:
    """Numbers the rows of one series in parallel: rows are dealt out to slices of the first order column, whose bounds are
    approximate quantiles, numbered within these, and the slices before are added. Nulls are in the first slice, as in a sort."""
    order = listed(order)
    df = _sliced(df, order[0], df, slices)
    counts = df.groupBy(F.col("_slice").alias("_s")).agg(F.count("*").alias("_m"))
    # a row for each slice: this much passes through one task
    w = Window.orderBy("_s")
    counts = counts.withColumn("_before", F.sum("_m").over(before(w)) - F.col("_m")).withColumn("_total", F.sum("_m").over(Window.partitionBy()))
    out = df.join(F.broadcast(counts), F.col("_slice") == F.col("_s"))
    out = out.withColumn(name, (F.row_number().over(over("_slice", order)) + F.col("_before")).cast("long"))
    out = out.withColumn(count, F.col("_total")) if count else out
    return out.drop("_slice", "_s", "_m", "_before", "_total")


def stats_of(df: DataFrame, exprs: dict[str, Column], by: Names = None) -> DataFrame:
    """Aggregates as a table of a row (for each key)."""
    columns = [c.alias(n) for n, c in exprs.items()]
    return df.groupBy(*listed(by)).agg(*columns) if listed(by) else df.agg(*columns)
