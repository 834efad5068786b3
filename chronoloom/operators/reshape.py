"""From long tables to samples and back, and small conveniences on keys and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import Names, listed, numbered


def to_samples(df: DataFrame, sample: Names, order: Names, data: Names, target: str | None = None, *, target_by: str = "mode", length: int | None = None) -> DataFrame:
    """(sample, an array for each data column, target): steps in their order, nulls in their places.

    target: the most frequent value of the sample's rows (of equals the least), its first, last or mean. length: raises unless
    all samples have it (0: unless all have the same).
    """
    order, data = listed(order), listed(data)
    step = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"d{i}") for i, c in enumerate(data)])
    last = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    how = {"mode": lambda: F.mode(target, True), "first": lambda: F.min_by(target, last), "last": lambda: F.max_by(target, last), "mean": lambda: F.avg(target)}
    aggs = [F.array_sort(F.collect_list(step)).alias("_s"), *([how[target_by]().alias(target)] if target else [])]
    out = df.groupBy(*listed(sample)).agg(*aggs)
    if length is not None:
        lo, hi = out.agg(F.min(F.size("_s")), F.max(F.size("_s"))).first()
        if lo != hi or length and lo != length:
            raise ValueError(f"samples have {lo} to {hi} steps")
    return out.select(*listed(sample), *[_member(f"d{i}").alias(c) for i, c in enumerate(data)], *([target] if target else []))


def order_rows(df: DataFrame, columns: Names, ascending: bool | list[bool] = True, *, na_position: str = "last", key=None) -> DataFrame:
    """Rows by columns, or by ``key`` of each; nulls and NaN first or last whichever way a column runs. Ties are in any order: name a column that breaks them."""
    if na_position not in ("first", "last"):
        raise ValueError(f"na_position is first or last, not {na_position}")
    columns = listed(columns)
    ways = ascending if isinstance(ascending, list) else [ascending] * len(columns)
    if len(ways) != len(columns):
        raise ValueError("as many directions as columns")
    by = []
    for c, up in zip(columns, ways, strict=True):
        v = key(F.col(c)) if key else F.col(c)
        if df.schema[c].dataType.typeName() in ("double", "float"):
            v = F.when(~F.isnan(c), v)
        by.append({(True, "first"): v.asc_nulls_first, (True, "last"): v.asc_nulls_last, (False, "first"): v.desc_nulls_first, (False, "last"): v.desc_nulls_last}[up, na_position]())
    return df.orderBy(*by)


def to_times(df: DataFrame, columns: Names, format: str | None = None) -> DataFrame:
    """String columns all of whose values are times (by Spark's pattern, if given) as timestamps; other columns stay as they are."""
    texts = [c for c in listed(columns) if df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return df
    time = lambda c: F.try_to_timestamp(c, *([F.lit(format)] if format else []))
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & time(F.col(c)).isNull()).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    return df.withColumns({c: time(F.col(c)) for i, c in enumerate(texts) if not bad[i]})


def _member(name: str) -> Column:
    return F.transform("_s", lambda s: s[name])


def first_rows(df: DataFrame, column: str, order: Names, values: list) -> DataFrame:
    """(value, position): the place, from 0, of the first row with each of the values."""
    rows = numbered(df.select(column, *[c for c in listed(order) if c != column]), None, order, "_p").where(F.col(column).isin(values))
    return rows.groupBy(F.col(column).alias("value")).agg((F.min("_p") - 1).cast("long").alias("position"))


def codes(df: DataFrame, columns: Names) -> DataFrame:
    """(variable, value, code): the distinct values of each column as text, numbered in their order."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in listed(columns)])).alias("x")).select("x.*").where("value is not null").distinct()
    return long.withColumn("code", (F.row_number().over(Window.partitionBy("variable").orderBy("value")) - 1).cast("long"))


def zero_blocks(df: DataFrame, variables: list[str], length: int, stride: int, *, keep: bool = False) -> DataFrame:
    """Copies of each sample with one variable's block of steps at 0; adds zeroed and block. keep: the sample as it is too."""
    made = [F.struct(F.lit(v).alias("zeroed"), F.lit(b).alias("block")) for v in variables for b in range(-(-length // stride))]
    if keep:
        made.insert(0, F.struct(F.lit(None).cast("string").alias("zeroed"), F.lit(None).cast("int").alias("block")))
    out = df.withColumn("_z", F.explode(F.array(*made)))
    inside = lambda i: (i >= F.col("_z.block") * stride) & (i < (F.col("_z.block") + 1) * stride)
    blank = lambda v: F.when(F.col("_z.zeroed") == v, F.transform(v, lambda e, i: F.when(inside(i), e * 0).otherwise(e))).otherwise(F.col(v))
    return out.withColumns({v: blank(v) for v in variables}).select("*", "_z.zeroed", "_z.block").drop("_z")


def copy_missing(df: DataFrame, x: str, order: Names) -> DataFrame:
    """Where the sample before has no value, this one loses its own; the first looks at the last. For tables of samples."""
    rows = numbered(df, None, order, "_p", "_t")
    before = rows.select((F.col("_p") % F.col("_t") + 1).alias("_p"), F.col(x).alias("_b"))
    return rows.join(before, "_p").withColumn(x, F.transform(x, lambda e, i: F.when(F.get("_b", i).isNotNull(), e))).select(*df.columns)


def drop_by_key(df: DataFrame, x: Names, key: str, chances: dict, row_key: str, *, seed: int = 0) -> DataFrame:
    """Steps of array columns become null with a chance that depends on the row's key value; other keys keep all."""
    from ..functions.augment import uniform

    table = F.create_map(*[F.lit(v) for kv in chances.items() for v in kv])
    chance = F.coalesce(F.try_element_at(table, F.col(key)), F.lit(0.0))
    lose = lambda c: F.transform(c, lambda e, i: F.when(uniform(seed, F.lit(c), F.col(row_key), i) >= chance, e))
    return df.withColumns({c: lose(c) for c in listed(x)})


def trend(df: DataFrame, x: str, y: str, ids: Names, name: str = "trend") -> DataFrame:
    """Adds the straight line of least squares through (x, y) of each group, at each row.

    Slopes and intercepts are one aggregate with partial sums and joined by group, which Spark broadcasts where they are few: no task
    holds a group. Null ids are a group of their own.
    """
    ids = listed(ids)
    lines = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in ids]).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"))
    same = F.lit(True)
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = df.join(lines, same, "left").withColumn(name, F.col("_intercept") + F.col("_slope") * F.col(x))
    return out.drop("_slope", "_intercept", *[f"_of_{c}" for c in ids])


def human_size(c: str | Column, decimals: int = 2) -> Column:
    """Bytes as text in the largest fitting unit."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.concat(F.format_number(c.cast("double"), decimals), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(c >= 1024**i, F.concat(F.format_number(c / 1024**i, decimals), F.lit(f" {unit}"))).otherwise(out)
    return out


def random_statistics(df: DataFrame, value: str, key: str, batches: int = 64, *, seed: int = 0) -> dict[str, float]:
    """Mean and deviation of batch means and batch deviations, over batches dealt out by hash."""
    each = df.groupBy(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)).alias("b")).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    row = each.agg(F.avg("m").alias("mean_mean"), F.stddev_samp("m").alias("mean_std"), F.avg("s").alias("std_mean"), F.stddev_samp("s").alias("std_std")).first()
    return row.asDict()


def gaussian_standardize(c: str, stats: dict[str, float], seed: int = 0, eps: float = 1e-8) -> Column:
    """By a mean and deviation drawn once around the batches' ones."""
    import random

    rng = random.Random(seed)
    mean = rng.gauss(stats["mean_mean"], stats["mean_std"] or 0.0)
    std = max(eps, rng.gauss(stats["std_mean"], stats["std_std"] or 0.0))
    return (F.col(c) - mean) / std


def sample_rows(df: DataFrame, n: int, key: Names, *, weight: str | None = None, seed: int = 0) -> DataFrame:
    """n rows without replacement, by hash; with weights by the smallest of -log(u) / weight."""
    from ..functions.augment import uniform

    u = uniform(seed, *listed(key))
    rank = -F.log(F.greatest(u, F.lit(1e-12))) / F.col(weight) if weight else u
    return df.withColumn("_u", rank).orderBy("_u", *listed(key)).limit(n).drop("_u")


def bootstrap(df: DataFrame, key: Names, *, seed: int = 0, most: int = 12) -> DataFrame:
    """Rows with replacement: each as often as a Poisson number of mean 1 says, which no row needs another for. Adds draw."""
    from math import exp, factorial

    from ..functions.augment import uniform

    u, total, times = uniform(seed, *listed(key)), 0.0, F.lit(most)
    bounds = []
    for k in range(most):
        total += exp(-1) / factorial(k)
        bounds.append(total)
    for k in range(most - 1, -1, -1):
        times = F.when(u < bounds[k], k).otherwise(times)
    return df.withColumn("draw", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
