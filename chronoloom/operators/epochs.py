"""Orders drawn at random over whole tables: epochs of batches, exact permutations, draws with replacement.

A permutation is a bijection of row numbers that each row works out for itself, so nothing is sorted by random keys and nothing
is dealt out in blocks: any row can take any place. Results depend on the rows' order and the seed only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import Names, listed, numbered

ROUNDS = 6


def _side(n: int) -> int:
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def place(number: Column, n: int, seed: int | Column = 0, *, inverse: bool = False) -> Column:
    """The place, from 0, of each of n rows numbered from 0, in an order that the seed names: a permutation of 0 to n - 1.

    A Feistel network over pairs of digits to the base of n's root, rounded up. Its few places beyond n, some two roots of n, are
    followed till they lead below n. inverse: the number of the row at a place.
    """
    side = _side(n)
    seed = F.lit(seed) if isinstance(seed, int) else seed
    # As pairs (left, right): left takes on a hash of right, and the two change sides; the inverse undoes that, last round first.
    ahead = lambda s, i: F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], i, seed), F.lit(side)), F.lit(side)).alias("b"))
    back = lambda s, i: F.struct(F.pmod(s["b"] - F.pmod(F.xxhash64(s["a"], i, seed), F.lit(side)), F.lit(side)).alias("a"), s["a"].alias("b"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def once(x: Column) -> Column:
        begin = F.struct(F.floor(x / F.lit(side)).cast("long").alias("a"), F.pmod(x, F.lit(side)).cast("long").alias("b"))
        return F.aggregate(rounds, begin, back if inverse else ahead, lambda s: s["a"] * F.lit(side).cast("long") + s["b"])

    beyond = side * side - n
    first = once(number.cast("long"))
    if not beyond:
        return first
    # A row's cycle has no more than all the places beyond n before it comes below.
    follow = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), x, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.get(F.transform(F.array(first), lambda x: F.when(x < n, x).otherwise(follow(x))), 0)


def _numbered(df: DataFrame, order: Names) -> tuple[DataFrame, int]:
    """df with _row from 0 in a total order, and its number of rows."""
    return numbered(df, None, order, "_row").withColumn("_row", F.col("_row") - 1), df.count()


def epochs(df: DataFrame, order: Names, size: int, n_epochs: int = 1, *, seed: int = 0, shuffle: bool = True, drop_last: bool = False, first: int = 0) -> DataFrame:
    """Each row once in each epoch, with ``epoch``, ``batch`` and ``position`` (within the batch), all from 0.

    The same seed and epoch give the same batches however rows are dealt out; epochs from ``first`` on can be asked for alone, so that
    training goes on where it stopped. Not shuffled: in order. drop_last: the last batch goes if it isn't full.
    """
    df, n = _numbered(df, order)
    df = df.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + n_epochs - 1))))
    at = place(F.col("_row"), n, F.col("epoch") + F.lit(seed * 1_000_003)) if shuffle and n else F.col("_row").cast("long")
    df = df.withColumn("_place", at)
    df = df.where(F.col("_place") < n // size * size) if drop_last else df
    return df.withColumn("batch", F.floor(F.col("_place") / size).cast("long")).withColumn("position", (F.col("_place") % size).cast("int")).drop("_row", "_place")


def batches(df: DataFrame, order: Names, columns: Names, size: int, n_epochs: int = 1, **how) -> DataFrame:
    """(epoch, batch, columns as arrays in order of position): a row for each batch of so many rows, what a trainer's loader reads."""
    columns = listed(columns)
    out = epochs(df.select(*dict.fromkeys([*listed(order), *columns])), order, size, n_epochs, **how)
    rows = out.groupBy("epoch", "batch").agg(F.sort_array(F.collect_list(F.struct("position", *columns))).alias("_rows"))
    return rows.select("epoch", "batch", *[F.col("_rows")[c].alias(c) for c in columns])


def shuffled(df: DataFrame, order: Names, columns: Names, *, seed: int = 0, together: bool = False) -> DataFrame:
    """df with the values of some columns in another order: an exact permutation of all rows for each column, or one for all.

    The rest of each row stays. The values move by one join on row numbers.
    """
    columns, names = listed(columns), df.columns
    df, n = _numbered(df, order)
    for k, group in enumerate([columns] if together else [[c] for c in columns]):
        moved = df.select(place(F.col("_row"), n, seed + k).alias("_row"), *group) if n else df.select("_row", *group)
        df = df.drop(*group).join(moved, "_row")
    return df.select(*names)


def rolled(df: DataFrame, order: Names, columns: Names, by: int) -> DataFrame:
    """df with the values of some columns moved ``by`` rows on, the last ones to the front."""
    columns, names = listed(columns), df.columns
    df, n = _numbered(df, order)
    moved = df.select(F.pmod(F.col("_row") + by, F.lit(max(1, n))).cast("long").alias("_row"), *columns)
    return df.drop(*columns).withColumn("_row", F.col("_row").cast("long")).join(moved, "_row").select(*names)


def shuffled_within(df: DataFrame, x: str, key: Names, *, seed: int = 0) -> DataFrame:
    """df with the steps of each row's array in an order of its own."""
    ranked = F.transform(x, lambda v, i: F.struct(F.xxhash64(i, F.lit(seed), *listed(key)).alias("h"), i.alias("i"), v.alias("v")))
    return df.withColumn(x, F.transform(F.array_sort(ranked), lambda r: r["v"]))


def draws(df: DataFrame, order: Names, n: int, *, weight: str | None = None, seed: int = 0, slices: int = 256) -> DataFrame:
    """Exactly n rows of df with replacement, with ``draw`` from 0; by weights if named (null and negative ones count 0).

    Each draw is a point on a line on which each row has a length, 1 or its weight. Points and rows are dealt out to slices of the line and
    met there in order, so no task holds all of either, and a row drawn very often is so in many slices.
    """
    names = df.columns
    if not weight:
        rows, m = _numbered(df, order)
        if not m:
            return df.withColumn("draw", F.lit(0).cast("long")).where("false")
        picks = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(_unit(F.col("id"), seed) * m).cast("long").alias("_row"))
        return rows.join(picks, "_row").select(*names, "draw")
    length = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows, _ = _numbered(df, order)
    # Rows are summed up by chunks of their numbers: a chunk's own sums, and those of the chunks before.
    chunk = F.floor(F.col("_row") / F.lit(1 << 16))
    rows = rows.withColumns({"_len": length, "_chunk": chunk})
    sums = rows.groupBy("_chunk").agg(F.sum("_len").alias("_sum"))
    w = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("_chunk", (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    total = sums.agg(F.max("_total")).first()[0] or 0.0
    if total <= 0:
        return df.withColumn("draw", F.lit(0).cast("long")).where("false")
    own = Window.partitionBy("_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, "_chunk").where("_len > 0").withColumn("_hi", F.sum("_len").over(own) + F.col("_before")).withColumn("_lo", F.col("_hi") - F.col("_len"))
    slot = lambda x: F.least(F.floor(x / F.lit(total) * slices), F.lit(slices - 1)).cast("int")
    kept = F.struct(*[F.col(c) for c in names])
    spans = rows.select(F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi")))).alias("_slice"), F.col("_lo").alias("_at"), F.col("_row").cast("long").alias("_row"), kept.alias("_kept"))
    point = _unit(F.col("id"), seed) * total
    points = df.sparkSession.range(n).select(slot(point).alias("_slice"), point.alias("_at"), F.col("id").alias("draw"))
    # In each slice a point takes the last row that begins at or before it, and what the row has: there is no join on rows.
    w = Window.partitionBy("_slice").orderBy("_at", F.col("draw").isNotNull(), "_row", "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = spans.unionByName(points, allowMissingColumns=True).withColumn("_kept", F.last("_kept", ignorenulls=True).over(w)).where("draw is not null")
    return met.select(*[F.col("_kept")[c].alias(c) for c in names], "draw")


def _unit(number: Column, seed: int) -> Column:
    """In [0, 1), of 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(number, F.lit(seed)), 11) / F.lit(float(1 << 53))
