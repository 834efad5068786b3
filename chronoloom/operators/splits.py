"""Splits as columns: a row's split is an expression of its key, place or time, never a list of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import Names, listed, numbered, whole


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from a row's keys and a seed: the same however the rows are dealt out."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number from a row's keys and a seed."""
    u, v = uniform(seed, *keys), uniform(seed + 1_000_003, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(6.283185307179586 * v)


def ordered_split(df: DataFrame, order: Names, ids: Names = None, *, valid: float | int = 0.2, test: float | int = 0.0, horizon: int = 0) -> DataFrame:
    """split: train, valid, test in order; the rows just before a cut whose targets reach over it get null.

    Sizes are rows, or shares that are rounded to rows. horizon: as many steps as targets lie ahead.
    """
    df = numbered(df, ids, order, "_rn", "_n")
    size = lambda x: F.lit(x) if isinstance(x, int) else F.round(F.col("_n") * F.lit(x)).cast("int")
    last = F.col("_n") - size(test)
    first = last - size(valid)
    gap = max(0, horizon - 1)
    split = F.when(F.col("_rn") > last, "test").when((F.col("_rn") > first) & (F.col("_rn") <= last - (gap if test else 0)), "valid").when(F.col("_rn") <= first - gap, "train")
    return df.withColumn("split", split).drop("_rn", "_n")


def walk_forward(df: DataFrame, order: Names, folds: int, *, valid: float | int = 0.2, test: float | int = 0.0, train: float | int | None = None, anchored: bool = True, gap: float | int = 0, test_after_valid: bool = True) -> DataFrame:
    """Rows by fold, oldest fold first, with split; a row is in as many folds as it serves.

    Each fold takes valid and test rows from the end of what the next fold leaves. anchored: the train rows are all
    before these but for the gap, otherwise the last ``train`` of them. For one series.
    """
    if not anchored and train is None:
        raise ValueError("a moving train window needs its size")
    df = numbered(df, None, order, "_rn", "_n")
    size = lambda x: F.lit(x) if isinstance(x, int) else F.round(F.col("_n") * F.lit(x)).cast("int")
    v, t, g = size(valid), size(test), size(gap)
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    df = df.withColumn("fold", fold)
    if test_after_valid:
        end = F.col("_n") - (folds - 1 - F.col("fold")) * (v + t)
        valid_end, test_start, test_end, valid_start = end - t, end - t, end, end - t - v
        train_end = valid_start - g
    else:
        end = F.col("_n") - (folds - 1 - F.col("fold")) * v
        valid_end, valid_start = end, end - v
        test_end, test_start = valid_start, valid_start - t
        train_end = test_start - g
    train_start = F.lit(0) if anchored else F.greatest(F.lit(0), train_end - size(train))
    rn = F.col("_rn")
    split = F.when((rn > valid_start) & (rn <= valid_end), "valid").when((rn > test_start) & (rn <= test_end), "test").when((rn > train_start) & (rn <= train_end), "train")
    return df.withColumn("split", split).where("split is not null").withColumn("fold", F.col("fold").cast("long")).drop("_rn", "_n")


def forecasting_split(anchors: DataFrame, time: str, horizon: int, *, stride: int = 1, valid: float | int = 0.0, test: float | int = 0.2, valid_from: str | None = None, test_from: str | None = None) -> DataFrame:
    """split of a panel's anchors by distinct times, the same for all entities.

    test and valid are the last times; between splits (horizon - 1) // stride times are left out, so that no target is
    in two. Cut-off times override sizes.
    """
    purge = (horizon - 1) // stride
    times = anchors.select(time).distinct()
    # distinct times only: one number for each, ordered over the calendar's length
    codes = numbered(times, None, time, "_code", "_n")
    size = lambda x: F.lit(x) if isinstance(x, int) else F.round(F.col("_n") * F.lit(float(x))).cast("int")
    cut = lambda at: F.coalesce(F.min(F.when(F.col(time) >= F.lit(at).cast(anchors.schema[time].dataType), F.col("_code"))).over(Window.partitionBy()), F.col("_n") + 1)
    codes = codes.withColumn("_test", cut(test_from) if test_from else F.col("_n") - size(test) + 1)
    codes = codes.withColumn("_valid", cut(valid_from) if valid_from else F.col("_test") - (F.lit(purge) if test or test_from else F.lit(0)) - size(valid))
    has_valid, has_test = bool(valid or valid_from), bool(test or test_from)
    c = F.col("_code")
    valid_end = F.col("_test") - 1 - (purge if has_test else 0)
    train_end = (F.col("_valid") - 1 - purge) if has_valid else valid_end
    split = F.when((c >= F.col("_test")) & F.lit(has_test), "test").when(F.lit(has_valid) & (c >= F.col("_valid")) & (c <= valid_end), "valid").when(c <= train_end, "train")
    return anchors.join(codes.select(F.col(time).alias("_time"), split.alias("split")), F.col(time) == F.col("_time"), "left").drop("_time")


def long_term_borders(n: int, history: int, kind: str | None = None) -> dict[str, tuple[int, int]]:
    """Row ranges (from, to) of the long-horizon benchmarks' splits; valid and test reach back by the history.

    ETTh and ETTm: 12, 4 and 4 months of 30 days, hourly or quarter-hourly; others: 7 / 1 / 2 tenths.
    """
    if kind and kind.lower().startswith("ett"):
        month = 30 * 24 * (4 if kind.lower().startswith("ettm") else 1)
        a, b, c = 12 * month, 16 * month, 20 * month
    else:
        a, c = int(n * 0.7), n
        b = n - int(n * 0.2)
    return {"train": (0, a), "valid": (a - history, b), "test": (b - history, c)}


def long_term_split(df: DataFrame, order: Names, history: int, horizon: int, kind: str | None = None) -> DataFrame:
    """Anchors (last history rows) with their split, a row for each split that an anchor serves. For one series."""
    df = numbered(df, None, order, "_rn", "_n")
    n = F.col("_n")
    if kind and kind.lower().startswith("ett"):
        fixed = long_term_borders(0, history, kind)
        borders = {k: (F.lit(a), F.lit(b)) for k, (a, b) in fixed.items()}
    else:
        a, b = F.floor(n * F.lit(0.7)), n - F.floor(n * F.lit(0.2))
        borders = {"train": (F.lit(0), a), "valid": (a - history, b), "test": (b - history, n)}
    rn = F.col("_rn")
    names = [F.when((rn - history >= lo) & (rn + horizon <= hi), F.lit(k)) for k, (lo, hi) in borders.items()]
    return df.withColumn("split", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull()))).drop("_rn", "_n")


def random_split(df: DataFrame, key: Names, *, valid: float = 0.2, test: float = 0.0, seed: int = 0, stratify: Names = None) -> DataFrame:
    """split by rank of a hash of the key: exact shares (rounded), in each stratum if asked for. Needs a sort within strata.

    Without strata the hash is compared with the shares instead, which moves no row; shares are then met on average.
    """
    if not listed(stratify):
        u = uniform(seed, *listed(key))
        return df.withColumn("split", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))
    w = Window.partitionBy(*listed(stratify)).orderBy(F.xxhash64(*listed(key), F.lit(seed)), *listed(key))
    df = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole(stratify)))
    t, v = F.round(F.col("_n") * test), F.round(F.col("_n") * valid)
    return df.withColumn("split", F.when(F.col("_r") <= t, "test").when(F.col("_r") <= t + v, "valid").otherwise("train")).drop("_r", "_n")


def k_fold(df: DataFrame, key: Names, folds: int, *, seed: int = 0, stratify: Names = None) -> DataFrame:
    """fold, from 0: by hash, or evenly within each stratum."""
    if not listed(stratify):
        return df.withColumn("fold", F.pmod(F.xxhash64(*listed(key), F.lit(seed)), F.lit(folds)))
    w = Window.partitionBy(*listed(stratify)).orderBy(F.xxhash64(*listed(key), F.lit(seed)), *listed(key))
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("long"))


def balance(df: DataFrame, label: str, key: Names, *, oversample: bool = True, seed: int = 0) -> DataFrame:
    """As many rows of each class: of the largest by repeating rows evenly, or of the smallest by hash rank. Adds copy."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    edge = counts.agg((F.max if oversample else F.min)("_n").alias("_to"))
    counts = counts.join(F.broadcast(edge))
    w = Window.partitionBy(label).orderBy(F.xxhash64(*listed(key), F.lit(seed)), *listed(key))
    df = df.withColumn("_r", F.row_number().over(w)).join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label")))
    if not oversample:
        return df.where(F.col("_r") <= F.col("_to")).withColumn("copy", F.lit(0).cast("long")).drop("_r", "_label", "_n", "_to")
    times = F.floor(F.col("_to") / F.col("_n")) + F.when(F.col("_r") <= F.col("_to") % F.col("_n"), 1).otherwise(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("_r", "_label", "_n", "_to")


def predefined_split(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables as one, with their names as split."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def overlap(df: DataFrame, key: Names, split: str = "split") -> DataFrame:
    """Keys in more than one split; empty if nothing leaks."""
    return df.where(F.col(split).isNotNull()).groupBy(*listed(key)).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows over classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def batches(df: DataFrame, order: Names, size: int, *, drop_last: bool = False) -> DataFrame:
    """batch, from 0, along the order. Only for tables of samples that fit one sort; use partitions as batches beyond."""
    df = numbered(df, None, order, "_rn", "_n")
    df = df.where(F.col("_rn") <= F.col("_n") - F.col("_n") % size) if drop_last else df
    return df.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_rn", "_n")
