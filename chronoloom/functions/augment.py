"""Seeded augmentations and masks of array columns.

A random number is a function of the sample's key, the step, and the seed, so results don't depend on how rows are dealt out.
``key`` is the column(s) that name a sample. All keep the array's length unless they say otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import _c, let, resample, roll, steps, total


def uniform(seed: int, *keys) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *keys))


def integer(n: Column | int, seed: int, *keys) -> Column:
    """From 0 to n - 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(uniform(seed, *keys) * n), n - 1).cast("int")


def gaussian_noise(x, key, magnitude: float = 0.5, *, additive: bool = True, seed: int = 0) -> Column:
    noise = lambda i: magnitude * normal(seed, key, i)
    return F.transform(_c(x), lambda e, i: e + noise(i) if additive else e * (1 + noise(i)))


def scaled_noise(x, key, magnitude: float = 1.0, *, seed: int = 0) -> Column:
    """Noise in the measure of the deviation of the steps' differences."""

    def add(v: Column) -> Column:
        d = F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda e, i: e - F.get(v, i))
        std = let(d, lambda w: F.sqrt(total(F.transform(w, lambda e: (e - total(w) / F.size(w)) * (e - total(w) / F.size(w)))) / F.nullif(F.size(w) - 1, F.lit(0))))
        return let(F.coalesce(std, F.lit(0.0)), lambda s: F.transform(v, lambda e, i: e + magnitude * s * normal(seed, key, i)))

    return let(_c(x), add)


def multiplied_noise(x, key, magnitude: float = 1.0, *, seed: int = 0) -> Column:
    return F.transform(_c(x), lambda e, i: e * (1 + 0.025 * magnitude * normal(seed, key, i)))


def magnitude_scale(x, key, magnitude: float = 0.5, *, seed: int = 0) -> Column:
    """All steps by one factor, smaller in two of three cases."""
    r = F.abs(normal(seed, key)) * magnitude
    return let(F.when(uniform(seed + 7, key) < 1 / 3, 1 + r).otherwise(1 / (1 + r)), lambda s: F.transform(_c(x), lambda e: e * s))


def shuffle_pairs(x, key, magnitude: float = 1.0, *, seed: int = 0) -> Column:
    """Neighbours (2i, 2i + 1) change places with a chance of ``magnitude``."""
    other = lambda i: F.when(i % 2 == 0, i + 1).otherwise(i - 1)
    return let(_c(x), lambda v: F.transform(v, lambda e, i: F.when((uniform(seed, key, F.floor(i / 2)) < magnitude) & (other(i) < F.size(v)), F.get(v, other(i))).otherwise(e)))


def swap_high_low(columns: dict[str, str], key, magnitude: float = 1.0, *, seed: int = 0) -> dict[str, Column]:
    """High and low variables of one bar change places with a chance: columns maps each high to its low. For withColumns."""
    swap = uniform(seed, key) < magnitude
    return {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for h, low in columns.items() for a, b in ((h, low), (low, h))}


def cut(x, key, share: float, *, seed: int = 0) -> Column:
    """A random stretch of the array, which gets shorter."""
    return let(_c(x), lambda v: let(F.greatest(F.lit(1), F.round(F.size(v) * F.lit(share))).cast("int"), lambda n: F.slice(v, integer(F.size(v) - n + 1, seed, key) + 1, n)))


def resized_crop(x, key, magnitude: float = 0.1, *, seed: int = 0) -> Column:
    return let(_c(x), lambda v: resample(cut(v, key, 1 - magnitude, seed=seed), F.size(v)))


def zoom_out(x, key, magnitude: float = 0.1, *, seed: int = 0) -> Column:
    """Shrunk and put at a random place among zeros."""

    def make(v: Column) -> Column:
        n = F.greatest(F.lit(1), F.round(F.size(v) * (1 - magnitude * uniform(seed, key)))).cast("int")
        return let(F.struct(resample(v, n).alias("s"), integer(F.size(v) - n + 1, seed + 1, key).alias("a")), lambda z: F.transform(v, lambda e, i: F.coalesce(F.when(i >= z["a"], F.get(z["s"], i - z["a"])), e * 0)))

    return let(_c(x), make)


def look_back(x, key, magnitude: float = 0.1, *, resize: bool = True, seed: int = 0) -> Column:
    """Without a random first part: the rest resized, or zeros in its place."""

    def make(v: Column) -> Column:
        k = integer(F.greatest(F.lit(1), F.floor(F.size(v) * F.lit(magnitude)).cast("int") + 1), seed, key)
        return resample(F.slice(v, k + 1, F.size(v)), F.size(v)) if resize else F.transform(v, lambda e, i: F.when(i < k, e * 0).otherwise(e))

    return let(_c(x), make)


def drop_steps(x, key, magnitude: float = 0.02, *, seed: int = 0) -> Column:
    """Without a share of random steps, resized."""
    return let(_c(x), lambda v: resample(F.filter(v, lambda e, i: (i == 0) | (uniform(seed, key, i) >= magnitude)), F.size(v)))


def resample_steps(x, key, share: float = 1.0, *, same_length: bool = True, seed: int = 0) -> Column:
    """Steps drawn with replacement, in their order."""

    def make(v: Column) -> Column:
        drawn = F.array_sort(F.transform(steps(F.greatest(F.lit(1), F.floor(F.size(v) * F.lit(share)).cast("int"))), lambda i: integer(F.size(v), seed, key, i)))
        out = F.transform(drawn, lambda i: F.get(v, i))
        return resample(out, F.size(v)) if same_length else out

    return let(_c(x), make)


def shift(x, key, magnitude: float = 0.02, *, seed: int = 0) -> Column:
    """Cyclic, by up to a share of the length."""
    v = _c(x)
    return roll(v, F.round((2 * uniform(seed, key) - 1) * magnitude * F.size(v)).cast("int"))


def translate(x, key, magnitude: float = 0.1, *, seed: int = 0) -> Column:
    """Moved by up to a share of the length, zeros behind."""
    by = lambda v: F.round((2 * uniform(seed, key) - 1) * magnitude * F.size(v)).cast("int")
    return let(_c(x), lambda v: let(by(v), lambda k: F.transform(v, lambda e, i: F.coalesce(F.when(i >= k, F.get(v, i - k)), e * 0))))


def horizontal_flip(x) -> Column:
    return F.reverse(_c(x))


def vertical_flip(x) -> Column:
    return F.transform(_c(x), lambda e: -e)


def trend(x, key, magnitude: float = 0.1, *, seed: int = 0) -> Column:
    """Plus a line of mean zero, steep by a share of the array's range."""

    def make(v: Column) -> Column:
        slope = (2 * uniform(seed, key) - 1) * magnitude * (F.array_max(v) - F.array_min(v))
        return let(slope, lambda s: F.transform(v, lambda e, i: e + s * (i / F.greatest(F.size(v) - 1, F.lit(1)) - 0.5)))

    return let(_c(x), make)


def resize(x, factor: float) -> Column:
    """Changes the length."""
    v = _c(x)
    return resample(v, F.greatest(F.lit(1), F.round(F.size(v) * F.lit(factor))))


def random_resize(x, key, lo: float, hi: float, *, seed: int = 0) -> Column:
    """Changes the length by a random factor."""
    v = _c(x)
    return resample(v, F.greatest(F.lit(1), F.round(F.size(v) * (lo + (hi - lo) * uniform(seed, key)))))


def down_up(x, factor: float | Column = 0.5) -> Column:
    f = F.lit(factor) if isinstance(factor, float) else factor
    return let(_c(x), lambda v: resample(resample(v, F.greatest(F.lit(1), F.round(F.size(v) * f))), F.size(v)))


def random_down_up(x, key, magnitude: float = 0.5, *, seed: int = 0) -> Column:
    return down_up(x, 1 - magnitude * uniform(seed, key))


def masked(x, mask, value: float | None = None) -> Column:
    """The value where the mask holds; nulls by default."""
    return F.zip_with(_c(x), mask, lambda e, m: F.when(m, F.lit(value).cast("double")).otherwise(e))


def bernoulli_mask(n, key, share: float, *, seed: int = 0) -> Column:
    return F.transform(steps(n), lambda i: uniform(seed, key, i) < share)


def section_mask(n, key, magnitude: float, *, outside: bool = False, seed: int = 0) -> Column:
    """A random stretch of up to a share of the steps, or all but it."""
    n = F.lit(n) if isinstance(n, int) else n
    length = F.greatest(F.lit(1), F.round(n * F.lit(magnitude))).cast("int")
    start = integer(n - length + 1, seed, key)
    inside = lambda i: (i >= start) & (i < start + length)
    return F.transform(steps(n), lambda i: ~inside(i) if outside else inside(i))


def subsequence_mask(n, key, share: float = 0.15, mean_length: float = 3.0, *, stateful: bool = True, seed: int = 0) -> Column:
    """Runs of geometric length: masked ones ``mean_length`` on average, the others so long that ``share`` is masked."""
    if not stateful:
        return bernoulli_mask(n, key, share, seed=seed)
    leave, enter = 1 / mean_length, share / (1 - share) / mean_length

    def step(a: Column, i: Column) -> Column:
        last = F.coalesce(F.element_at(a, -1), uniform(seed + 5, key) < share)
        u = uniform(seed, key, i)
        return F.concat(a, F.array(F.when(last, u >= leave).otherwise(u < enter)))

    first = F.array((uniform(seed + 5, key) < share))
    return F.aggregate(steps((F.lit(n) if isinstance(n, int) else n) - 1), first, step)


def variable_mask(variables: int, key, share: float = 0.15, *, seed: int = 0) -> Column:
    """An element for each variable: whether all of it is masked."""
    return F.transform(steps(variables), lambda v: uniform(seed, key, v) < share)


def future_mask(n, key, share: float = 0.15, *, seed: int = 0) -> Column:
    """The last steps, as many as hits in so many draws."""
    hits = F.size(F.filter(bernoulli_mask(n, key, share, seed=seed), lambda m: m))
    n = F.lit(n) if isinstance(n, int) else n
    return let(hits, lambda k: F.transform(steps(n), lambda i: i >= n - k))


def create_mask(n, key, *, share: float = 0.15, mean_length: float = 3.0, subsequence: bool = True, variable: bool = False, future: bool = False, stateful: bool = True, seed: int = 0) -> Column:
    """Any of the asked-for masks' steps."""
    out = None
    parts = [subsequence_mask(n, key, share, mean_length, stateful=stateful, seed=seed)] * subsequence + [future_mask(n, key, share, seed=seed + 11)] * future
    if variable:
        parts.append(let(uniform(seed + 13, key) < share, lambda m: F.transform(steps(n), lambda i: m)))
    for p in parts:
        out = p if out is None else F.zip_with(out, p, lambda a, b: a | b)
    return out if out is not None else F.transform(steps(n), lambda i: F.lit(False))


def dropout(x, key, share: float, *, compensate: bool = True, seed: int = 0) -> Column:
    return F.transform(_c(x), lambda e, i: F.when(uniform(seed, key, i) < share, e * 0).otherwise(e / (1 - share) if compensate else e))


def random_convolution(x, key, magnitude: float = 0.05, sizes=(1, 3, 5, 7), *, seed: int = 0) -> Column:
    """Blended with a convolution by random weights; ends count as zeros."""

    def make(v: Column) -> Column:
        size = F.get(F.array(*[F.lit(s) for s in sizes]), integer(len(sizes), seed, key))
        kernel = F.transform(steps(size), lambda j: normal(seed + 1, key, j) * F.sqrt(F.lit(2.0) / size))
        out = let(kernel, lambda k: F.transform(v, lambda _, i: total(F.transform(k, lambda w, j: w * F.coalesce(F.when(i + j - F.floor(F.size(k) / 2) >= 0, F.get(v, (i + j - F.floor(F.size(k) / 2)).cast("int"))), F.lit(0.0))))))
        return F.zip_with(v, out, lambda e, c: (1 - magnitude) * e + magnitude * c)

    return let(_c(x), make)


#: One-key augmentations by name, for random choice.
CHOICES = {"noise": gaussian_noise, "scale": magnitude_scale, "crop": resized_crop, "zoom_out": zoom_out, "shift": shift, "translate": translate, "trend": trend, "drop_steps": drop_steps, "down_up": random_down_up, "convolution": random_convolution}


def rand_augment(x, key, names: list[str] | None = None, n: int = 1, m: int = 3, *, seed: int = 0) -> Column:
    """n of the named augmentations, drawn once by the seed for the whole table, at a magnitude of m tenths."""
    import random

    rng = random.Random(seed)
    for i, name in enumerate(rng.sample(sorted(names or CHOICES), n)):
        x = CHOICES[name](x, key, m / 10, seed=seed + 101 * i)
    return _c(x)


def drawn(names: list[str], batch, n: int = 1, *, seed: int = 0) -> Column:
    """n different names for each batch, whose number (or struct of epoch and number) is ``batch``, in the order in which they were drawn."""
    if not 0 < n <= len(set(names)):
        raise ValueError(f"can't draw {n} of {len(set(names))} names")
    tickets = F.array(*[F.struct(F.xxhash64(_c(batch), F.lit(name), F.lit(seed)).alias("ticket"), F.lit(name).alias("name")) for name in sorted(set(names))])
    return F.transform(F.slice(F.array_sort(tickets), 1, n), lambda t: t["name"])


def rand_augment_batches(x, key, batch, names: list[str] | None = None, n: int = 1, m: int = 3, *, choices: dict = CHOICES, seed: int = 0) -> Column:
    """n of the named augmentations at a magnitude of m tenths, drawn anew for each batch.

    All samples of a batch are changed in the same ways, each by random numbers of its own, which differ from batch to batch (so
    from epoch to epoch, if ``batch`` is a struct with the epoch). Only the ways drawn are worked out. A null batch is a batch.
    ``choices`` has functions of (x, key, magnitude, seed=) by name.
    """
    names = sorted(set(names or choices))
    own = F.struct(_c(key), _c(batch))

    def change(picked: Column, at: int):
        def run(v: Column) -> Column:  # of one argument: a second one would be taken for an element's place
            out = F.lit(None)
            for name in names:
                out = F.when(F.get(picked, at) == name, choices[name](v, own, m / 10, seed=seed + 101 * at)).otherwise(out)
            return out

        return run

    def run(picked: Column) -> Column:
        out = _c(x)
        for at in range(n):
            out = let(out, change(picked, at))
        return out

    return let(drawn(names, batch, n, seed=seed), run)


def partners(df: DataFrame, key: str, *, seed: int = 0, within: str | None = None, blocks: int = 1 << 12) -> DataFrame:
    """Each row's partner (as columns other_*) in a random cyclic order, within a class if asked for.

    The order is dealt out in blocks by hash, so that no task holds all rows; a block's last row pairs with its first.
    """
    by = [F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(blocks)), *([F.col(within)] if within else [])]
    w = Window.partitionBy(*by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"other_{c}": F.coalesce(F.lead(F.struct(c), 1).over(w), F.first(F.struct(c)).over(ends))[c] for c in df.columns})


def mixup(df: DataFrame, x: str, y: str, key: str, alpha: float = 0.4, *, seed: int = 0, blocks: int = 1 << 12) -> DataFrame:
    """x and y (a number or an array) drawn towards a partner's by a share that is symmetric around a half and at most it."""
    df = partners(df, key, seed=seed, blocks=blocks)
    share = F.pow(uniform(seed + 3, key), F.lit(1 / alpha)) / 2
    blend = lambda a, b: (1 - F.col("_share")) * a + F.col("_share") * b
    array = df.schema[y].dataType.typeName() == "array"
    df = df.withColumn("_share", share)
    df = df.withColumns({x: F.zip_with(x, f"other_{x}", blend), y: F.zip_with(y, f"other_{y}", blend) if array else blend(F.col(y), F.col(f"other_{y}")), "mix": F.col("_share")})
    return df.drop("_share", *[c for c in df.columns if c.startswith("other_")])


def cutmix(df: DataFrame, x: str, key: str, magnitude: float = 0.3, *, seed: int = 0, within: str | None = None, blocks: int = 1 << 12) -> DataFrame:
    """A random section of x from a partner; adds mix, the section's share, for the labels."""
    df = partners(df, key, seed=seed, within=within, blocks=blocks)
    mask = section_mask(F.size(x), F.col(key), magnitude, seed=seed + 3)
    df = df.withColumn("_m", mask)
    mixed = F.transform(x, lambda e, i: F.when(F.get("_m", i), F.get(f"other_{x}", i)).otherwise(e))
    df = df.withColumn("mix", F.size(F.filter("_m", lambda m: m)) / F.size("_m")).withColumn(x, mixed)
    return df.drop("_m", *[c for c in df.columns if c.startswith("other_") and c != "other_label"])
