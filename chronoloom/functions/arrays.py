"""Kernels on arrays of doubles as higher-order functions: shapes, resampling, filters, patches and images."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value) with value worked out once: an expression within a lambda is otherwise worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def steps(n: Column | int) -> Column:
    """0 to n - 1; empty for 0."""
    n = F.lit(n) if isinstance(n, int) else n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def pad(x: str | Column, size: int, value: float | None = None, *, before: bool = True, cut_before: bool = True) -> Column:
    """To a length: padded before or after, cut before or after."""
    x = _c(x)
    fill = F.array_repeat(F.lit(value).cast("double"), F.greatest(F.lit(0), F.lit(size) - F.size(x)))
    cut = F.slice(x, F.greatest(F.lit(1), F.size(x) - size + 1) if cut_before else F.lit(1), F.lit(size))
    return F.concat(fill, cut) if before else F.concat(cut, fill)


def roll(x: str | Column, by: int | Column) -> Column:
    """Cyclically: element i goes to i + by."""
    by = F.lit(by) if isinstance(by, int) else by
    return let(_c(x), lambda v: F.transform(v, lambda _, i: F.get(v, F.pmod(i - by, F.size(v)).cast("int"))))


def resample(x: str | Column, size: int | Column) -> Column:
    """To a length by nearest neighbours: element i is element floor(i * n / size)."""
    size = F.lit(size) if isinstance(size, int) else size.cast("int")
    return let(_c(x), lambda v: F.transform(steps(size), lambda i: F.get(v, F.floor(i * F.size(v) / size).cast("int"))))


def filtered(x: str | Column, kernel: list[float]) -> Column:
    """Weighted sums of neighbours; beyond the ends the end's value is repeated."""
    half = len(kernel) // 2
    at = lambda v, i: F.get(v, F.least(F.greatest(i, F.lit(0)), F.size(v) - 1))
    return let(_c(x), lambda v: F.transform(v, lambda _, i: sum((k * at(v, i + j - half) for j, k in enumerate(kernel) if k), F.lit(0.0))))


def blur(x: str | Column) -> Column:
    return filtered(x, [0.5, 0.0, 0.5])


def smooth(x: str | Column) -> Column:
    return filtered(x, [1 / 7, 5 / 7, 1 / 7])


def patches(x: str | Column, size: int, stride: int | None = None, *, pad_before: bool = True, value: float = 0.0, reduce: str = "none") -> Column:
    """Windows of an array, which is padded so that none is cut. reduce: none, mean, min, max or mode of each."""
    stride = stride or size
    v = _c(x)
    lack = F.pmod(F.lit(stride) - F.pmod(F.size(v) - size, F.lit(stride)), F.lit(stride))
    lack = F.when(F.size(v) < size, F.lit(size) - F.size(v)).otherwise(lack)
    fill = F.array_repeat(F.lit(value), lack.cast("int"))
    full = F.concat(fill, v) if pad_before else F.concat(v, fill)
    cut = let(full, lambda f: F.transform(steps(F.floor((F.size(f) - size) / stride) + 1), lambda i: F.slice(f, i * stride + 1, F.lit(size))))
    one = {"none": lambda p: p, "min": F.array_min, "max": F.array_max, "mode": most_frequent, "mean": lambda p: F.aggregate(p, F.lit(0.0), lambda a, e: a + e) / F.size(p)}[reduce]
    return F.transform(cut, one) if reduce != "none" else cut


def total(x: str | Column) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, e: a + F.coalesce(e.cast("double"), F.lit(0.0)))


def mean(x: str | Column) -> Column:
    return let(F.filter(_c(x), lambda e: e.isNotNull()), lambda v: total(v) / F.nullif(F.size(v), F.lit(0)))


def rescaled(x: str | Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """From the array's least and greatest value to lo and hi; a constant array to lo."""
    return let(_c(x), lambda v: let(F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b")), lambda s: F.transform(v, lambda e: F.when(s["b"] == s["a"], F.lit(lo)).otherwise(lo + (hi - lo) * (e - s["a"]) / (s["b"] - s["a"])))))


def gramian(x: str | Column, *, difference: bool = False) -> Column:
    """Gramian angular field of an array in [-1, 1]: cos of the angles' sums, or sin of their differences."""
    root = lambda e: F.sqrt(F.greatest(F.lit(0.0), 1 - e * e))
    cell = (lambda a, b: root(a) * b - a * root(b)) if difference else (lambda a, b: a * b - root(a) * root(b))
    return let(_c(x), lambda v: F.transform(v, lambda a: F.transform(v, lambda b: cell(a, b))))


def recurrence(x: str | Column) -> Column:
    """Distances of all pairs of steps."""
    return let(_c(x), lambda v: F.transform(v, lambda a: F.transform(v, lambda b: F.abs(a - b))))


def joint_recurrence(*xs: str | Column) -> Column:
    """The product of several variables' distances."""
    first, *rest = [recurrence(x) for x in xs]
    for r in rest:
        first = F.zip_with(first, r, lambda p, q: F.zip_with(p, q, lambda a, b: a * b))
    return first


def markov_field(x: str | Column, bins: int = 5) -> Column:
    """Markov transition field: for steps i and j, the chance to go from i's quantile bin to j's."""

    def states(v: Column) -> Column:
        s = F.array_sort(v)
        edge = lambda k: let(F.lit(k / bins) * (F.size(v) - 1), lambda p: F.get(s, F.floor(p).cast("int")) + (F.get(s, F.ceil(p).cast("int")) - F.get(s, F.floor(p).cast("int"))) * (p - F.floor(p)))
        return let(F.array(*[edge(k) for k in range(1, bins)]), lambda e: F.transform(v, lambda a: F.size(F.filter(e, lambda q: q < a))))

    def field(q: Column) -> Column:
        moves = F.transform(F.slice(q, 1, F.greatest(F.size(q) - 1, F.lit(0))), lambda a, i: a * bins + F.get(q, i + 1))
        counts = let(moves, lambda m: F.transform(steps(bins * bins), lambda k: F.size(F.filter(m, lambda e: e == k)).cast("double")))
        shares = let(counts, lambda c: F.transform(c, lambda e, k: F.coalesce(e / F.nullif(total(F.slice(c, (F.floor(k / bins) * bins + 1).cast("int"), F.lit(bins))), F.lit(0.0)), F.lit(0.0))))
        return let(shares, lambda p: F.transform(q, lambda a: F.transform(q, lambda b: F.get(p, a * bins + b))))

    return let(_c(x), lambda v: let(states(v), field))


def take(x: str | Column, places: list[int]) -> Column:
    """The steps at the given places; negative ones count from the end."""
    return let(_c(x), lambda v: F.array(*[F.get(v, F.lit(p)) if p >= 0 else F.element_at(v, p) for p in places]))


def mark_padding(mask: str | Column, value: float = -1.0) -> Column:
    """A mask of 1 (missing) and 0 whose last steps are all missing gets the value there."""
    return let(_c(mask), lambda m: let(F.array_max(F.transform(m, lambda e, i: F.when(e != 1, i).otherwise(-1))), lambda last: F.transform(m, lambda e, i: F.when(i > last, F.lit(value)).otherwise(e))))


def most_frequent(x: str | Column) -> Column:
    """Of equals the least."""
    return let(_c(x), lambda v: F.get(F.array_sort(F.transform(F.array_distinct(v), lambda e: F.struct((-F.size(F.filter(v, lambda o: o == e))).alias("n"), e.alias("e")))), 0)["e"])


def one_hot(value: str | Column, classes: int) -> Column:
    return F.transform(steps(classes), lambda i: (i == _c(value)).cast("int"))


def from_one_hot(x: str | Column) -> Column:
    """The place of the largest element."""
    return F.array_position(_c(x), F.array_max(_c(x))) - 1


def keep_if(x: str | Column, condition, *, every: bool = True) -> Column:
    return F.forall(_c(x), condition) if every else F.exists(_c(x), condition)


def softmax(x: str | Column) -> Column:
    return let(_c(x), lambda v: let(F.transform(v, lambda e: F.exp(e - F.array_max(v))), lambda w: F.transform(w, lambda e: e / total(w))))


def mean_deviation(x: str | Column) -> Column:
    """Mean absolute difference from the mean, of the values that aren't null; null if there is none."""
    return let(F.filter(_c(x), lambda e: e.isNotNull()), lambda v: let(total(v) / F.nullif(F.size(v), F.lit(0)), lambda m: total(F.transform(v, lambda e: F.abs(e - m))) / F.nullif(F.size(v), F.lit(0))))


def savgol(window: int, order: int) -> list[list[float]]:
    """Rows of weights: a polynomial fit to ``window`` values, taken at each of them."""
    import numpy as np

    a = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def savgol_smoothed(x: str | Column, window: int, order: int) -> Column:
    """Savitzky-Golay; at the ends the values of the ends' polynomials. Arrays shorter than the window stay."""
    rows = savgol(window, order)
    half = window // 2
    table = F.array(*[F.array(*[F.lit(w) for w in r]) for r in rows])

    def at(v: Column, i: Column) -> Column:
        lo = F.least(F.greatest(i - half, F.lit(0)), F.size(v) - window)
        return total(F.zip_with(F.slice(v, lo + 1, F.lit(window)), F.get(table, i - lo), lambda a, b: a * b))

    return let(_c(x), lambda v: F.when(F.size(v) < window, v).otherwise(F.transform(v, lambda _, i: at(v, i))))


def savgol_window(n: int, wanted: int, order: int) -> int | None:
    """The largest odd window up to the wanted one that n values allow; None if that is too small for the order."""
    w = min(wanted, n if n % 2 else n - 1)
    w -= 1 - w % 2
    return w if w >= order + 2 else None


def interpolated(x: str | Column) -> Column:
    """Nulls by straight lines, held at the ends; all null: zeros. One pass each way over the array."""

    def done(v: Column) -> Column:
        known = F.filter(F.transform(v, lambda e, i: F.when(e.isNotNull(), F.struct(i.alias("i"), e.cast("double").alias("e")))), lambda s: s.isNotNull())

        def fill(k: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                a = F.element_at(F.filter(k, lambda s: s["i"] <= i), -1)
                b = F.get(F.filter(k, lambda s: s["i"] >= i), 0)
                p = F.when(F.exists(k, lambda s: s["i"] <= i), a)
                line = p["e"] + (b["e"] - p["e"]) * (i - p["i"]) / F.nullif(b["i"] - p["i"], F.lit(0))
                return F.when(e.isNotNull(), e.cast("double")).otherwise(F.coalesce(line, p["e"], b["e"], F.lit(0.0)))

            return F.transform(v, one)

        return let(known, fill)

    return let(_c(x), done)


def sincos_table(n: int) -> list[tuple[float, float]]:
    return [(math.sin(2 * math.pi * i / n), math.cos(2 * math.pi * i / n)) for i in range(n)]
