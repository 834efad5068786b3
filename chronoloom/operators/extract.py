"""Features of whole series, chosen by a table of settings and worked out in one Arrow pass over array columns.

Settings are ``{calculator: None or [parameters, ...]}``; a feature's column is ``variable__calculator__parameter_value``. MINIMAL and
EFFICIENT have a cost in proportion to a series' length (or its logarithm times it); COMPREHENSIVE adds entropies that compare all
pairs of places. Null steps and NaN are left out. What a series is too short for, or what divides by zero, is null.
"""

from __future__ import annotations

import inspect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .frame import Names, listed

CALCULATORS: dict = {}


def calculator(f):
    CALCULATORS[f.__name__] = f
    return f


def _ratio(a: float, b: float) -> float:
    return a / b if b else math.nan


def _sum(x) -> float:
    """Added one after the other, as SQL adds rows: NumPy's pairwise sums end in other digits, which rounding at a tie shows."""
    return np.add.accumulate(x)[-1] if len(x) else 0.0


def _mean(x) -> float:
    return _sum(x) / len(x)


# Of the values, whatever their order


@calculator
def length(x):
    return len(x)


@calculator
def sum_values(x):
    return _sum(x)


@calculator
def mean(x):
    return _mean(x)


@calculator
def median(x):
    return np.median(x)


@calculator
def standard_deviation(x):
    return x.std()


@calculator
def variance(x):
    return x.var()


@calculator
def root_mean_square(x):
    return math.sqrt(_mean(x * x))


@calculator
def maximum(x):
    return x.max()


@calculator
def absolute_maximum(x):
    return np.abs(x).max()


@calculator
def minimum(x):
    return x.min()


@calculator
def abs_energy(x):
    return _sum(x * x)


@calculator
def quantile(x, q):
    return np.quantile(x, q)


@calculator
def variation_coefficient(x):
    return _ratio(x.std(), _mean(x))


@calculator
def skewness(x):
    """Adjusted for the sample's size."""
    n, d = len(x), x - x.mean()
    return _ratio(n * math.sqrt(n - 1) * (d**3).sum(), (n - 2) * (d @ d) ** 1.5) if n > 2 else math.nan


@calculator
def kurtosis(x):
    """Excess, adjusted for the sample's size."""
    n, d = len(x), x - x.mean()
    if n < 4 or not d @ d:
        return math.nan
    return n * (n + 1) * (n - 1) / ((n - 2) * (n - 3)) * (d**4).sum() / (d @ d) ** 2 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))


@calculator
def count_above_mean(x):
    return (x > _mean(x)).sum()


@calculator
def count_below_mean(x):
    return (x < _mean(x)).sum()


@calculator
def ratio_beyond_sigma(x, r):
    """The share of values more than r deviations from the mean."""
    return (np.abs(x - _mean(x)) > r * x.std()).mean()


@calculator
def share_of_distinct_values(x):
    return len(np.unique(x)) / len(x)


@calculator
def binned_entropy(x, bins):
    """Of the values' shares in bins of equal width."""
    if not np.isfinite(x).all():
        return math.nan
    p = np.histogram(x, bins)[0] / len(x)
    return -(p[p > 0] * np.log(p[p > 0])).sum()


# Of changes


@calculator
def absolute_sum_of_changes(x):
    return _sum(np.abs(np.diff(x)))


@calculator
def mean_abs_change(x):
    return _mean(np.abs(np.diff(x))) if len(x) > 1 else math.nan


@calculator
def mean_change(x):
    return _mean(np.diff(x)) if len(x) > 1 else math.nan


@calculator
def mean_second_derivative(x):
    """The mean of half the second differences."""
    return _sum(x[2:] - 2 * x[1:-1] + x[:-2]) / (2 * (len(x) - 2)) if len(x) > 2 else math.nan


@calculator
def complexity(x, normalize):
    """The root of the summed squares of changes, of the standardised series if asked for."""
    if normalize:
        if not x.std():
            return 0.0
        x = (x - x.mean()) / x.std()
    d = np.diff(x)
    return math.sqrt(_sum(d * d))


@calculator
def time_reversal_asymmetry(x, lag):
    if len(x) <= 2 * lag:
        return 0.0
    a, b, c = x[: -2 * lag], x[lag:-lag], x[2 * lag :]
    return _mean(c * c * b - b * a * a)


@calculator
def c3(x, lag):
    return _mean(x[2 * lag :] * x[lag:-lag] * x[: -2 * lag]) if len(x) > 2 * lag else 0.0


# Of places


@calculator
def first_location_of_maximum(x):
    return x.argmax() / len(x)


@calculator
def first_location_of_minimum(x):
    return x.argmin() / len(x)


@calculator
def last_location_of_maximum(x):
    return 1 - x[::-1].argmax() / len(x)


def _longest(mask) -> int:
    ends = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return int((ends[1::2] - ends[::2]).max(initial=0))


@calculator
def longest_strike_above_mean(x):
    return _longest(x > x.mean())


@calculator
def longest_strike_below_mean(x):
    return _longest(x < x.mean())


@calculator
def number_crossing(x, m):
    return (np.diff(x > m) != 0).sum()


@calculator
def number_peaks(x, n):
    """Values greater than the n before and the n after."""
    if len(x) <= 2 * n:
        return 0
    mid, found = x[n:-n], np.ones(len(x) - 2 * n, bool)
    for k in range(1, n + 1):
        found &= (mid > x[n - k : len(x) - n - k]) & (mid > x[n + k : len(x) - n + k])
    return found.sum()


@calculator
def index_mass_quantile(x, q):
    """The share of the series by which the share q of the absolute values' sum is reached."""
    mass = np.cumsum(np.abs(x))
    return (np.argmax(mass >= q * mass[-1]) + 1) / len(x) if mass[-1] else math.nan


@calculator
def energy_ratio_by_chunks(x, chunks, focus):
    return _ratio(float((np.array_split(x, chunks)[focus] ** 2).sum()), float(x @ x))


@calculator
def linear_trend(x, attr):
    """Of a line over the steps: slope, intercept, r or the slope's standard error."""
    n = len(x)
    if n < 3:
        return math.nan
    t = np.arange(n) - (n - 1) / 2
    slope, spread = (t @ x) / (t @ t), ((x - x.mean()) ** 2).sum()
    r = _ratio(t @ x, math.sqrt((t @ t) * spread))
    if attr == "stderr":
        return math.sqrt(max(0.0, 1 - r * r) * spread / (t @ t) / (n - 2)) if spread else 0.0
    return {"slope": slope, "intercept": x.mean() - slope * (n - 1) / 2, "r": r}[attr]


# Of lags


def _autocovariances(x, most: int):
    d = x - x.mean()
    return np.array([d[: len(d) - k] @ d[k:] for k in range(most + 1)]) / len(d)


@calculator
def autocorrelation(x, lag):
    """The mean product of deviations a lag apart over the variance."""
    if len(x) <= lag or not x.var():
        return math.nan
    d = x - _mean(x)
    return _mean(d[: len(d) - lag] * d[lag:]) / x.var()


@calculator
def partial_autocorrelation(x, lag):
    """The last coefficient of the autoregression of that order, by the Durbin-Levinson recursion."""
    if len(x) <= lag or not x.var():
        return math.nan
    if not lag:
        return 1.0
    c = _autocovariances(x, lag)
    phi, error, last = np.zeros(0), c[0], 0.0
    for k in range(1, lag + 1):
        if error <= 0:
            return math.nan
        last = (c[k] - phi @ c[k - 1 : 0 : -1]) / error
        phi = np.append(phi - last * phi[::-1], last)
        error *= 1 - last * last
    return last


@calculator
def ar_coefficient(x, order, k):
    """The k-th coefficient, from 1, of an autoregression of that order by the Yule-Walker equations; 0: its constant."""
    if len(x) <= order or not x.var():
        return math.nan
    c = _autocovariances(x, order)
    places = np.abs(np.arange(order)[:, None] - np.arange(order))
    try:
        phi = np.linalg.solve(c[places], c[1:])
    except np.linalg.LinAlgError:
        return math.nan
    return phi[k - 1] if k else x.mean() * (1 - phi.sum())


# Of frequencies


@calculator
def fft_coefficient(x, k, attr):
    spectrum = np.fft.rfft(x)
    if k >= len(spectrum):
        return math.nan
    return {"real": spectrum[k].real, "imag": spectrum[k].imag, "abs": abs(spectrum[k]), "angle": math.degrees(np.angle(spectrum[k]))}[attr]


@calculator
def fft_moment(x, attr):
    """Of the distribution of absolute coefficients over frequencies: centroid, variance, skew or kurtosis."""
    size = np.abs(np.fft.rfft(x))
    if not size.sum():
        return math.nan
    p, f = size / size.sum(), np.arange(len(size))
    at = p @ f
    var = p @ (f - at) ** 2
    if attr in ("skew", "kurtosis") and var < 0.25:
        return math.nan
    return {"centroid": lambda: at, "variance": lambda: var, "skew": lambda: p @ (f - at) ** 3 / var**1.5, "kurtosis": lambda: p @ (f - at) ** 4 / var**2}[attr]()


def _welch(x, segment: int = 256):
    """The spectral density of segments, half overlapping, under a Hann window; one-sided, frequency 1 for a step."""
    m = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m) if m > 1 else np.ones(1)
    parts = np.array([x[i : i + m] for i in range(0, len(x) - m + 1, max(1, m - m // 2))])
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window)) ** 2 / (window @ window)
    power[:, 1 : (m + 1) // 2] *= 2
    return power.mean(0)


@calculator
def spectral_density(x, k):
    power = _welch(x)
    return power[k] if k < len(power) else math.nan


@calculator
def fourier_entropy(x, bins):
    """The binned entropy of the spectral density, as a share of its greatest value."""
    power = _welch(x)
    return binned_entropy(power / power.max(), bins) if power.max() > 0 else math.nan


# Of patterns


@calculator
def permutation_entropy(x, dimension, lag):
    """Of the orders of so many values a lag apart; ties in the order of their places."""
    n = len(x) - (dimension - 1) * lag
    if n < 1:
        return math.nan
    orders = np.stack([x[i * lag : i * lag + n] for i in range(dimension)], 1).argsort(1, kind="stable")
    _, counts = np.unique(orders @ dimension ** np.arange(dimension), return_counts=True)
    p = counts / n
    return -(p * np.log(p)).sum()


@calculator
def lempel_ziv_complexity(x, bins):
    """The number of different phrases, each the shortest not seen yet, of the binned values, over the length."""
    letters = np.searchsorted(np.linspace(x.min(), x.max(), bins + 1)[1:], x, side="left")
    seen, phrase = set(), ()
    for letter in letters.tolist():
        phrase += (letter,)
        if phrase not in seen:
            seen.add(phrase)
            phrase = ()
    return len(seen) / len(x)


def _close(x, m: int, tolerance: float, n: int):
    """For each of the first n templates of m values, how many are within the tolerance of it, itself included; in blocks of rows."""
    parts = np.stack([x[i : i + n] for i in range(m)], 1)
    step = max(1, (1 << 20) // max(1, n * m))
    return np.concatenate([(np.abs(parts[i : i + step, None] - parts[None]).max(2) <= tolerance).sum(1) for i in range(0, n, step)])


@calculator
def sample_entropy(x, m, r):
    """-log of the share of pairs close over m values that are close over m + 1, at r deviations."""
    n = len(x) - m
    if n < 2 or not x.std():
        return math.nan
    near, nearer = (_close(x, k, r * x.std(), n).sum() - n for k in (m, m + 1))
    return -math.log(nearer / near) if near and nearer else math.nan


@calculator
def approximate_entropy(x, m, r):
    if len(x) <= m + 1:
        return 0.0
    phi = [np.log(_close(x, k, r * x.std(), n) / n).mean() for k in (m, m + 1) for n in [len(x) - k + 1]]
    return abs(phi[0] - phi[1])


MINIMAL = dict.fromkeys(("sum_values", "median", "mean", "length", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum"))
EFFICIENT = MINIMAL | {
    **dict.fromkeys(("abs_energy", "variation_coefficient", "skewness", "kurtosis", "count_above_mean", "count_below_mean", "share_of_distinct_values", "absolute_sum_of_changes", "mean_abs_change", "mean_change", "mean_second_derivative")),
    **dict.fromkeys(("first_location_of_maximum", "first_location_of_minimum", "last_location_of_maximum", "longest_strike_above_mean", "longest_strike_below_mean")),
    "quantile": [{"q": q} for q in (0.1, 0.25, 0.75, 0.9)],
    "ratio_beyond_sigma": [{"r": r} for r in (1, 2, 3)],
    "binned_entropy": [{"bins": 10}],
    "complexity": [{"normalize": n} for n in (True, False)],
    "time_reversal_asymmetry": [{"lag": k} for k in (1, 2, 3)],
    "c3": [{"lag": k} for k in (1, 2, 3)],
    "number_crossing": [{"m": m} for m in (-1, 0, 1)],
    "number_peaks": [{"n": n} for n in (1, 3, 5)],
    "index_mass_quantile": [{"q": q} for q in (0.25, 0.5, 0.75)],
    "energy_ratio_by_chunks": [{"chunks": 10, "focus": i} for i in range(10)],
    "linear_trend": [{"attr": a} for a in ("slope", "intercept", "r", "stderr")],
    "autocorrelation": [{"lag": k} for k in range(1, 10)],
    "partial_autocorrelation": [{"lag": k} for k in range(1, 10)],
    "ar_coefficient": [{"order": 10, "k": k} for k in range(11)],
    "fft_coefficient": [{"k": k, "attr": a} for k in range(10) for a in ("real", "imag", "abs", "angle")],
    "fft_moment": [{"attr": a} for a in ("centroid", "variance", "skew", "kurtosis")],
    "spectral_density": [{"k": k} for k in (2, 5, 8)],
    "fourier_entropy": [{"bins": b} for b in (2, 5, 10)],
    "permutation_entropy": [{"dimension": d, "lag": 1} for d in (3, 4, 5)],
    "lempel_ziv_complexity": [{"bins": b} for b in (2, 5, 10)],
}
COMPREHENSIVE = EFFICIENT | {"sample_entropy": [{"m": 2, "r": 0.2}], "approximate_entropy": [{"m": 2, "r": r} for r in (0.1, 0.5, 0.9)]}
SETTINGS = {"minimal": MINIMAL, "efficient": EFFICIENT, "comprehensive": COMPREHENSIVE}


def features(settings: str | dict) -> list[tuple[str, str, dict]]:
    """(column, calculator, parameters) of each feature; an unknown calculator or parameter is an error."""
    table = SETTINGS[settings] if isinstance(settings, str) else settings
    out = []
    for name, parameters in table.items():
        if name not in CALCULATORS:
            raise ValueError(f"unknown calculator {name!r}")
        for p in parameters or [{}]:
            inspect.signature(CALCULATORS[name]).bind(None, **p)
            out.append(("__".join([name, *(f"{k}_{v}" for k, v in p.items())]).replace(".", "_"), name, p))
    return out


def extract(df: DataFrame, columns: Names, settings: str | dict = "efficient", *, by: dict[str, str | dict] | None = None) -> DataFrame:
    """df without the array columns, and a double for each variable and feature. ``by``: other settings for some variables.

    A row is a series; an empty one, or a null array, has nulls only. Infinite and undefined results are null.
    """
    columns = listed(columns)
    asked = [(f"{c}__{name}", c, calc, p) for c in columns for name, calc, p in features((by or {}).get(c, settings))]
    keep = [c for c in df.columns if c not in columns]
    schema = StructType([*[df.schema[c] for c in keep], *[StructField(name, DoubleType()) for name, *_ in asked]])

    def value(x, calc: str, p: dict):
        out = float(CALCULATORS[calc](x, **p)) if len(x) else math.nan
        return out if math.isfinite(out) else None

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                series = {}
                for c in columns:
                    steps = (a.values for a in b.column(b.schema.get_field_index(c)))
                    series[c] = [np.zeros(0) if s is None else s.drop_null().cast(pa.float64()).to_numpy(zero_copy_only=False) for s in steps]
                    series[c] = [x[~np.isnan(x)] for x in series[c]]
                with np.errstate(all="ignore"):
                    found = [pa.array([value(x, calc, p) for x in series[c]], pa.float64()) for _, c, calc, p in asked]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], *found], names=schema.names)

    return df.select(*keep, *columns).mapInArrow(run, schema)
