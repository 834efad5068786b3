"""Features of series against plain loops and known values."""

import cmath
import functools
import math

import numpy as np
import pytest

from chronoloom.operators import extract
from chronoloom.operators.extract import CALCULATORS as C

rng = np.random.default_rng(5)
SERIES = [rng.normal(size=n).round(3) for n in (12, 40, 97)] + [np.sin(np.arange(60) / 3), np.arange(30.0) ** 2, np.repeat([1.0, 2.0, 5.0], 10)]


def lags(x, k):
    d = [v - sum(x) / len(x) for v in x]
    return sum(d[i] * d[i + k] for i in range(len(d) - k)) / len(d)


def close(x, m, r, n):
    return [sum(max(abs(x[i + k] - x[j + k]) for k in range(m)) <= r for j in range(n)) for i in range(n)]


def plain(x):
    """The same by loops over lists."""
    x = [float(v) for v in x]
    n, mu = len(x), sum(x) / len(x)
    var = sum((v - mu) ** 2 for v in x) / n
    sd, r = math.sqrt(var), 0.2 * math.sqrt(var)
    d = [b - a for a, b in zip(x, x[1:], strict=False)]
    spectrum = [sum(v * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x)) for k in range(n // 2 + 1)]
    size = [abs(s) for s in spectrum]
    at = sum(k * s for k, s in enumerate(size)) / sum(size)
    run, best = 0, 0
    for v in x:
        run = run + 1 if v > mu else 0
        best = max(best, run)
    orders = [tuple(sorted(range(3), key=lambda k: (x[i + k], k))) for i in range(n - 2)]  # noqa: B023
    p = [orders.count(o) / len(orders) for o in set(orders)]
    near, nearer = (sum(close(x, k, r, n - 2)) - (n - 2) for k in (2, 3))
    phi = [sum(math.log(c / (n - k + 1)) for c in close(x, k, 0.5 * sd, n - k + 1)) / (n - k + 1) for k in (2, 3)]
    t = [i - (n - 1) / 2 for i in range(n)]
    seen, phrase = set(), ()
    for v in x:
        edges = [min(x) + (max(x) - min(x)) * (i + 1) / 5 for i in range(5)]
        phrase += (sum(e < v - 1e-12 for e in edges),)
        if phrase not in seen:
            seen.add(phrase)
            phrase = ()
    mass, total = 0, sum(map(abs, x))
    for i, v in enumerate(x):
        mass += abs(v)
        if mass >= total / 2 - 1e-12:
            half = (i + 1) / n
            break
    counts = [0] * 10
    for v in x:
        counts[min(9, int((v - min(x)) / (max(x) - min(x)) * 10))] += 1
    return {
        ("abs_energy",): sum(v * v for v in x),
        ("root_mean_square",): math.sqrt(sum(v * v for v in x) / n),
        ("mean_abs_change",): sum(map(abs, d)) / (n - 1),
        ("mean_change",): sum(d) / (n - 1),
        ("mean_second_derivative",): sum((x[i + 2] - 2 * x[i + 1] + x[i]) / 2 for i in range(n - 2)) / (n - 2),
        ("complexity", False): math.sqrt(sum(v * v for v in d)),
        ("complexity", True): math.sqrt(sum(v * v for v in d)) / sd,
        ("skewness",): n / ((n - 1) * (n - 2)) * sum(((v - mu) / (sd * math.sqrt(n / (n - 1)))) ** 3 for v in x),
        ("time_reversal_asymmetry", 2): sum(x[i + 4] ** 2 * x[i + 2] - x[i + 2] * x[i] ** 2 for i in range(n - 4)) / (n - 4),
        ("c3", 1): sum(x[i + 2] * x[i + 1] * x[i] for i in range(n - 2)) / (n - 2),
        ("count_above_mean",): sum(v > mu for v in x),
        ("longest_strike_above_mean",): best,
        ("number_peaks", 2): sum(all(x[i] > x[i + k] for k in (-2, -1, 1, 2)) for i in range(2, n - 2)),
        ("number_crossing", 0): sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False)),
        ("first_location_of_maximum",): x.index(max(x)) / n,
        ("last_location_of_maximum",): (n - x[::-1].index(max(x))) / n,
        ("index_mass_quantile", 0.5): half,
        ("binned_entropy", 10): -sum(c / n * math.log(c / n) for c in counts if c),
        ("linear_trend", "slope"): sum(a * b for a, b in zip(t, x, strict=True)) / sum(a * a for a in t),
        ("autocorrelation", 3): lags(x, 3) * n / (n - 3) / var,
        ("partial_autocorrelation", 1): lags(x, 1) / lags(x, 0),
        ("partial_autocorrelation", 2): (lags(x, 2) / lags(x, 0) - (lags(x, 1) / lags(x, 0)) ** 2) / (1 - (lags(x, 1) / lags(x, 0)) ** 2),
        ("ar_coefficient", 1, 1): lags(x, 1) / lags(x, 0),
        ("fft_coefficient", 4, "real"): spectrum[4].real,
        ("fft_coefficient", 4, "abs"): abs(spectrum[4]),
        ("fft_moment", "centroid"): at,
        ("fft_moment", "variance"): sum(s * (k - at) ** 2 for k, s in enumerate(size)) / sum(size),
        ("permutation_entropy", 3, 1): -sum(q * math.log(q) for q in p),
        ("lempel_ziv_complexity", 5): len(seen) / n,
        ("sample_entropy", 2, 0.2): -math.log(nearer / near) if near and nearer else math.nan,
        ("approximate_entropy", 2, 0.5): abs(phi[0] - phi[1]),
    }


@pytest.mark.parametrize("k", range(len(SERIES)))
def test_against_loops(k):
    for (name, *p), want in plain(SERIES[k]).items():
        got = float(C[name](SERIES[k], *p))
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True), (name, p)


def test_recursion_agrees_with_equations():
    """The last Yule-Walker coefficient of each order is the partial autocorrelation."""
    for x in SERIES[:4]:
        for k in range(1, 8):
            assert C["partial_autocorrelation"](x, k) == pytest.approx(C["ar_coefficient"](x, k, k), rel=1e-6, abs=1e-9)


def test_known_spectra():
    x = np.sin(2 * np.pi * 8 * np.arange(256) / 256)
    power = [C["spectral_density"](x, k) for k in range(129)]
    assert int(np.argmax(power)) == 8 and C["spectral_density"](x, 500) != C["spectral_density"](x, 500)
    noise = rng.normal(size=20_000)
    assert sum(C["spectral_density"](noise, k) for k in range(129)) / 256 == pytest.approx(noise.var(), rel=0.1)
    assert C["fourier_entropy"](x, 10) < C["fourier_entropy"](noise, 10)
    assert C["approximate_entropy"](np.tile([1.0, 2.0], 60), 2, 0.2) < 0.02 < C["approximate_entropy"](noise[:200], 2, 0.2)


def test_table_of_settings(spark):
    rows = [(i, [None if j % 7 == 3 else float(v) for j, v in enumerate(x)], [1.0, 2.0]) for i, x in enumerate(SERIES)] + [(98, [], None), (99, None, [None, 3.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>").repartition(3)
    out = extract.extract(df, ["x", "y"], "comprehensive", by={"y": "minimal"})
    names = extract.features("comprehensive")
    assert len({c for c, *_ in names}) == len(names) > 130 and len({n for _, n, _ in names}) >= 45
    assert out.columns == ["id", *[f"x__{c}" for c, *_ in names], *[f"y__{c}" for c, *_ in extract.features("minimal")]]
    got = {r["id"]: r.asDict() for r in out.collect()}
    x = np.array([v for v in rows[1][1] if v is not None])
    for column, name, p in names:
        want = float(C[name](x, **p))
        assert got[1][f"x__{column}"] == (pytest.approx(want) if math.isfinite(want) else None), column
    assert all(v is None for c, v in got[98].items() if c != "id") and got[99]["y__mean"] == 3.0 and got[99]["y__length"] == 1.0


def test_short_and_flat_series():
    """Every feature has a number or none at all; nothing fails."""
    for x in ([1.0], [2.0, 2.0], [0.0] * 20, [1.0, 2.0, 3.0], [1e300, -1e300, 0.0]):
        with np.errstate(all="ignore"):
            for column, name, p in extract.features("comprehensive"):
                assert isinstance(float(C[name](np.array(x), **p)), float), (column, x)


def test_sums_in_the_order_of_steps(spark):
    """As SQL adds rows one after the other, so a tie in the last digit kept goes the same way."""
    from chronoloom.catalogue import rounded

    for x in (np.round(np.random.default_rng(k).exponential(50, 64 + k), 2) for k in range(200)):
        total = lambda t: functools.reduce(float.__add__, t, 0.0)
        v = x.tolist()
        assert C["mean"](x) == total(v) / len(v)
        assert C["mean_change"](x) == total([b - a for a, b in zip(v, v[1:], strict=False)]) / (len(v) - 1)
        assert C["mean_second_derivative"](x) == total([c - 2 * b + a for a, b, c in zip(v, v[1:], v[2:], strict=False)]) / (2 * (len(v) - 2))
    # 47.6759375 less one bit: its millionfold is a half again
    assert rounded(spark.createDataFrame([(47.675937499999996,), (-47.675937499999996,)], "v double")).toPandas()["v"].tolist() == [47.675938, -47.675938]


def test_unknown_settings(spark):
    for bad in ({"nonsense": None}, {"quantile": [{"r": 1}]}):
        with pytest.raises((ValueError, TypeError)):
            extract.features(bad)
