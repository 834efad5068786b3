"""What no expression states well: splines and wavelets, in NumPy on Arrow batches of array columns.

Each function returns a function of (samples as a matrix, generator), which ``apply`` runs over a column. A sample's generator
is seeded by its key, so results don't depend on batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Daubechies' wavelet with four vanishing moments: the low-pass filter. Fixed values.
DB4 = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523)


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y) without curvature at its ends."""
    n, h = len(x), np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def curve(n: int, magnitude: float, order: int, rng: np.random.Generator) -> np.ndarray:
    """A smooth curve around 1 through normal values at evenly spaced knots."""
    knots = np.linspace(-n, 2 * n - 1, 3 * (order - 1) + 1)
    return natural_spline(knots, rng.normal(1, magnitude, len(knots)), np.arange(n, dtype=float))


def cumulative(c: np.ndarray) -> np.ndarray:
    """A positive curve summed up to a warped time axis from 0 to n - 1."""
    t = np.cumsum(np.maximum(c, 1e-3))
    return (t - t[0]) / (t[-1] - t[0]) * (len(c) - 1) if len(c) > 1 else t * 0


def _at(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    return natural_spline(np.arange(len(v), dtype=float), v, t) if len(v) > 2 else np.interp(t, np.arange(len(v)), v)


def magnitude_warp(magnitude: float = 0.02, order: int = 4) -> Callable:
    return lambda v, rng: v * curve(len(v), magnitude, order, rng)


def time_warp(magnitude: float = 0.1, order: int = 6) -> Callable:
    return lambda v, rng: _at(v, cumulative(curve(len(v), magnitude, order, rng)))


def time_noise(magnitude: float = 0.1) -> Callable:
    return lambda v, rng: _at(v, cumulative(np.clip(1 + magnitude * rng.normal(size=len(v)), 0.01, None)))


def window_warp(magnitude: float = 0.1) -> Callable:
    """One stretch is sped up or slowed down; the whole is brought back to its length."""

    def run(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n = len(v)
        size = max(2, round(n * min(0.5, magnitude)))
        if n < 4:
            return v
        start = int(rng.integers(0, n - size + 1))
        speed = np.ones(n)
        speed[start : start + size] = 2.0 if rng.random() < 0.5 else 0.5
        return np.interp(cumulative(speed), np.arange(n), v)

    return run


def dwt(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the periodic transform: approximation and detail of an even number of values."""
    low = np.array(DB4)
    high = low[::-1] * (-1) ** np.arange(8)
    i = (2 * np.arange(len(v) // 2)[:, None] + np.arange(8)[None]) % len(v)
    return v[i] @ low[::-1], v[i] @ high[::-1]


def idwt(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    low = np.array(DB4)
    high = low[::-1] * (-1) ** np.arange(8)
    n = 2 * len(a)
    out = np.zeros(n)
    i = (2 * np.arange(len(a))[:, None] + np.arange(8)[None]) % n
    np.add.at(out, i, a[:, None] * low[::-1] + d[:, None] * high[::-1])
    return out


def _levels(v: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    n = len(v)
    full = -(-n // (1 << level)) << level
    a, details = np.pad(v, (0, full - n), mode="edge"), []
    for _ in range(level):
        a, d = dwt(a)
        details.append(d)
    return a, details, n


def frequency_denoise(level: int = 2, threshold: float | None = None, hard: bool = True) -> Callable:
    """Small detail coefficients go. Threshold: by default the universal one for the noise in the finest details."""

    def run(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        a, details, n = _levels(v, level)
        t = threshold if threshold is not None else np.mean(np.abs(details[0] - details[0].mean())) / 0.6745 * np.sqrt(2 * np.log(max(2, n)))
        for d in reversed(details):
            d = np.where(np.abs(d) >= t, d, 0) if hard else np.sign(d) * np.maximum(np.abs(d) - t, 0)
            a = idwt(a, d)
        return a[:n]

    return run


def frequency_noise(magnitude: float = 0.1, level: int = 2) -> Callable:
    """Each level's details by a random factor around 1."""

    def run(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        a, details, n = _levels(v, level)
        for d in reversed(details):
            a = idwt(a, d * (1 + rng.normal(0, magnitude)))
        return a[:n]

    return run


def apply(df: DataFrame, x: str, key: str, function: Callable, *, seed: int = 0) -> DataFrame:
    """df with the array column replaced by the function's results. key: a long; nulls in arrays count as 0; null arrays stay."""
    names, place = df.columns, df.columns.index(x)

    def run(batches):
        for b in batches:
            out = []
            for k, v in zip(b.column(names.index(key)).to_pylist(), b.column(place).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, (k or 0) % (1 << 63)])
                out.append(None if v is None else function(np.array([0.0 if e is None else e for e in v], float), rng).tolist() if v else v)
            arrays = [*b.columns]
            arrays[place] = pa.array(out, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, df.schema)
