"""Random-convolution features in NumPy over Arrow batches, and linear heads on them.

Kernels and biases are small and go with the function; each batch of samples is one matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Samples that are worked out at once: a batch of Arrow's has 10,000, and intermediate matrices are many times a sample's size.
SLICE = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as (samples, steps); nulls as 0."""
    steps = column.flatten().cast(pa.float64()).fill_null(0.0)
    return steps.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _map(df: DataFrame, columns: list[str], function, out: str, keep: list[str]) -> DataFrame:
    """Adds an array column: function of (samples, variables, steps)."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` array<double>"

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                b = whole.slice(begin, SLICE)
                found = np.ascontiguousarray(function(np.stack([_matrix(b.column(c)) for c in columns], 1)))
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.float64()))], [*keep, out])

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, schema)


def _dilated(x: np.ndarray, kernel_index: np.ndarray, dilation: int, padding: bool) -> np.ndarray:
    """Sums for kernels of nine weights, -1 but for 2 at three places: (samples, kernels, steps)."""
    n, length = x.shape
    reach = 4 * dilation
    wide = np.pad(x, ((0, 0), (reach, reach)))
    taps = np.stack([wide[:, j * dilation : j * dilation + length] for j in range(9)], 1)
    base = -taps.sum(1, keepdims=True)
    out = base + 3 * taps[:, kernel_index].sum(2)
    return out if padding else out[:, :, reach : length - reach]


@dataclass
class MiniRocket:
    """The 84 kernels of three 2s among nine weights, dilations spaced by powers, biases at quantiles, share of positives.

    fit takes biases from a sample of ``sample`` rows at most; transform adds the features as one array.
    """

    columns: list[str]
    features: int = 9996
    dilations: int = 32
    sample: int = 1000
    seed: int = 0
    output: str = "features"

    def fit(self, df: DataFrame, key: str) -> MiniRocketModel:
        rows = df.select(*self.columns).orderBy(F.xxhash64(key, F.lit(self.seed)), key).limit(self.sample).collect()
        x = np.stack([np.array([[0.0 if v is None else v for v in r[c]] for r in rows], float) for c in self.columns], 1)
        return self.fit_array(x)

    def fit_array(self, x: np.ndarray) -> MiniRocketModel:
        n, c, length = x.shape
        kernels = np.array(list(combinations(range(9), 3)))
        per = max(1, self.features // len(kernels))
        most = min(per, self.dilations)
        top = np.log2(max(1.0, (length - 1) / 8))
        sizes, counts = np.unique((2 ** np.linspace(0, top, most)).astype(int), return_counts=True)
        counts = (counts * (per / most)).astype(int)
        for i in range(per - counts.sum()):
            counts[i % len(counts)] += 1
        rng = np.random.default_rng(self.seed)
        plan, spot = [], 0
        golden = (np.sqrt(5) + 1) / 2
        for d, m in zip(sizes.tolist(), counts.tolist(), strict=True):
            share = ((np.arange(spot + 1, spot + m * len(kernels) + 1) * golden) % 1).reshape(m, len(kernels))
            spot += m * len(kernels)
            variables = [rng.choice(c, int(2 ** rng.uniform(0, np.log2(min(c, 9) + 1))), replace=False) for _ in kernels]
            picks = rng.integers(n, size=len(kernels))
            biases = np.empty((m, len(kernels)))
            for k in range(len(kernels)):
                one = _dilated(x[picks[k] : picks[k] + 1, variables[k]].sum(1), kernels[k : k + 1], d, True)[0, 0]
                biases[:, k] = np.quantile(one, share[:, k])
            plan.append((d, biases, variables))
        return MiniRocketModel(self.columns, kernels, plan, self.output)


@dataclass
class MiniRocketModel:
    columns: list[str]
    kernels: np.ndarray
    plan: list
    output: str

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i, (d, biases, variables) in enumerate(self.plan):
            for k in range(len(self.kernels)):
                padded = (i + k) % 2 == 0 or x.shape[2] <= 8 * d
                conv = _dilated(x[:, variables[k]].sum(1), self.kernels[k : k + 1], d, padded)[:, 0]
                out.append((conv[:, None, :] > biases[:, k][None, :, None]).mean(2))
        return np.concatenate(out, 1)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return _map(df, self.columns, self.apply, self.output, keep)


@dataclass
class Rocket:
    """Random kernels of 7, 9 or 11 weights with random bias, dilation and padding: the maximum and the share of positives."""

    columns: list[str]
    kernels: int = 1000
    sizes: tuple[int, ...] = (7, 9, 11)
    seed: int = 0
    output: str = "features"

    def model(self, length: int) -> RocketModel:
        rng = np.random.default_rng(self.seed)
        made = []
        for _ in range(self.kernels):
            size = int(rng.choice(self.sizes))
            w = rng.normal(size=(len(self.columns), size))
            w -= w.mean(1, keepdims=True)
            d = int(2 ** rng.uniform(0, np.log2(max(1.0, (length - 1) / (size - 1)))))
            made.append((w, rng.uniform(-1, 1), d, (size - 1) * d // 2 if rng.random() < 0.5 else 0))
        return RocketModel(self.columns, made, self.output)


@dataclass
class RocketModel:
    columns: list[str]
    kernels: list
    output: str

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w, bias, d, padding in self.kernels:
            wide = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
            n = wide.shape[2] - (w.shape[1] - 1) * d
            conv = bias + sum(np.einsum("ncl,c->nl", wide[:, :, j * d : j * d + n], w[:, j]) for j in range(w.shape[1]))
            out += [conv.max(1), (conv > 0).mean(1)]
        return np.stack(out, 1)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return _map(df, self.columns, self.apply, self.output, keep)


def poolings(conv: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Of each series against each bias: share of positives, their mean, their mean place, and their longest run."""
    c = conv[:, None, :] - bias[None, :, None]
    on = c > 0
    n = on.sum(2)
    safe = np.maximum(n, 1)
    places = np.arange(c.shape[2])
    run, best = np.zeros(on.shape[:2], int), np.zeros(on.shape[:2], int)
    for t in range(c.shape[2]):
        run = np.where(on[:, :, t], run + 1, 0)
        best = np.maximum(best, run)
    return np.stack([on.mean(2), np.where(on, c, 0).sum(2) / safe, np.where(n > 0, (on * places).sum(2) / safe, -1) / c.shape[2], best / c.shape[2]], 2)


@dataclass
class MultiRocketModel:
    """Four poolings of the kernels of a MiniRocketModel, on the series and on its differences."""

    base: MiniRocketModel
    diff: MiniRocketModel | None = None
    output: str = "features"

    def _one(self, m: MiniRocketModel, x: np.ndarray) -> np.ndarray:
        out = []
        for d, biases, variables in m.plan:
            for k in range(len(m.kernels)):
                conv = _dilated(x[:, variables[k]].sum(1), m.kernels[k : k + 1], d, True)[:, 0]
                out.append(poolings(conv, biases[:, k]).reshape(len(x), -1))
        return np.concatenate(out, 1)

    def apply(self, x: np.ndarray) -> np.ndarray:
        parts = [self._one(self.base, x)] + ([self._one(self.diff, np.diff(x, axis=2))] if self.diff else [])
        return np.concatenate(parts, 1)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return _map(df, self.base.columns, self.apply, self.output, keep)


@dataclass
class Hydra:
    """Groups of competing kernels: each step adds the winner's value to its sum and one to the loser's count."""

    columns: list[str]
    k: int = 8
    groups: int = 64
    seed: int = 0
    output: str = "features"

    def apply(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        length, out = x.shape[2], []
        top = max(1, int(np.log2(max(2.0, (length - 1) / 8))))
        for e in range(top):
            d = 1 << e
            for difference in (False, True):
                w = rng.normal(size=(self.groups // 2 or 1, self.k, 9))
                w -= w.mean(2, keepdims=True)
                w /= np.abs(w).sum(2, keepdims=True)
                v = rng.integers(x.shape[1], size=len(w))
                z = np.diff(x, axis=2) if difference else x
                wide = np.pad(z, ((0, 0), (0, 0), (4 * d, 4 * d)))
                taps = np.stack([wide[:, :, j * d : j * d + z.shape[2]] for j in range(9)], 3)
                for g in range(len(w)):
                    conv = taps[:, v[g]] @ w[g].T  # samples, steps, kernels
                    win, lose = conv.argmax(2), conv.argmin(2)
                    for j in range(self.k):
                        out += [np.maximum(0, np.where(win == j, conv.max(2), 0).sum(1)), (lose == j).sum(1).astype(float)]
        return np.stack(out, 1)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return _map(df, self.columns, self.apply, self.output, keep)


def ridge_fit(df: DataFrame, features: str, label: str, alpha: float = 1.0, *, regression: bool = False):
    """A linear head on standardised features: ridge regression, or logistic regression with that penalty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    ready = df.withColumn("_v", array_to_vector(features))
    head = LinearRegression(featuresCol="_s", labelCol=label, regParam=alpha, elasticNetParam=0.0) if regression else LogisticRegression(featuresCol="_s", labelCol=label, regParam=alpha)
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_s", withMean=True), head]).fit(ready)
    return lambda new: model.transform(new.withColumn("_v", array_to_vector(features))).drop("_v", "_s", "rawPrediction", "probability")


def vote(predictions: list[DataFrame], key: str, *, regression: bool = False) -> DataFrame:
    """(key, prediction): the models' mean, or their most frequent answer (of equals the least)."""
    out = None
    for p in predictions:
        one = p.select(key, "prediction")
        out = one if out is None else out.unionByName(one)
    if regression:
        return out.groupBy(key).agg(F.avg("prediction").alias("prediction"))
    counts = out.groupBy(key, "prediction").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("prediction"))
