"""Pipelines of fitted steps. A step is an object with fit(df) that returns a model with transform(df) and maybe inverse(df),
a model itself, or a function of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Pipeline:
    steps: list

    def fit(self, df: DataFrame) -> PipelineModel:
        """Each step is fitted on what the ones before make of df."""
        done = []
        for s in self.steps:
            model = s.fit(df) if hasattr(s, "fit") else s
            done.append(model)
            df = model.transform(df) if hasattr(model, "transform") else model(df)
        return PipelineModel(done)


@dataclass
class PipelineModel:
    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df) if hasattr(s, "transform") else s(df)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        """In reverse order; steps without an inverse are passed over."""
        for s in reversed(self.steps):
            df = s.inverse(df) if hasattr(s, "inverse") else df
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as one row of JSON, fitted tables as Parquet. Functions can't be saved."""
        import json

        kinds = []
        for i, s in enumerate(self.steps):
            if not is_dataclass(s):
                raise TypeError(f"step {i} can't be saved")
            plain, tables = {}, {}
            for f in fields(s):
                v = getattr(s, f.name)
                if isinstance(v, DataFrame):
                    tables[f.name] = None
                    v.write.mode("overwrite").parquet(f"{path}/step{i}/{f.name}")
                elif isinstance(v, dict) and v and all(isinstance(x, DataFrame) for x in v.values()):
                    tables[f.name] = list(v)
                    for k, x in v.items():
                        x.write.mode("overwrite").parquet(f"{path}/step{i}/{f.name}/{k}")
                else:
                    plain[f.name] = v
            kinds.append({"class": [type(s).__module__, type(s).__name__], "plain": plain, "tables": tables})
        spark.createDataFrame([(json.dumps(kinds),)], "steps string").coalesce(1).write.mode("overwrite").parquet(f"{path}/pipeline")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PipelineModel:
        import importlib
        import json

        steps = []
        for i, s in enumerate(json.loads(spark.read.parquet(f"{path}/pipeline").first()[0])):
            module, name = s["class"]
            if not module.startswith("chronoloom."):
                raise ValueError(f"not a step of this package: {module}")
            got = {k: (tuple(v) if k == "clip" and v else v) for k, v in s["plain"].items()}
            for k, names in s["tables"].items():
                at = f"{path}/step{i}/{k}"
                got[k] = spark.read.parquet(at) if names is None else {n: spark.read.parquet(f"{at}/{n}") for n in names}
            steps.append(getattr(importlib.import_module(module), name)(**got))
        return PipelineModel(steps)


def apply_by_group(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """A function of pandas frames for each group; the way out where no expression does. A group must fit one task."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def score(df: DataFrame, function: Callable, inputs: list[str], keep: list[str], output: str = "prediction double") -> DataFrame:
    """A model's function of a pandas frame of inputs to a column, over batches."""
    name = output.split(" ")[0]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", {output}"

    def run(frames):
        for f in frames:
            out = f[keep].copy()
            out[name] = function(f[inputs])
            yield out

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)


def permutation_importance(df: DataFrame, key: str, columns: list[str], scored: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame], DataFrame], *, seed: int = 0, blocks: int = 1 << 12) -> DataFrame:
    """(feature, change): how the metric's one number changes if a feature is dealt out anew among the rows."""
    from ..functions.augment import partners

    name = metric(scored(df)).columns[0]
    base = metric(scored(df)).select(F.col(name).alias("_base"))
    out = None
    for i, c in enumerate(columns):
        mixed = partners(df, key, seed=seed + i, blocks=blocks).withColumn(c, F.col(f"other_{c}")).select(*df.columns)
        one = metric(scored(mixed)).select(F.lit(c).alias("feature"), F.col(name).alias("_now"))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(base)).select("feature", (F.col("_now") - F.col("_base")).alias("change"))


def step_importance(df: DataFrame, key: str, columns: list[str], length: int, scored: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame], DataFrame], *, size: int = 1, seed: int = 0, blocks: int = 1 << 12) -> DataFrame:
    """(first_step, change): the same for each group of ``size`` steps of array columns."""
    from ..functions.augment import partners

    name = metric(scored(df)).columns[0]
    base = metric(scored(df)).select(F.col(name).alias("_base"))
    out = None
    for at in range(0, length, size):
        swap = lambda c: F.transform(c, lambda e, i: F.when(i.between(at, at + size - 1), F.get(f"other_{c}", i)).otherwise(e))  # noqa: B023, E731
        mixed = partners(df, key, seed=seed + at, blocks=blocks).withColumns({c: swap(c) for c in columns}).select(*df.columns)
        one = metric(scored(mixed)).select(F.lit(at).alias("first_step"), F.col(name).alias("_now"))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(base)).select("first_step", (F.col("_now") - F.col("_base")).alias("change"))
