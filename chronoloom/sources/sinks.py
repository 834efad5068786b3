"""Where results go: tables, arrays for other tools, and made-up tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, *, by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes Parquet (a folder for each value of ``by``, such as split) and gives the table that reads it lazily."""
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_up(spark: SparkSession, samples: int, variables: int, length: int, *, seed: int = 0, value: float | None = None) -> DataFrame:
    """(sample_id, x0, x1, ...): uniform numbers from the sample and the step, or one value throughout."""
    from ..functions.augment import uniform

    cell = lambda v: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.lit(value) if value is not None else uniform(seed + v, F.col("id"), i))
    return spark.range(samples).select(F.col("id").alias("sample_id"), *[cell(v).alias(f"x{v}") for v in range(variables)])


def read_npy(spark: SparkSession, path: str | list[str], *, rows_name: str = "row") -> DataFrame:
    """(file, row, values): the rows of .npy files, gzipped or not, each flat. A file must fit one task."""

    def run(frames):
        import gzip
        import io

        import numpy as np
        import pandas as pd

        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float)
                for i in range(0, len(a), 10_000):
                    part = a[i : i + 10_000]
                    yield pd.DataFrame({"file": name, rows_name: np.arange(i, i + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {rows_name} long, values array<double>")
