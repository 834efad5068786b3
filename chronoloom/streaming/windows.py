"""Sliding windows over a stream: each key's last rows are state, a full window is emitted with each new row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, every: str, keys: list[str], value: str, *, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean, least and greatest value of each key and window; rows later than the watermark are dropped."""
    w = F.window(time, every, slide) if slide else F.window(time, every)
    out = df.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "least", "greatest")


def sliding(df: DataFrame, key: str, order: str, value: str, window_len: int) -> DataFrame:
    """(key, at, x): the last ``window_len`` values of a key up to each row, once there are so many.

    Rows of one batch are taken in their order; rows that are older than a key's last one are dropped. key is a long, order a
    long (such as microseconds) and value a double.
    """
    import pandas as pd

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, [])
        held = list(held)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        at, xs = [], []
        for t, v in zip(rows["at"].tolist(), rows["value"].tolist(), strict=True):
            if last is not None and t < last:
                continue
            last = t
            held = [*held, float(v)][-window_len:]
            if len(held) == window_len:
                at.append(t)
                xs.append(held)
        state.update((last, held))
        yield pd.DataFrame({"key": [k[0]] * len(at), "at": at, "x": xs})

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, "key long, at long, x array<double>", "last long, held array<double>", "append", "NoTimeout")
