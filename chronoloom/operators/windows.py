"""Frames for forecasting and classification: history, horizon, stride, anchoring, padding and patches.

A window of entity e is anchored at its last history row. With n rows of e after ``start`` and the furthest horizon step mx,
the number of windows is 1 + (n - mx - L) // stride; ``padding`` says at which end the unused rows are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import Names, listed, number_panel, numbered, over, sliceable, whole


def horizon_steps(horizon: int | list[int]) -> list[int]:
    """0: the window's last step; h > 0: 1 to h; h < 0: h + 1 to 0; a list: as it is."""
    if not isinstance(horizon, int):
        return list(horizon)
    return [0] if horizon == 0 else list(range(1, horizon + 1)) if horizon > 0 else list(range(horizon + 1, 1))


def sliding_windows(
    df: DataFrame,
    order: Names,
    x: Names,
    window_len: int,
    *,
    ids: Names = None,
    y: Names = None,
    horizon: int | list[int] = 0,
    stride: int | None = 1,
    start: int = 0,
    pad_remainder: bool = False,
    padding: str = "post",
    padding_value: float | None = None,
    add_padding_feature: bool = True,
    y_is_x_checked: bool = True,
    chunk: int = 100_000,
    chunked: bool | None = None,
    ascending: bool = True,
    y_func: Callable[[Column], Column] | None = None,
    processor: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(ids, order of the anchor, window, x arrays, y): one row for each window, windows numbered from 0 in each entity.

    A y column is a scalar for one horizon step and an array for several. stride 0 or None: windows don't overlap.
    Entities that are too short have no window unless the remainder is padded. Null values keep their places. With
    padding, ``padding_flag`` is an array of 1 for padded steps. ``chunked`` series (by default one without ids; not padded) are
    numbered in slices and framed in chunks of so many rows, each with the few rows around it that its windows reach: no task holds an
    entity. Not ascending: steps run from the order's end to its start. y_func makes of each y column, an array of its steps or one
    step, what stands for it, and may look into the window. ``processor`` makes of all windows what is returned: an
    expression over them, a filter, or mapInPandas for a function over batches of windows.
    """
    if padding not in ("pre", "post"):
        raise ValueError("padding must be 'pre' or 'post'")
    ids, order, x, y = listed(ids), listed(order), listed(x), listed(y)
    stride = stride or window_len
    steps = horizon_steps(horizon) if y else [0]
    mx, mn = max(0, *steps), min(steps)
    if y and mn <= 0 and y_is_x_checked and not y_func and set(x) & set(y):
        raise ValueError("a target within the window must not be one of its features")
    chunked = not ids if chunked is None else chunked
    if chunked and pad_remainder:
        chunked = False if not ids else _refuse("a padded panel can't be chunked")
    df = df.select(*dict.fromkeys([*ids, *order, *x, *y]))
    df = number_panel(df, ids, order, "_rn", "_all") if chunked and ids and sliceable(df, order[0]) else numbered(df, ids, order, "_rn", "_all")
    df = df if ascending else df.withColumn("_rn", F.col("_all") + 1 - F.col("_rn"))
    df = df.where(F.col("_rn") > start).withColumn("_rn", F.col("_rn") - start).withColumn("_n", F.col("_all") - start)
    need = F.col("_n") - mx - window_len
    by = ["_rn"]
    if pad_remainder:
        count = F.greatest(F.lit(0), F.ceil(need / F.lit(stride)).cast("int")) + 1
        span = F.lit(window_len + mx) + (count - 1) * stride
        extra = df.groupBy(*ids).agg(F.max("_n").alias("_n")) if ids else df.agg(F.max("_n").alias("_n")).where("_n is not null")
        extra = extra.withColumn("_add", span - F.col("_n")).where("_add > 0").select(*ids, "_n", "_add", F.explode(F.sequence(F.lit(1), F.col("_add"))).alias("_k"))
        at = F.col("_n") + F.col("_k") if padding == "post" else F.col("_k") - F.col("_add")
        types = {f.name: f.dataType for f in df.schema}
        fill = {c: (F.lit(padding_value) if c in x else F.lit(None)).cast(types[c]) for c in [*order, *x, *y] if c not in ids}
        extra = extra.select(*ids, *[v.alias(c) for c, v in fill.items()], at.cast("int").alias("_rn"), F.lit(None).cast("long").alias("_all"), "_n", F.lit(1).alias("_pad"))
        df = df.withColumn("_pad", F.lit(0)).unionByName(extra)
        # Rows before the first have numbers up to 0: all are numbered anew.
        low = F.min("_rn").over(whole(ids))
        df = df.withColumn("_rn", (F.col("_rn") - low + 1)).withColumn("_n", F.count("*").over(whole(ids)))
        need = F.col("_n") - mx - window_len
    parts = list(ids)
    if chunked:
        back, size = window_len - 1 + max(0, -mn), max(chunk, window_len + mx + max(0, -mn))
        own, at = F.floor((F.col("_rn") - 1) / size), F.pmod(F.col("_rn") - 1, F.lit(size))
        also = F.array(own, F.when(at < mx, own - 1), F.when(at >= size - back, own + 1))
        df = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.filter(also, lambda c: c.isNotNull())))
        parts = [*ids, "_chunk"]
    w = over(parts, by)
    first = F.lit(0) if padding == "post" or not mx or pad_remainder else F.pmod(need, F.lit(stride))
    frame = w.rowsBetween(-(window_len - 1), 0)
    step = F.struct("_rn", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(x)], *(["_pad"] if pad_remainder else []))
    df = df.withColumn("_w", F.collect_list(step).over(frame))
    ahead = {}
    for c in y:
        cells = [F.lead(c, h).over(w) if h > 0 else F.lag(c, -h).over(w) if h < 0 else F.col(c) for h in steps]
        ahead[c] = cells[0] if len(cells) == 1 else F.array(*cells)
    df = df.withColumns({f"_y{i}": v for i, v in enumerate(ahead.values())})
    df = df.where("_own = _chunk") if "_chunk" in parts else df
    anchor = F.col("_rn") - first - window_len
    df = df.where((anchor >= 0) & (anchor % stride == 0) & (F.col("_rn") + mx <= F.col("_n")))
    ahead = {c: F.col(f"_y{i}") if y_func is None else y_func(F.col(f"_y{i}")) for i, c in enumerate(y)}
    out = df.select(
        *ids,
        *[o for o in order if o not in ids],
        (anchor / stride).cast("long").alias("window"),
        *[_member(i).alias(f"{c}_x" if c in y or c in order or c in ids else c) for i, c in enumerate(x)],
        *[v.alias(f"{c}_y" if c in x or c in order or c in ids else c) for c, v in ahead.items()],
        *([F.transform("_w", lambda s: s["_pad"]).alias("padding_flag")] if pad_remainder and add_padding_feature else []),
    )
    return processor(out) if processor else out


def _refuse(why: str):
    raise ValueError(why)


def _member(i: int) -> Column:
    return F.transform("_w", lambda s: s[f"_x{i}"])


def window_aggregates(df: DataFrame, order: Names, x: str, window_len: int, *, ids: Names = None, horizon: int = 1, aggregates=("mean",)) -> DataFrame:
    """Aggregates of each full window and the value ``horizon`` steps on, without making arrays: the cheap form for features.

    Null steps are left out of the aggregates but count as steps. Columns: those of df, x_<aggregate> and y.
    """
    kinds = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp, "count": F.count}
    w = over(ids, order)
    frame = w.rowsBetween(-(window_len - 1), 0)
    df = df.withColumns({**{f"x_{a}": kinds[a](x).over(frame) for a in aggregates}, "y": F.lead(x, horizon).over(w), "_rn": F.row_number().over(w), "_ahead": F.lead(F.lit(1), horizon).over(w)})
    return df.where((F.col("_rn") >= window_len) & F.col("_ahead").isNotNull()).drop("_rn", "_ahead")


def sparse_windows(df: DataFrame, order: Names, x: Names, lags: list[int], *, ids: Names = None, y: Names = None, horizons: list[int] = (1,)) -> DataFrame:
    """Windows of stride 1 over listed lags (0 or less) and horizons: x arrays by lag, y arrays by horizon; full ones only."""
    if any(k > 0 for k in lags) or list(lags) != sorted(lags):
        raise ValueError("lags must be 0 or less and ascending")
    ids, order, x, y = listed(ids), listed(order), listed(x), listed(y)
    w, mx = over(ids, order), max(0, *horizons)
    cell = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k > 0 else F.col(c)
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole(ids)))
    out = df.select(*ids, *order, "_rn", "_n", *[F.array(*[cell(c, k) for k in lags]).alias(f"{c}_x") for c in x], *[F.array(*[cell(c, k) for k in horizons]).alias(f"{c}_y") for c in y])
    return out.where((F.col("_rn") > -lags[0]) & (F.col("_rn") + mx <= F.col("_n"))).drop("_rn", "_n")


def forecasting_pairs(df: DataFrame, order: Names, history: int, horizon: int = 1, *, ids: Names = None, x: Names = None, y: Names = None) -> DataFrame:
    """All pairs of ``history`` and the next ``horizon`` steps, as arrays; x and y may be the same columns."""
    return sliding_windows(df, order, x, history, ids=ids, y=y, horizon=list(range(1, horizon + 1)), y_is_x_checked=False)


def usable_anchors(df: DataFrame, order: Names, history: int, horizon: int, *, ids: Names = None, stride: int = 1) -> DataFrame:
    """The rows that have full history and horizon, thinned by the stride from the end. Adds ``position``, from 0."""
    df = numbered(df, ids, order, "_rn", "_n")
    ok = (F.col("_rn") >= history) & (F.col("_rn") + horizon <= F.col("_n")) & (F.pmod(F.col("_n") - horizon - F.col("_rn"), F.lit(stride)) == 0)
    return df.where(ok).withColumn("position", (F.col("_rn") - 1).cast("long")).drop("_rn", "_n")


def windows_on_the_fly(df: DataFrame, order: Names, x: Names, window_len: int, *, ids: Names = None, stride: int = 1, drop_start: int = 0, drop_end: int = 0) -> DataFrame:
    """Windows without a target over the rows between the first ``drop_start`` and the last ``drop_end``."""
    df = numbered(df, ids, order, "_rn", "_n")
    df = df.where((F.col("_rn") > drop_start) & (F.col("_rn") <= F.col("_n") - drop_end)).drop("_rn", "_n")
    return sliding_windows(df, order, x, window_len, ids=ids, stride=stride)


def union_sources(parts: dict[str, DataFrame], order: Names) -> DataFrame:
    """Several tables as one: ``source``, its place in the dict, and the row's number in it."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        one = df.withColumn("source", F.lit(name)).withColumn("source_no", F.lit(i).cast("long"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy("source").orderBy(*listed(order))
    return out.withColumn("source_row", (F.row_number().over(w) - 1).cast("long"))
