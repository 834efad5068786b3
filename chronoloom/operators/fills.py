"""Fills, gaps, duplicates and rolling values along a panel's order. All of one call's windows share one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import Names, after, before, listed, over, whole


def ffill(c: str | Column, w) -> Column:
    """The last value so far; leading nulls stay."""
    return F.last(c, ignorenulls=True).over(before(w))


def bfill(c: str | Column, w) -> Column:
    return F.first(c, ignorenulls=True).over(after(w))


def fbfill(c: str | Column, w) -> Column:
    return F.coalesce(ffill(c, w), bfill(c, w))


def fill_missing(df: DataFrame, columns: Names, order: Names, ids: Names = None, method: str | None = "ffill", value: float | None = 0) -> DataFrame:
    """Fills by ffill, bfill or fbfill within each entity, then what is left by the value (None: stays null)."""
    w = over(ids, order)
    how = {"ffill": ffill, "bfill": bfill, "fbfill": fbfill}
    done = {c: how[method](c, w) if method else F.col(c) for c in listed(columns)}
    return df.withColumns({c: v if value is None else F.coalesce(v, F.lit(value)) for c, v in done.items()})


def drop_duplicates(df: DataFrame, keys: Names, order: Names, keep: str | bool = "last") -> DataFrame:
    """One row for each key: the first or last in the order; keep=False: only rows whose key is theirs alone."""
    if keep is False:
        return df.withColumn("_n", F.count("*").over(whole(keys))).where("_n = 1").drop("_n")
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in listed(order)]
    return df.withColumn("_rn", F.row_number().over(whole(keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def gaps(df: DataFrame, columns: Names, order: Names, ids: Names = None, *, forward: bool = True, backward: bool = True, nearest: bool = True, normalize: bool = False) -> DataFrame:
    """Adds c_dt_fwd, c_dt_bwd and c_dt_nearest: steps to the nearest value strictly before or after the row.

    Without such a value, the steps to just beyond the entity's end. normalize: over the entity's number of rows.
    """
    w = over(ids, order)
    df = df.withColumns({"_rn": F.row_number().over(w), "_n": F.count("*").over(whole(ids))})
    out = {}
    for c in listed(columns):
        seen = F.when(F.col(c).isNotNull(), F.col("_rn"))
        fwd = F.col("_rn") - F.coalesce(F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bwd = F.coalesce(F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("_n") + 1) - F.col("_rn")
        kinds = [("fwd", fwd, forward), ("bwd", bwd, backward), ("nearest", F.least(fwd, bwd), nearest)]
        out |= {f"{c}_dt_{k}": (v / F.col("_n") if normalize else v.cast("long")) for k, v, on in kinds if on}
    return df.withColumns(out).drop("_rn", "_n")


def rolling_mean(c: str | Column, w, window: int = 2) -> Column:
    """The mean of up to ``window`` rows to this one, nulls left out."""
    return F.avg(c).over(w.rowsBetween(-(window - 1), 0))


def diff(c: str, w, lag: int = 1, pad: bool = True) -> Column:
    d = F.col(c) - F.lag(c, lag).over(w)
    return F.when(F.row_number().over(w) <= lag, F.lit(0.0)).otherwise(d) if pad else d


def log_return(c: str, w, lag: int = 1, pad: bool = True) -> Column:
    d = F.log(c) - F.log(F.lag(c, lag).over(w))
    return F.when(F.row_number().over(w) <= lag, F.lit(0.0)).otherwise(d) if pad else d


def moving_average(c: str, w, ids: Names, kernel: int) -> Column:
    """Centred mean of ``kernel`` rows; beyond the ends the first and last value are repeated."""
    left, right = (kernel - 1) // 2, kernel // 2
    rn, n = F.row_number().over(w), F.count("*").over(whole(ids))
    first, last = F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.sum(c).over(w.rowsBetween(-left, right))
    return (inside + first * F.greatest(F.lit(0), left - rn + 1) + last * F.greatest(F.lit(0), rn + right - n)) / kernel


def decompose(df: DataFrame, c: str, order: Names, ids: Names = None, kernel: int = 25) -> DataFrame:
    """Adds c_trend, the moving average, and c_residual."""
    df = df.withColumn(f"{c}_trend", moving_average(c, over(ids, order), ids, kernel))
    return df.withColumn(f"{c}_residual", F.col(c) - F.col(f"{c}_trend"))


def interpolate(df: DataFrame, columns: Names, order: Names, ids: Names = None) -> DataFrame:
    """Linear by row number between known values; the ends are held; an entity without values gets 0."""
    w = over(ids, order)
    df = df.withColumn("_rn", F.row_number().over(w))
    out = {}
    for c in listed(columns):
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("r"), F.col(c).cast("double").alias("v")))
        p, q = F.last(at, ignorenulls=True).over(before(w)), F.first(at, ignorenulls=True).over(after(w))
        line = p["v"] + (q["v"] - p["v"]) * (F.col("_rn") - p["r"]) / F.nullif(q["r"] - p["r"], F.lit(0))
        out[c] = F.coalesce(F.col(c).cast("double"), line, p["v"], q["v"], F.lit(0.0))
    return df.withColumns(out).drop("_rn")


def rev_in(df: DataFrame, columns: Names, ids: Names, order: Names = None, *, subtract_last: bool = False, eps: float = 1e-5) -> DataFrame:
    """Each instance less its mean (or last value), over its population deviation. Adds c_center and c_scale for the inverse."""
    out, w = {}, whole(ids)
    for c in listed(columns):
        center = F.last(c).over(over(ids, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if subtract_last else F.avg(c).over(w)
        out |= {f"{c}_center": center, f"{c}_scale": F.sqrt(F.var_pop(c).over(w) + eps)}
    df = df.withColumns(out)
    return df.withColumns({c: (F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale") for c in listed(columns)})


def rev_in_inverse(df: DataFrame, columns: Names) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.col(f"{c}_scale") + F.col(f"{c}_center") for c in listed(columns)})
