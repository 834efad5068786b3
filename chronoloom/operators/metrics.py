"""Statistics, evaluation metrics and losses as aggregates: columns in, a Column for agg() or a small table out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import Names, continuous_columns, listed, quantiles, running


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


# Regression


def mae(p, t) -> Column:
    return F.avg(F.abs(_c(p) - _c(t)))


def mse(p, t) -> Column:
    return F.avg((_c(p) - _c(t)) * (_c(p) - _c(t)))


def mape(p, t) -> Column:
    """The error over the target, which is 1e-8 at least: as the target keeps its sign, negative ones count as that."""
    return F.avg(F.abs(_c(p) - _c(t)) / F.greatest(_c(t), F.lit(1e-8)))


def huber(p, t, delta: float = 1.0) -> Column:
    d = F.abs(_c(p) - _c(t))
    return F.avg(F.when(d < delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)))


def log_cosh(p, t) -> Column:
    """log(cosh(d)), written so that a large d doesn't overflow."""
    d = F.abs(_c(p) - _c(t))
    return F.avg(d + F.log1p(F.exp(-2 * d)) - math.log(2))


def tweedie(p, t, power: float = 1.5, eps: float = 1e-8) -> Column:
    y = F.greatest(_c(p), F.lit(eps))
    return F.avg(-_c(t) * F.pow(y, F.lit(1 - power)) / (1 - power) + F.pow(y, F.lit(2 - power)) / (2 - power))


def masked(loss, p, t, *args) -> Column:
    """A loss over the rows that have a target."""
    return loss(F.when(_c(t).isNotNull(), _c(p)), t, *args)


# Classification


def confusion(df: DataFrame, actual: str, predicted: str, *, normalize: bool = False) -> DataFrame:
    """(actual, predicted, n[, share of the actual class])."""
    out = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual"))) if normalize else out


def binary_counts(pred: Column, actual: Column) -> dict[str, Column]:
    return {"tp": count_if(pred & actual), "tn": count_if(~pred & ~actual), "fp": count_if(pred & ~actual), "fn": count_if(~pred & actual)}


def binary_metrics(df: DataFrame, score: str | Column, actual: str | Column, threshold: float = 0.5, beta: float = 1.0, by: Names = None) -> DataFrame:
    """Counts, accuracy, precision, recall, specificity, balanced accuracy, F-beta and Matthews' coefficient; null where undefined."""
    pred, act = _c(score) > threshold, _c(actual).cast("boolean")
    counts = [v.alias(k) for k, v in binary_counts(pred, act).items()]
    out = df.groupBy(*listed(by)).agg(*counts) if listed(by) else df.agg(*counts)
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    p, r, s = (F.try_divide(a, a + b) for a, b in ((tp, fp), (tp, fn), (tn, fp)))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    b2 = beta * beta
    return out.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "specificity": s, "balanced_accuracy": (r + s) / 2, "f_beta": F.when(p + r == 0, 0.0).otherwise((1 + b2) * p * r / F.nullif(b2 * p + r, F.lit(0.0))), "mcc": F.when(root == 0, 0.0).otherwise((tp * tn - fp * fn) / F.nullif(root, F.lit(0.0)))})


def multilabel_metrics(df: DataFrame, scores: str, actual: str, threshold: float = 0.5, beta: float = 1.0) -> DataFrame:
    """The same over all elements of two arrays of one length."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(scores).alias("s"), F.col(actual).alias("a"))).alias("x")).select("x.s", "x.a")
    return binary_metrics(pairs, "s", "a", threshold, beta)


def exact_match(scores: str, actual: str, threshold: float = 0.5) -> Column:
    """The share of samples with all labels right."""
    return F.avg(F.forall(F.zip_with(scores, actual, lambda s, a: (s > threshold) == (a > 0)), lambda x: x).cast("double"))


def mean_class_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    each = df.groupBy(actual).agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("a"))
    return each.agg(F.avg("a").alias("mean_class_accuracy"))


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(ece): bins (lo, hi]; confidence 0 is in none."""
    b = F.ceil(F.col(confidence) * bins)
    each = df.groupBy(F.when(F.col(confidence) > 0, b).alias("b")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return each.agg((F.sum(F.when(F.col("b").isNotNull(), F.col("n") * F.abs(F.col("c") - F.col("a"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def calibration_curve(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    b = F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins)).alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("share_correct"))


def threshold_at_specificity(df: DataFrame, score: str, actual: str, specificity: float = 0.95) -> DataFrame:
    """(threshold): the k-th largest score among negatives, k the whole part of their number times 1 - specificity, 1 at least."""
    neg = df.where(F.col(actual) == 0)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * (1 - specificity) + 1e-9))
    # distinct scores with counts, not rows, are ordered, and these in slices
    runs = neg.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("m"))
    runs = running(runs, "threshold", {"below": "m"}, source=neg.select(F.col(score).alias("threshold")))
    total = neg.agg(F.count("*").alias("n"))
    runs = runs.join(F.broadcast(total)).withColumn("upto", F.col("n") - F.col("below") + F.col("m"))
    return runs.where((F.col("upto") >= k) & (F.col("upto") - F.col("m") < k)).select("threshold")


def recall_at_specificity(df: DataFrame, score: str, actual: str, specificity: float = 0.95) -> DataFrame:
    t = threshold_at_specificity(df, score, actual, specificity)
    hit = (F.col(score) > F.col("threshold")) & (F.col(actual) == 1)
    return df.join(F.broadcast(t)).agg((count_if(hit) / F.nullif(count_if(F.col(actual) == 1), F.lit(0))).alias("recall"))


def lift(df: DataFrame, predicted: Column, actual: str) -> DataFrame:
    """(lift): precision of the predicted over the base rate."""
    hits = F.avg(F.when(predicted, F.col(actual).cast("double")))
    return df.agg((hits / F.nullif(F.avg(F.col(actual).cast("double")), F.lit(0.0))).alias("lift"))


def top_share_lift(df: DataFrame, score: str, actual: str, share: float = 0.01, tie: Names = None) -> DataFrame:
    """(lift) of the ``share`` of rows with the largest scores, one row at least."""
    n = df.count()
    k = max(1, int(n * share + 1e-9))
    top = df.orderBy(F.col(score).desc(), *listed(tie)).limit(k).agg(F.avg(F.col(actual).cast("double")).alias("p"))
    base = df.agg(F.avg(F.col(actual).cast("double")).alias("b"))
    return top.join(F.broadcast(base)).select((F.col("p") / F.nullif(F.col("b"), F.lit(0.0))).alias("lift"))


def average_precision(df: DataFrame, score: str, actual: str, by: Names = None) -> DataFrame:
    """(by, ap): the sum of precision times recall's growth over distinct scores; classes without positives are left out."""
    by = listed(by)
    runs = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(actual).cast("long")).alias("_p"), F.count("*").alias("_m"))
    w = Window.partitionBy(*by).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumns({"_tp": F.sum("_p").over(w), "_k": F.sum("_m").over(w)})
    total = F.sum("_p")
    return runs.groupBy(*by).agg((F.sum(F.col("_p") * F.col("_tp") / F.col("_k")) / F.nullif(total, F.lit(0))).alias("ap")).where("ap is not null")


def focal(logits: str, target: str, gamma: float = 2.0, alpha: list[float] | None = None) -> Column:
    """Mean focal loss of an array of logits and a class number."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    logp = F.get(F.col(logits), F.col(target).cast("int")) - top - F.log(total)
    loss = -F.pow(1 - F.exp(logp), gamma) * logp
    return F.avg(loss * F.get(F.array(*[F.lit(a) for a in alpha]), F.col(target).cast("int"))) if alpha else F.avg(loss)


def fit_temperature(df: DataFrame, logits: str, target: str, rounds: int = 4) -> float:
    """The temperature of least negative log-likelihood: a grid that narrows, each grid in one pass."""
    lo, hi = 0.05, 20.0
    for _ in range(rounds):
        grid = [lo * (hi / lo) ** (i / 16) for i in range(17)]
        row = df.agg(*[focal_nll(logits, target, t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        best = min(range(17), key=lambda i: row[f"t{i}"] if row[f"t{i}"] is not None else 0)
        lo, hi = grid[max(0, best - 1)], grid[min(16, best + 1)]
    return (lo * hi) ** 0.5


def focal_nll(logits: str, target: str, temperature: float) -> Column:
    z = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(z)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x / temperature - F.array_max(logits) / temperature)), F.lit(0.0), lambda a, x: a + x)
    return F.avg(F.log(total) + top - F.get(F.col(logits), F.col(target).cast("int")) / temperature)


def center_loss(df: DataFrame, features: str, label: str, centers: DataFrame | None = None) -> DataFrame:
    """(loss): mean squared distance to the class's centre, which is the class's mean if none is given."""
    long = df.select(label, F.posexplode(features).alias("i", "v"))
    centers = long.groupBy(label, "i").agg(F.avg("v").alias("c")) if centers is None else centers.select(label, F.posexplode(features).alias("i", "c"))
    n = df.agg(F.count("*").alias("n"))
    total = long.join(centers, [label, "i"]).agg(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))).alias("s"))
    return total.join(F.broadcast(n)).select((F.col("s") / F.col("n")).alias("loss"))


# Statistics


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho) by average ranks. Ranks come from distinct values with their counts."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        runs = df.groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias("m"))
        runs = running(runs, f"_{c}", {"upto": "m"}, source=df.select(F.col(c).alias(f"_{c}")))
        return runs.select(f"_{c}", (F.col("upto") - (F.col("m") - 1) / 2).alias(f"{c}_rank"))

    both = df.join(ranks(a), F.col(a) == F.col(f"_{a}")).join(ranks(b), F.col(b) == F.col(f"_{b}"))
    return both.agg(F.corr(f"{a}_rank", f"{b}_rank").alias("rho"))


def t_score(c: str) -> Column:
    return F.sqrt(F.count(c)) * F.avg(c) / F.stddev_samp(c)


def _beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    value = 1.0  # the fraction from its far end
    for m in range(300, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + odd / (1 + even / value)
    return front / value


def welch(df: DataFrame, value: str, group: str, a, b) -> dict[str, float]:
    """Welch's t and its two-sided p for two groups' means."""
    row = df.agg(*[f(F.when(F.col(group) == g, F.col(value))).alias(f"{k}{i}") for i, g in enumerate((a, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).first()
    s = [row[f"v{i}"] / row[f"n{i}"] for i in (0, 1)]
    t = (row["m0"] - row["m1"]) / math.sqrt(sum(s))
    nu = sum(s) ** 2 / sum(s[i] ** 2 / (row[f"n{i}"] - 1) for i in (0, 1))
    return {"t": t, "df": nu, "p": _beta_cdf(nu / (nu + t * t), nu / 2, 0.5)}


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, a, b) -> dict[str, float]:
    """The two-sample statistic and its asymptotic p; distinct values with counts are ordered, not rows."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    runs = rows.groupBy(F.col(value).alias("v")).agg(*[count_if(F.col(group) == g).alias(k) for k, g in (("own", a), ("other", b))])
    sums = running(runs, "v", {"a": "own", "b": "other"}, source=rows.select(F.col(value).alias("v")))
    total = runs.agg(F.sum("own").alias("na"), F.sum("other").alias("nb"))
    row = sums.join(F.broadcast(total)).agg(F.max(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb")).first()
    x = row["d"] * math.sqrt(row["na"] * row["nb"] / (row["na"] + row["nb"]))
    return {"d": row["d"], "p": min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))}


def profile(df: DataFrame, columns: Names = None, percents=(1, 25, 50, 75, 99)) -> DataFrame:
    """A row for each variable: n, nulls, percentiles, fences, share outside them, mean and deviation."""
    columns = listed(columns) or continuous_columns(df)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    stats = long.groupBy("variable").agg(F.count("*").alias("n"), count_if(F.col("v").isNull()).alias("n_missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    at = quantiles(df, columns, [0.25, 0.75, *[p / 100 for p in percents]])
    stats = stats.join(F.broadcast(at), "variable", "left")  # a row for each column
    width = F.col("q")[1] - F.col("q")[0]
    stats = stats.withColumns({"lower": F.col("q")[0] - 1.5 * width, "upper": F.col("q")[1] + 1.5 * width, **{f"p{p}": F.col("q")[i + 2] for i, p in enumerate(percents)}})
    out = long.join(F.broadcast(stats.select("variable", "lower", "upper")), "variable").groupBy("variable").agg(F.avg(F.when(F.col("v").isNotNull(), ((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).cast("double"))).alias("outlier_share"))
    return stats.drop("q").join(out, "variable")


def histogram(df: DataFrame, c: str, bins: int = 100) -> DataFrame:
    """(bin from 1, n) between the least and greatest value."""
    edges = df.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
    b = F.when(F.col(c) == F.col("_hi"), bins).otherwise(F.floor((F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1)
    return df.where(F.col(c).isNotNull()).join(F.broadcast(edges)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def kernel_window(kind: str = "gaussian", size: int = 9, sigma: float = 1.0) -> list[float]:
    """A smoothing kernel whose largest weight is 1 (gaussian, laplace) or that falls in a line (triang).

    The gaussian is an impulse filtered over ``size`` places: weights up to four sigma, what passes an end being reflected.
    """
    half = (size - 1) // 2
    if kind == "triang":
        return [(half + 1 - abs(i)) / (half + 1) for i in range(-half, half + 1)]
    if kind == "laplace":
        return [math.exp(-abs(i) / sigma) for i in range(-half, half + 1)]
    if kind != "gaussian":
        raise ValueError("kind must be gaussian, triang or laplace")
    n, far = 2 * half + 1, int(4 * sigma + 0.5)
    out = [0.0] * n
    for i in range(n):
        for k in range(-far, far + 1):
            at = (i + k) % (2 * n)
            if (at if at < n else 2 * n - 1 - at) == half:
                out[i] += math.exp(-k * k / (2 * sigma * sigma))
    return [v / max(out) for v in out]


def label_distribution_weights(df: DataFrame, label: str, bins: int = 100, *, kernel: list[float] | None = None, power: float = 1.0, most: float | None = None) -> DataFrame:
    """df with lds_weight: the inverse of the smoothed share of labels nearby, mean 1."""
    kernel = kernel or kernel_window()
    half = len(kernel) // 2
    edges = df.agg(F.min(label).cast("double").alias("_lo"), F.max(label).cast("double").alias("_hi"))
    b = F.when(F.col("_hi") == F.col("_lo"), 1).when(F.col(label) == F.col("_hi"), bins).otherwise(F.floor((F.col(label) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1).cast("int")
    binned = df.join(F.broadcast(edges)).withColumn("_bin", b).drop("_lo", "_hi")
    counts = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    spread = counts.select("_n", F.posexplode(F.array(*[F.lit(k) for k in kernel])).alias("_i", "_k"), "_bin").groupBy((F.col("_bin") + F.col("_i") - half).alias("_bin")).agg(F.sum(F.col("_n") * F.col("_k")).alias("_s"))
    w = F.pow(1 / F.col("_s"), power)
    weights = counts.join(spread, "_bin").withColumn("_w", F.least(w, F.lit(most)) if most else w)
    mean = weights.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_m"))
    weights = weights.join(F.broadcast(mean)).select("_bin", (F.col("_w") / F.col("_m")).alias("lds_weight"))
    return binned.join(F.broadcast(weights), "_bin", "left").drop("_bin")  # a row for each bin at most


def top_losses(df: DataFrame, loss: str, k: int = 9, *, largest: bool = True, tie: Names = None) -> DataFrame:
    return df.orderBy(F.col(loss).desc_nulls_last() if largest else F.col(loss).asc_nulls_last(), *listed(tie)).limit(k)


def hardest_share(df: DataFrame, loss: str, share: float, by: Names, tie: Names = None) -> DataFrame:
    """Within each batch, the rows of largest loss that make up a share of its total."""
    w = Window.partitionBy(*listed(by)).orderBy(F.col(loss).desc(), *listed(tie))
    upto = F.sum(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(loss)
    return df.withColumn("_u", upto).withColumn("_t", F.sum(loss).over(Window.partitionBy(*listed(by)))).where(F.col("_u") < F.col("_t") * share).drop("_u", "_t")


def minimal_features(df: DataFrame, value: str, ids: Names) -> DataFrame:
    """The ten basic descriptors of each series."""
    v = F.col(value)
    return df.groupBy(*listed(ids)).agg(
        F.sum(v).alias("sum_values"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg(v).alias("mean"), F.count("*").alias("length"), F.stddev_pop(v).alias("standard_deviation"),
        F.var_pop(v).alias("variance"), F.sqrt(F.avg(v * v)).alias("root_mean_square"), F.max(v).alias("maximum"), F.max(F.abs(v)).alias("absolute_maximum"), F.min(v).alias("minimum"),
    )


def naive_forecast(df: DataFrame, value: str, order: Names, ids: Names = None, horizon: int = 1) -> DataFrame:
    """Adds forecast, the value ``horizon`` rows ago."""
    from .frame import over

    return df.withColumn("forecast", F.lag(value, horizon).over(over(ids, order)))
