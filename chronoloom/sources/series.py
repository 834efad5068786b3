"""Data sources for the text formats ``.ts`` (labelled series) and ``.tsf`` (series with attributes), and CSV presets.

Files are found by Spark, so that any store that it reads will do; a file's header is parsed with its body, in one task for
each file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TS_SCHEMA = "file string, sample_id long, dim int, step int, ts string, value double, label string"
TSF_SCHEMA = "file string, series_id long, attributes map<string,string>, frequency string, horizon int, series_value array<double>"
#: Steps ahead that are forecast by default. Fixed values.
HORIZONS = {"10_minutes": 1008, "half_hourly": 336, "hourly": 168, "daily": 30, "weekly": 8, "monthly": 12}
#: Each frequency's interval. Fixed values.
FREQUENCIES = {
    "4_seconds": "4 seconds", "minutely": "1 minute", "10_minutes": "10 minutes", "half_hourly": "30 minutes", "hourly": "1 hour",
    "daily": "1 day", "weekly": "7 days", "monthly": "1 month", "quarterly": "3 months", "yearly": "12 months",
}


class ParseError(ValueError):
    """A file doesn't follow its format."""


def parse_ts(lines: list[str], *, lower: bool = True) -> Iterator[tuple[int, int, int, str | None, float | None, str | None]]:
    """(sample, dimension, step, time, value, label) of a .ts file's lines; ``?`` is a null value."""
    tags: dict[str, str] = {}
    started, dims, sample = False, None, 0
    for raw in lines:
        line = (raw.lower() if lower else raw).strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            name, _, rest = line[1:].partition(" ")
            name = name.lower()
            if name == "data":
                missing = {"problemname", "timestamps", "univariate"} - set(tags) | (set() if {"classlabel", "targetlabel"} & set(tags) else {"classlabel or targetlabel"})
                if missing:
                    raise ParseError(f"missing before @data: {', '.join(sorted(missing))}")
                started = True
            elif started:
                raise ParseError("a tag after @data")
            else:
                tags[name] = rest.strip()
            continue
        if not started:
            raise ParseError("data before @data")
        labelled = tags.get("classlabel", tags.get("targetlabel", "false")).split()[0].lower() == "true"
        parts, label = _dimensions(line), None
        if labelled:
            *parts, label = parts
            if "targetlabel" not in tags and label not in (names := tags["classlabel"].split()[1:]) and names:
                raise ParseError(f"unknown class {label}")
        if dims is None:
            dims = len(parts)
        if not parts or len(parts) != dims:
            raise ParseError(f"sample {sample} has {len(parts)} dimensions, not {dims}")
        for d, body in enumerate(parts):
            for step, (time, value) in enumerate(_steps(body, tags["timestamps"].lower() == "true")):
                yield sample, d, step, time, value, label
        sample += 1
    if not started:
        raise ParseError("no @data" if tags else "empty file")


def _dimensions(line: str) -> list[str]:
    """Parts between colons, but for colons within parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(line):
        depth += (c == "(") - (c == ")")
        if c == ":" and not depth:
            out.append(line[at:i])
            at = i + 1
    return [*out, line[at:]]


def _steps(body: str, timed: bool) -> Iterator[tuple[str | None, float | None]]:
    number = lambda s: None if s in ("?", "nan") else float(s)
    if not timed:
        for v in filter(None, body.split(",")):
            yield None, number(v.strip().lower())
        return
    for pair in filter(None, (p.strip(" ,(") for p in body.split(")"))):
        time, comma, value = pair.rpartition(",")
        if not comma:
            raise ParseError(f"not (time,value): {pair}")
        yield time.strip(), number(value.strip().lower())


def parse_tsf(lines: list[str]) -> Iterator[tuple[dict[str, str], str | None, int | None, list[float | None]]]:
    """(attributes, frequency, horizon, values) of a .tsf file's lines; ``?`` is a null value."""
    columns: list[tuple[str, str]] = []
    tags: dict[str, str] = {}
    started = False
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            name, *rest = line[1:].split(" ")
            if name == "data":
                if not columns:
                    raise ParseError("no attributes before @data")
                started = True
            elif name == "attribute":
                if len(rest) != 2 or rest[1] not in ("numeric", "string", "date"):
                    raise ParseError(f"bad attribute: {line}")
                columns.append((rest[0], rest[1]))
            elif len(rest) != 1:
                raise ParseError(f"bad tag: {line}")
            else:
                tags[name] = rest[0]
            continue
        if not started:
            raise ParseError("data before @data")
        fields = line.split(":")
        if len(fields) != len(columns) + 1:
            raise ParseError(f"{len(fields) - 1} attributes, not {len(columns)}")
        values = [None if v == "?" else float(v) for v in fields[-1].split(",")]
        if all(v is None for v in values):
            raise ParseError("all values of a series are missing")
        attributes = {}
        for (name, kind), value in zip(columns, fields, strict=False):
            if kind == "numeric":
                int(value)
            if kind == "date":
                d, _, t = value.partition(" ")
                value = f"{d} {t.replace('-', ':') or '00:00:00'}"
            attributes[name] = value
        yield attributes, tags.get("frequency"), int(tags["horizon"]) if "horizon" in tags else None, values
    if not started:
        raise ParseError("no @data")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_ts(spark: SparkSession, path: str | list[str], *, lower: bool = True) -> DataFrame:
    """All steps of the files' samples, a row each; ``sample_id`` counts within a file."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = [(name, *r) for r in parse_ts(content.decode("utf-8").splitlines(), lower=lower)]
                for i in range(0, len(rows), 100_000):
                    part = pd.DataFrame(rows[i : i + 100_000], columns=["file", "sample_id", "dim", "step", "ts", "value", "label"])
                    part["value"] = part["value"].astype("Float64")
                    yield part

    return _files(spark, path).mapInPandas(run, TS_SCHEMA)


def read_tsf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each series."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = [(name, i, *r) for i, r in enumerate(parse_tsf(content.decode("cp1252").splitlines()))]
                yield pd.DataFrame(rows, columns=["file", "series_id", "attributes", "frequency", "horizon", "series_value"])

    return _files(spark, path).mapInPandas(run, TSF_SCHEMA)


def explode_series(df: DataFrame, values: str = "series_value", start: str | None = None, every: str | None = None, keep: list[str] = ()) -> DataFrame:
    """(keep, step, time, value): the time of step i is start plus i intervals."""
    out = df.select(*keep, *([F.col(start).cast("timestamp_ntz").alias("_start")] if start else []), F.posexplode(values).alias("step", "value"))
    if start:
        n, unit = (every or "1 day").split(" ")
        unit = unit.rstrip("s")
        if unit in ("month", "year"):
            time = F.add_months("_start", F.col("step") * int(n) * (12 if unit == "year" else 1)).cast("timestamp_ntz")
        else:
            seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * int(n)
            time = F.timestamp_micros(F.unix_micros(F.col("_start").cast("timestamp")) + F.col("step").cast("long") * (seconds * 1_000_000)).cast("timestamp_ntz")
        out = out.withColumn("time", time).drop("_start")
    return out


def splits_of(spark: SparkSession, parts: dict[str, str], reader=read_ts) -> DataFrame:
    """Files of predefined splits as one table, with split."""
    out = None
    for name, path in parts.items():
        one = reader(spark, path).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def to_arrays(long: DataFrame, keys: list[str], dim: str = "dim", step: str = "step", value: str = "value", dims: int | None = None) -> DataFrame:
    """(keys, x0, x1, ...): an array for each dimension, in the steps' order; null values keep their place."""
    dims = dims if dims is not None else long.agg(F.max(dim)).first()[0] + 1
    each = [F.transform(F.array_sort(F.collect_list(F.when(F.col(dim) == d, F.struct(F.col(step).alias("s"), F.col(value).alias("v"))))), lambda z: z["v"]).alias(f"x{d}") for d in range(dims)]
    return long.groupBy(*keys).agg(*each)


def to_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, step, columns): a row for each step of arrays of one length."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return df.select(*keys, F.posexplode(zipped).alias("step", "_z")).select(*keys, "step", *[F.col(f"_z.{c}").alias(c) for c in columns])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, n_missing, n_distinct) in one pass."""
    aggs = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col("n"), (F.col("n") - F.col(f"n{i}")).alias("n_missing"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Ten-minute weather to hourly: every sixth row from the sixth, wind speeds of -9999 as 0, wind as vectors, day and year cycles."""
    import math

    df = spark.read.csv(path, header=True, inferSchema=False)
    time = F.to_timestamp(F.col("`Date Time`"), "dd.MM.yyyy HH:mm:ss")
    df = df.withColumn("date", time)
    hourly = df.where(F.minute("date") == 0)
    wind = lambda c: F.when(F.col(f"`{c}`").cast("double") == -9999, 0.0).otherwise(F.col(f"`{c}`").cast("double"))
    angle = F.radians(F.col("`wd (deg)`").cast("double"))
    seconds = F.unix_timestamp("date")
    cycles = {n: seconds * 2 * math.pi / s for n, s in (("day", 86400.0), ("year", 365.2425 * 86400))}
    return hourly.select(
        "date", F.col("`T (degC)`").cast("double").alias("temperature"), F.col("`p (mbar)`").cast("double").alias("pressure"), F.col("`rho (g/m**3)`").cast("double").alias("density"),
        (wind("wv (m/s)") * F.cos(angle)).alias("wx"), (wind("wv (m/s)") * F.sin(angle)).alias("wy"), (wind("max. wv (m/s)") * F.cos(angle)).alias("max_wx"), (wind("max. wv (m/s)") * F.sin(angle)).alias("max_wy"),
        *[f(a).alias(f"{n}_{k}") for n, a in cycles.items() for k, f in (("sin", F.sin), ("cos", F.cos))],
    )


def read_long_term(spark: SparkSession, path: str, *, freq: str | None = None, time: str = "date") -> DataFrame:
    """A CSV of one multivariate series; with a frequency, duplicates go (the last stays), gaps are filled forward."""
    from ..operators.calendar import prepare

    raw = spark.read.csv(path, header=True)
    df = raw.select(F.to_timestamp(time).cast("timestamp_ntz").alias(time), *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns if c != time])
    return prepare(df, time, freq, method="ffill", columns=[c for c in df.columns if c != time]) if freq else df
