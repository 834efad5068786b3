"""What the jobs share: settings, the command line, counted writes, and folders for the registered queries."""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """A job's settings: the file beside it, or another one whose values replace these. An unknown name is an error."""
    own = tomllib.loads((Path(__file__).parent / f"{name}.toml").read_text())
    more = tomllib.loads(Path(path).read_text()) if path else {}
    if unknown := set(more) - set(own):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return own | more


def write(df: DataFrame, path: str, by: list[str], what: str, *, dynamic: bool = False) -> int:
    """Writes Parquet partitioned by columns and logs the rows, counted as they are written. dynamic: only the partitions that come are replaced."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    rows = seen.get["rows"]
    log.info("wrote %d rows of %s to %s", rows, what, path)
    return rows


def main(name: str, run: Callable, about: str) -> None:
    """The command line: only here a session is made and stopped."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("--source", required=True, help="path of the input table, anything that Spark reads")
    parser.add_argument("--target", required=True, help="folder of the output, local or remote")
    parser.add_argument("--config", help=f"a file of settings in place of those of {name}.toml")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.source, args.target, **settings(name, args.config))
    finally:
        spark.stop()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share. On a local master, where spark.checkpoint.dir may be unset, any folder is shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(path or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
