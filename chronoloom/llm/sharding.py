"""A store of immutable shards with size-tiered compaction and versioned manifests, on DataFrame reads and writes alone.

Arrivals become small runs. Runs of one size tier (powers of ``fan_in``) are merged, once there are ``fan_in`` of them, into a
run of target-sized files. A manifest names a version's runs; it is written aside and renamed into place, which fails if the
version exists. Readers see a whole version or the one before, and runs that no manifest names are leftovers of writers
that died.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read, scratch

MB = 1 << 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Shards below ``root``, a path that Spark can write to.

    target: bytes of a file after compaction. least: runs below so many bytes are of tier 0. Null values, empty texts and
    repeated rows are kept as they are; an empty arrival is a run without rows; columns may be added by later arrivals.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 256 * MB, least: int = 4 * MB, fan_in: int = 4):
        if fan_in < 2 or target < 1 or least < 1:
            raise ValueError("fan_in must be 2 at least, target and least positive")
        self.spark, self.root, self.target, self.least, self.fan_in = spark, root.rstrip("/"), target, least, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(name[1:-5]) for s in self._fs.listStatus(at) if (name := s.getPath().getName()).startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the latest by default."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "runs": [], "schema": None}
        stream = self._fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, runs: list[dict], schema: dict | None) -> dict:
        """Makes the manifest of ``version`` appear at once; Conflict if there is one."""
        out = {"version": version, "runs": runs, "schema": schema}
        aside, place = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:010d}.json")
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(out).encode())
        stream.close()
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(place).toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(place), self.spark.sparkContext._gateway.new_array(how, 0))
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(place):
                raise Conflict(f"version {version} exists") from e
            raise
        return out

    def _write(self, df: DataFrame) -> dict:
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
        files = [s.getLen() for s in self._fs.listStatus(self._path(f"runs/{name}")) if s.getPath().getName().endswith(".parquet")]
        return {"id": name, "files": len(files), "bytes": sum(files), "rows": self.spark.read.schema(df.schema).parquet(f"{self.root}/runs/{name}").count()}

    def tier(self, run: dict) -> int:
        n, size = 0, self.least
        while run["bytes"] >= size:
            n, size = n + 1, size * self.fan_in
        return n

    def append(self, df: DataFrame) -> dict:
        """Adds the rows as a run and commits a version with it; tries again if another writer was first."""
        run = self._write(df)
        while True:
            now = self.manifest()
            schema = StructType.fromJson(now["schema"]) if now["schema"] else StructType()
            known = {f.name: f.dataType for f in schema}
            for f in df.schema:
                if known.get(f.name, f.dataType) != f.dataType:
                    raise ValueError(f"column {f.name} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
            schema = StructType([*schema, *[f for f in df.schema if f.name not in known]])
            try:
                return self.commit(now["version"] + 1, [*now["runs"], run], json.loads(schema.json()))
            except Conflict:
                continue

    def _rows(self, runs: list[dict], schema: dict) -> DataFrame:
        schema = StructType.fromJson(schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/runs/{r['id']}" for r in runs]) if runs else self.spark.createDataFrame([], schema)

    def compact(self) -> dict:
        """Merges each tier that has ``fan_in`` runs, from the smallest on, till none has; a commit for each merge."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in now["runs"]:
                tiers.setdefault(self.tier(run), []).append(run)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]
            if not full:
                return now
            old = tiers[full[0]]
            files = max(1, -(-sum(r["bytes"] for r in old) // self.target))
            run = self._write(self._rows(old, now["schema"]).coalesce(files))
            gone = {r["id"] for r in old}
            while True:
                now = self.manifest()
                if not gone <= {r["id"] for r in now["runs"]}:
                    break  # another compaction took them; ours is a leftover
                try:
                    self.commit(now["version"] + 1, [*[r for r in now["runs"] if r["id"] not in gone], run], now["schema"])
                    break
                except Conflict:
                    continue

    def rows(self, version: int | None = None) -> DataFrame:
        """A version's rows, the latest's by default."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing has been appended")
        return self._rows(now["runs"], now["schema"])

    def vacuum(self) -> int:
        """Removes runs that the latest version doesn't name, and older manifests. Not while others read or write."""
        now = self.manifest()
        named, n = {r["id"] for r in now["runs"]}, 0
        for s in self._fs.listStatus(self._path("runs")):
            if s.getPath().getName() not in named:
                n += bool(self._fs.delete(s.getPath(), True))
        for v in self.versions()[:-1]:
            self._fs.delete(self._path(f"manifests/v{v:010d}.json"), False)
        return n


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """The rows in n ranges of doc_id, those without one first."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return [docs]
    step = (hi - lo) // n + 1
    first = [docs.where("doc_id is null")] if not docs.where("doc_id is null").isEmpty() else []
    return first + [docs.where((F.col("doc_id") >= lo + i * step) & (F.col("doc_id") < lo + (i + 1) * step)) for i in range(n)]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a store: eight arrivals, compacted; the last version's rows are what was appended."""
    root = f"{scratch(spark)}/shards-{uuid.uuid4().hex}"
    store = ShardStore(spark, root)
    store._fs.deleteOnExit(store._path(""))
    for part in arrivals(read(spark, sf_dir, "documents"), 8):
        store.append(part)
        store.compact()
        store.vacuum()
    return store.rows().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


OP2_SQL = "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"
