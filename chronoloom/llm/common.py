"""What the corpus operators share: words, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the inside of a regular expression's class.
WS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a stashed table, as its values are held in memory, that may be broadcast. Larger ones are shuffled.
BROADCAST_BYTES = 64 << 20
#: A key with more than this part of all rows is hot; so many keys at most can be.
PARTS = 1 << 16


def words(text: Column) -> Column:
    """The array of words ``[^\\x20\\x09-\\x0D]+``; null or blank text: an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+", -1))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. lower() does that much faster where there is nothing but ASCII."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, use) -> Column:
    """use(value) with value worked out once: an expression within a lambda is otherwise worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with an operator's own."""
    return df.select(*[df[c] for c in columns])


def others(df: DataFrame, *own: str) -> list[str]:
    """The columns that an operator passes through: those not named like its own."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name in taken:
        name += "_"
    return name


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: the cluster's spark.checkpoint.dir.

    Where that is unset, a local folder serves a local master (tests); on a cluster that's an error, as executors have disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_STASHED: dict = {}


@atexit.register
def _sweep() -> None:
    """Removes what is left when Python ends; the JVM's own hook comes too late where it is killed."""
    for fs, p in _STASHED.values():
        with contextlib.suppress(Exception):  # the JVM may be gone
            fs.delete(p, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it again: later work survives lost executors and repeats nothing.

    The table goes when the application ends, or earlier with drop().
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    _STASHED[path] = fs, p
    fs.deleteOnExit(p)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a stashed table that nothing reads any more."""
    fs, p = _STASHED.pop(df._stashed)
    fs.delete(p, True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a stashed table's values take at most so many bytes in memory, counted over all its rows."""
    fixed = 16 + sum(8 for f in df.schema if f.dataType.typeName() not in ("string", "binary", "array"))
    size = F.lit(fixed)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16
        elif kind == "array":
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)) * 2 + 16
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def hinted(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of a stashed table that small() finds small enough; else Spark shuffles it."""
    return F.broadcast(df) if small(df, most) else df


def lookup(rows: DataFrame, side: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows inner join side, a stashed table with a row for each key that says in ``weight`` how many rows have it.

    Keys with more than 1/65,536 of all rows, which 65,536 at most can be, are broadcast if these take 64 MB at most: their rows, most
    of all, stay where they are and none makes a large partition. The rows of all other keys are shuffled.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    side_ = side.drop(weight)
    hot = side.where(F.col(weight) * PARTS > total).drop(weight)
    if not small(hot):
        return rows.join(side_, keys)
    cold = side.where(F.col(weight) * PARTS <= total).drop(weight)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def attach(docs: DataFrame, side: DataFrame, key: str = "side_id") -> DataFrame:
    """docs left join side on doc_id, which side, a stashed table, has as ``key``, once each. Names of side are none of docs.

    If side's ids are few enough to broadcast, only the rows that have a partner are shuffled.
    """
    ids, rest = side.select(key), [f for f in side.schema if f.name != key]
    on = docs["doc_id"] == F.col(key)
    if not small(ids):
        return docs.join(side, on, "left").drop(key)
    hit = docs.join(F.broadcast(ids), on, "left_semi")
    miss = docs.join(F.broadcast(ids), on, "left_anti").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    return hit.join(side, hit["doc_id"] == side[key]).drop(key).unionByName(miss)


def keep_least(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class (doc_id, component_id), the row of docs with the smallest doc_id stays.

    Of repeated rows with that doc_id one stays. Rows without a doc_id stay, as nothing names them. Columns are those of docs.
    """
    own = fresh("own_id", docs)
    found = stash(classes.where("doc_id is not null"), "classes")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = stash(found.where("doc_id <> component_id").select(F.col("doc_id").alias(own)), "classes-gone")
        return docs.join(hinted(gone), docs["doc_id"] == F.col(own), "left_anti")
    stay = stash(found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct(), "classes-stay")
    one = docs.join(hinted(stay), docs["doc_id"] == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long and not null: (node, root), root being the least node.

    Alternates two star rewrites till nothing changes, which takes a logarithmic number of rounds; each round's
    edges are a scratch table. An empty input gives an empty result.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()) if state["n"] else now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # With many edges, least neighbours are tables of their own: the join can then split the rows of a node with very many.
        own = (lambda df: stash(df, "cc-own")) if state["n"] > 1_000_000 else (lambda df: df)
        least = own(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = own(large)
        least = own(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stash(small.where("u <> v").distinct(), "cc")
        drop(now)
        now = after
