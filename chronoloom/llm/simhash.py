"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments, so of two fingerprints that differ in 2 (or 3) bits, one segment differs
by one bit at most. Each segment is indexed under its 32 one-wildcard variants (one bit deleted); equal variants meet in an
equality join and the full fingerprints are verified. Work is on distinct fingerprints, so copies cost nothing.

Index entries that hold more than ``hot`` fingerprints are not paired: every fingerprint in one is indexed instead under all
its two-wildcard variants, which four fingerprints at most can share and which prove a link without more ado. So no
group's size enters as a square and no link is lost.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hinted, keep_least, pick, read, stash

BITS = 64
#: Fingerprints whose index entries one task makes.
ENTRIES_PER_TASK = 250_000


def voted(hashes, n: int) -> int:
    """The fingerprint of n hashes, an iterator: a bit is set if over half the hashes have it."""
    votes, left = np.zeros(BITS, np.int64), n
    while left > 0:  # in pieces: a very long text needs no more memory
        h = np.fromiter(hashes, "<u8", min(left, 1 << 16))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        left -= len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash of a text's k-word shingles, repeats included; a shorter text is one shingle, one without words gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else iter([b" ".join(words)])
    return voted(map(xxhash.xxh64_intdigest, shingles, repeat(42)), max(1, len(words) - k + 1))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null text: as empty."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t or b"", k) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """The 64 one-wildcard variants of both segments: (bit's number, the segment with that bit deleted) as one long."""
    out = []
    for p in range(BITS):
        segment = fp.bitwiseAND(F.lit(0xFFFFFFFF)) if p < 32 else F.shiftrightunsigned(fp, 32)
        out.append(segment.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << p % 32))).bitwiseOR(F.lit(p << 32)))
    return F.array(*out)


def links(fps: DataFrame, distance: int = 2, hot: int = 32) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect all pairs at up to so many bits, 2 at most."""
    if not 0 <= distance <= 2:
        raise ValueError("distance: 0 to 2 bits")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    # Fingerprints fill few files, but their 64 entries each are the work: dealt out anew, so that every core has a part.
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() // ENTRIES_PER_TASK + 1)
    index = fps.repartition(parts).select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    met = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    met = stash(met.where((F.col("n") > 2) | (F.col("n") == 2) & near("a", "b")), "simhash-met")
    out = met.where("n = 2").select("a", "b")
    some = hinted(met.where((F.col("n") > 2) & (F.col("n") <= hot)).select("key"))
    kept = stash(index.join(some, "key", "left_semi"), "simhash-some")
    x, y = kept.select("key", F.col("fp").alias("a")), kept.select("key", F.col("fp").alias("b"))
    out = out.unionByName(x.join(y, "key").where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b"))
    crowd = met.where(F.col("n") > hot).select("key")
    if not crowd.isEmpty():
        fp = stash(index.join(hinted(crowd), "key", "left_semi").select("fp").distinct(), "simhash-crowd")
        if distance == 2:
            two = fp.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i")).select("fp", "i", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("j")).where("i < j")
            mask = F.expr("shiftleft(1L, i) | shiftleft(1L, j)")
        else:
            two = fp.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"), F.lit(0).alias("j"))
            mask = F.expr("shiftleft(1L, i)")
        hub = two.select("fp", mask.alias("m")).groupBy("m", F.col("fp").bitwiseAND(F.bitwise_not(F.col("m"))).alias("key")).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x"))
        # With two bits free a hub holds at most four fingerprints: those at its ends, and, by the xor of all, the others.
        a, m = F.col("a"), F.col("m")
        third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
        low = m.bitwiseAND(-m) if distance == 2 else m
        rest = [F.col("key"), F.col("key").bitwiseOR(low), F.col("key").bitwiseOR(m.bitwiseXOR(low)), F.col("key").bitwiseOR(m)]
        others = F.when(F.col("n") == 2, F.array("b")).when(F.col("n") == 3, F.array(F.col("b"), third)).otherwise(F.array(*rest))
        out = out.unionByName(hub.where("n > 1 and " + ("true" if distance else "false")).select("a", F.explode(others).alias("b")).where(a != F.col("b")))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, hot: int = 32) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the class of texts linked at up to ``distance`` differing bits.

    component_id is the smallest doc_id reachable, the row's own included. Null or blank text: fingerprint 0, linked like any
    other. Null doc_id: the row is kept; it takes its fingerprint's class and names none (null if it is alone). Repeated
    rows stay repeated. Extra columns are ignored; an empty table gives an empty one.
    """
    fps = stash(fingerprints(docs, shingle), "simhash")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), distance, hot))
    linked = stash(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id"))
    named = hinted(stash(named, "simhash-named"))  # a table of its own: the rows of a frequent fingerprint can be split
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, similarity: float | None = None, **how) -> DataFrame:
    """The rows of docs without the near duplicates; which rows stay: see common.keep_least().

    Texts are near duplicates by their fingerprints' bits, or, with ``similarity``, by their distinct shingles: then the index of
    deletion variants names candidates, min-hash bands name those that differ in more bits, and the sets decide (nearcopies.py).
    """
    if similarity is None:
        return keep_least(docs, near_duplicates(docs, **how))
    from .nearcopies import near_copies

    return keep_least(docs, near_copies(docs, similarity=similarity, **how))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of all documents at 3-word shingles and two bits."""
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
