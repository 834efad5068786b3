"""Near copies by the exact similarity of word shingles: SimHash's wider radius.

Two texts at 0.8 differ in some ten of 64 bits, beyond what segments with one deleted bit can index. So candidates are named
twice: by SimHash deletion variants at two bits (of the distinct shingles), and by a second signature, min-hash bands: of a
text's distinct shingles, 48 minima under different hashes make 16 bands of three. Two texts of similarity s agree in a band
with probability s^3, so a pair at 0.8 shares none with probability 0.00001. Candidates are verified by the Jaccard
similarity of their whole sets. Work is on distinct sets, so copies cost nothing.

First each set is compared with the least of its bands, which links most of a group of copies by one comparison for each member.
Bands that hold more than ``hot`` sets (passages that very many texts share) are not paired: round by round, each member is
compared with one member, drawn at random in a band, of another class than its own, as long as most comparisons are links. What is of
different classes then is compared exactly, by prefixes: of a set's shingles in the order of their rarity, two sets as similar
as asked must share one among the first few, so passages that many share, last in this order, bring no pairs together. In the other bands
all pairs of different classes are compared.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop, hinted, keep_least, lookup, pick, stash
from .simhash import links as bit_links
from .simhash import voted

BANDS, ROWS = 16, 3
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
#: Rounds in a row in which fewer than this share of the comparisons are links, after which members of hot bands are compared by prefixes:
#: rounds only merge classes sooner, results are the same without any.
IDLE, YIELD = 1, 0.5


def shingles(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    grams = map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8", max(1, len(words) - k + 1)))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]).min(0))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def _long(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp, n, sim, bands): hash, size and SimHash of the set of shingles, and its bands' keys. Null text: as empty."""

    def run(batches):
        for b in batches:
            sets = [shingles(t or b"", k) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps, sizes = _long([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]), [len(s) for s in sets]
            sims = _long([voted(iter(s), len(s)) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array(sizes, pa.int32()), pa.array(sims), pa.array([_long(bands(s)) for s in sets], pa.list_(pa.int64()))], ["doc_id", "fp", "n", "sim", "bands"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, n int, sim long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(fp, s): the sets themselves."""

    def run(batches):
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                s = shingles(t or b"", k)
                yield pa.RecordBatch.from_arrays([pa.array(_long([xxhash.xxh64_intdigest(s.tobytes())])), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["fp", "s"])

    return docs.select("text").mapInArrow(run, "fp long, s array<long>")


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of sets (fp, n, class, s) of different classes that may be as similar as asked; all that are, are among these.

    Two sets whose Jaccard similarity is t or more share t / (1 + t) of their sizes' sum, so, in one order of all shingles, their first common
    one has at least that many places left in either. The order is by frequency, rarest first. Only classes that meet in a
    shingle are paired, so what one class has of it is never compared with itself; and of these only pairs of which one has the shingle in
    a shorter prefix, if their sizes and the places left, at best, allow for any pair of their sets.
    """
    rows = sets.select("fp", "n", "class", F.explode("s").alias("h"))
    counts = stash(rows.groupBy("h").agg(F.count("*").alias("f")), "near-counts")
    ranked = lookup(rows, counts.withColumn("times", F.col("f")), ["h"], "f")
    at = F.row_number().over(Window.partitionBy("fp").orderBy("times", "h")) - 1
    left = lambda share: F.col("n") - F.col("at") >= F.ceil(share * F.col("n") - 1e-9)
    entries = stash(ranked.withColumn("at", at).where(left(F.lit(similarity)) & (F.col("times") > 1)).select("fp", "n", "class", "h", "at"), "near-prefixes")
    # The smaller set of a pair (of equal ones that with the smaller hash) has the shorter prefix.
    x = entries.where(left(F.lit(2 * similarity / (1 + similarity)))).select(F.col("fp").alias("x"), F.col("n").alias("p"), F.col("class").alias("c"), "h", F.col("at").alias("i"))
    y = entries.select(F.col("fp").alias("y"), F.col("n").alias("q"), F.col("class").alias("d"), "h", F.col("at").alias("j"))
    best = lambda side, c, n, at, as_: side.groupBy("h", c).agg(F.min(n).alias(f"{as_}_least"), F.max(n).alias(f"{as_}_most"), F.max(F.col(n) - F.col(at)).alias(f"{as_}_left"))
    sized = (F.col("x_least") <= F.col("y_most")) & (F.col("x_most") >= similarity * F.col("y_least"))
    placed = F.least("x_left", "y_left") >= F.ceil(similarity / (1 + similarity) * (F.col("x_least") + F.col("y_least")) - 1e-9)
    meet = best(x, "c", "p", "i", "x").join(best(y, "d", "q", "j", "y"), "h").where((F.col("c") != F.col("d")) & sized & placed)
    meet = stash(meet.select("h", "c", "d"), "near-meet")
    needed = F.ceil(similarity / (1 + similarity) * (F.col("p") + F.col("q")) - 1e-9)
    ordered = (F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("x") < F.col("y")))
    fit = ordered & (F.col("p") >= similarity * F.col("q")) & (F.least(F.col("p") - F.col("i"), F.col("q") - F.col("j")) >= needed)
    met = x.join(meet, ["h", "c"]).join(y, ["h", "d"]).where(fit)
    # Those shared so far, and what is left in either behind the last of them, must still be enough.
    met = met.groupBy("x", "y", "p", "q").agg(F.count("*").alias("same"), F.max("i").alias("i"), F.max("j").alias("j"))
    met = met.where(F.col("same") + F.least(F.col("p") - F.col("i"), F.col("q") - F.col("j")) - 1 >= needed)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, hot: int = 32) -> DataFrame:
    """(doc_id, component_id) for each row: the class of texts linked at ``similarity`` of their distinct shingles or more.

    component_id is the smallest doc_id reachable, the row's own included. Null or blank texts are copies of each other. Null
    doc_id: the row is kept; it takes its text's class and names none (null if it is alone). Repeated rows stay repeated.
    """
    docs = pick(docs, "doc_id", "text")
    seen = stash(sketches(docs, shingle), "near")
    nodes = stash(seen.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "near-nodes")
    # Sets whose sizes differ more can't be so similar.
    sized = lambda a, b: F.least(F.col(a), F.col(b)) >= similarity * F.greatest(F.col(a), F.col(b))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # SimHash: sets of one fingerprint are compared with the least of them, and these across linked fingerprints
    sims = stash(nodes.groupBy("sim").agg(F.min("fp").alias("rep")), "near-sims")
    one = nodes.join(hinted(sims), "sim").where("fp <> rep").select(*pair("fp", "rep"))
    bits = stash(bit_links(sims.select(F.col("sim").alias("fp"))), "near-bits")
    ends = sims.select(F.col("sim").alias("a"), F.col("rep").alias("x")), sims.select(F.col("sim").alias("b"), F.col("rep").alias("y"))
    two = bits.join(ends[0], "a").join(ends[1], "b").select(*pair("x", "y"))
    # Bands
    index = nodes.select("fp", "n", F.explode("bands").alias("key"))
    met = stash(index.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("fp", "n")).alias("rep")).where("members > 1"), "near-met")
    shared = stash(index.join(hinted(met), "key").select("key", "fp", "n", "members", F.col("rep.fp").alias("b"), F.col("rep.n").alias("q")), "near-shared")
    first = shared.where((F.col("fp") != F.col("b")) & sized("n", "q")).groupBy("fp").agg(F.min("b").alias("b")).select(*pair("fp", "b"))
    first = stash(one.unionByName(two).unionByName(first).distinct(), "near-first")
    # The sets of what may be compared, by one row for each
    asked = stash(first.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(shared.select("fp")).distinct(), "near-asked")
    ids = stash(nodes.join(hinted(asked), "fp", "left_semi").select(F.col("id").alias("side_id")).where("side_id is not null").distinct(), "near-ids")
    texts = docs.join(hinted(ids), docs["doc_id"] == F.col("side_id"), "left_semi").unionByName(docs.where("doc_id is null"))
    sets = stash(_sets(texts, shingle).join(hinted(asked), "fp", "left_semi").dropDuplicates(["fp"]), "near-sets")

    def verified(some: DataFrame) -> DataFrame:
        # b, which may be one set's partner in many pairs, is joined first, while rows are narrow
        both = some.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("t")), "b").join(sets.select(F.col("fp").alias("a"), "s"), "a")
        same = F.size(F.array_intersect("s", "t"))
        return stash(both.where(same / (F.size("s") + F.size("t") - same) >= similarity).select("a", "b"), "near-links")

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("root", "fp")).drop("root")

    links = verified(first)
    roots = stash(components(links), "near-roots")
    crowd = shared.where(F.col("members") > hot).select("key", "fp", "n")
    idle, at, tried = 0, 0, first
    while idle < IDLE and not crowd.isEmpty():
        now = stash(classed(crowd), "near-now")
        drawn = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(at)), F.col("fp").alias("fp"), F.col("n").alias("n"), F.col("class").alias("class"))).alias("x"), F.min("class").alias("lo"), F.max("class").alias("hi"))
        drawn = drawn.where("lo <> hi").select("key", F.col("x.fp").alias("y"), F.col("x.n").alias("q"), F.col("x.class").alias("own"))
        more = now.join(drawn, "key").where((F.col("class") != F.col("own")) & sized("n", "q")).select(F.col("fp").alias("x"), "y", *pair("fp", "y")).distinct()
        more = more.join(tried, ["a", "b"], "left_anti").groupBy("x").agg(F.min(F.struct(F.xxhash64("a", "b", F.lit(at)), "a", "b")).alias("p"))
        more = stash(more.select("p.a", "p.b").distinct(), "near-more")
        drop(now)
        new = verified(more)
        tried, at = tried.unionByName(more), at + 1
        made = new.count()
        idle = idle + 1 if made < YIELD * more.count() or not made else 0
        if made:
            links = links.unionByName(new)
            roots = stash(components(links), "near-roots")
        elif more.isEmpty():
            break
    # What shares a hot band and is of different classes still
    now = classed(crowd)
    apart = now.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    left = stash(now.join(apart, "key", "left_semi").select("fp", "n", "class").distinct(), "near-left")
    if not left.isEmpty():
        # A few partners of each set first: what these link needs no further comparison. Then more, till no pair of two classes is left.
        untried, some = stash(prefix_pairs(left.join(sets, "fp"), similarity).join(tried, ["a", "b"], "left_anti"), "near-untried"), 2
        while not untried.isEmpty():
            ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
            apart = untried.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
            apart = stash(apart.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))), "near-apart")
            found = verified(apart.where(F.col("turn") <= some).select("a", "b"))
            untried, some = apart.where(F.col("turn") > some).select("a", "b"), 16 * some
            if not found.isEmpty():
                links = links.unionByName(found)
                roots = stash(components(links), "near-roots")
    # What shares a band that isn't hot and is of different classes still
    some = stash(classed(shared.where(F.col("members").between(2, hot)).select("key", "fp", "n")), "near-some")
    apart = some.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    some = some.join(apart, "key", "left_semi")
    x, y = some.select("key", F.col("fp").alias("a"), F.col("n").alias("p"), F.col("class").alias("c")), some.select("key", F.col("fp").alias("b"), F.col("n").alias("q"), F.col("class").alias("d"))
    rest = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & sized("p", "q")).select("a", "b").distinct()
    rest = verified(stash(rest.join(tried, ["a", "b"], "left_anti"), "near-rest"))
    if not rest.isEmpty():
        links = links.unionByName(rest)
        roots = stash(components(links), "near-roots")
    linked = stash(nodes.select("fp", "id").join(roots.withColumnRenamed("node", "fp"), "fp"), "near-linked")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    named = stash(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id")), "near-named")
    return seen.select("doc_id", "fp").join(hinted(named), "fp", "left").select("doc_id", "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without the near copies; which rows stay: see common.keep_least()."""
    return keep_least(docs, near_copies(docs, **how))
