"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes start at words; two that share ``width`` words are to meet in one group. Two windows of ``width`` equal words choose
the same anchor, the least of the hashes of their ``gram``-word pieces, so suffixes are dealt out by that piece first:

1. Census: anchors (one in some 16 words) are counted by document. A prefix that only one document holds has a tree without
   inner nodes that matter, and goes.
2. Stretches of suffixes that are the same as a whole stand once, for their least doc_id; the copies are repeats.
   A prefix with more than ``leaves`` suffixes is made longer: its suffixes are dealt out anew by their first ``gram`` words,
   what is still too many by some more, and so on. A prefix that has come to all ``width`` words is the path of one node: its
   least doc_id is an aggregate by that path, summed up before rows move. So every group fits in memory, whatever its text.
3. A group's tree is its sorted suffixes and the lengths of the prefixes that neighbours have in common. Neighbours with
   ``width`` words or more in common are the leaves below one deep inner node; the least of these lengths is the node's depth,
   its path the longest text that all of its leaves share. At leaves of all documents but the least, that text is a repeat.

A tree knows its suffixes up to the last window of their anchor; repeats that go on are put together by the documents' words.
Only documents with a shared prefix move as text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, hinted, pick, read, stash

GRAM = 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads sums of products over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))
    n, size, at, out = len(h) - gram + 1, 1, 0, None
    power = h.copy()  # hashes of runs of 1, 2, 4... words
    for bit in range(gram.bit_length()):
        if gram >> bit & 1:
            part = power[at : at + n]
            out = part.copy() if out is None else _mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
            at += size
        if len(power) > size:
            power = _mix(power[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:])
        size *= 2
    return out


def anchors(words: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors' word numbers and hashes, and for each window the number of its anchor among them.

    The anchor is the least hash of the window's pieces, on a tie the leftmost.
    """
    h = gram_hashes(words, gram)
    span, n = width - gram + 1, len(words) - width + 1
    least, size = h.copy(), 1  # minima of runs of 1, 2, 4... pieces
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    low = np.minimum(least[:n], least[span - size : span - size + n])
    # The leftmost place of each window's minimum: the next place, from the window's start on, that has this hash.
    order = np.lexsort((np.arange(len(h)), h))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    key = h[order]
    base = len(h) + 1
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    packed = group * base + order  # sorted: by hash, then by place
    at = np.searchsorted(key, low)
    place = order[np.searchsorted(packed, group[at] * base + np.arange(n))]
    places, which = np.unique(place, return_inverse=True)
    return places, h[places], which


def _census(width: int, gram: int):
    def run(batches):
        for b in batches:
            ids, counts, digests, found, ends = b.column(0), [], [], [], [0]
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                counts.append(len(words))
                digests.append(xxhash.xxh128_digest(b" ".join(words)))
                h = np.unique(anchors(words, width, gram)[1]).view(np.int64) if len(words) >= width else np.empty(0, np.int64)
                found.append(h)
                ends.append(ends[-1] + len(h))
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), arrays], ["doc_id", "n_words", "digest", "anchors"])

    return run


SUFFIXES = "anchor long, doc_id long, start int, n int, span binary, digest binary"
WINDOWS = "prefixes array<long>, doc_id long, start int, path binary"
#: Words whose trees are built at once, if single groups are smaller.
FOREST_WORDS = 200_000
FLAGS = "doc_id long, lo int, hi int"


def _spans(width: int, gram: int):
    """For each shared prefix of a document, the stretch of words that its suffixes need."""
    names, types = ["anchor", "doc_id", "start", "n", "span", "digest"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names)

    def run(batches):
        for b in batches:
            out = []
            for doc, text, shared in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                places, hashes, which = anchors(words, width, gram)
                for i in np.flatnonzero(np.isin(hashes.view(np.int64), np.array(shared, np.int64))):
                    lo, hi = np.searchsorted(which, [i, i + 1])  # windows of an anchor are neighbours
                    span = b" ".join(words[lo : hi - 1 + width])
                    out.append((int(hashes.view(np.int64)[i]), doc, int(lo), int(hi - lo), span, xxhash.xxh128_digest(span)))
                    if len(out) == 5000:  # together the spans are several times the text
                        yield made(out)
                        out = []
            yield made(out)

    return run


def ranks(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For runs of 1, 2, 4... words from each place on, their ranks; a run that reaches its span's end is cut there."""
    out, size, here = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1, np.arange(len(ids))
    longest = int((ends - here).max(initial=1))
    while size < longest:
        r = out[-1]
        after = np.where(here + size < ends, np.append(r, np.zeros(size, np.int64))[size:] + 1, 0)
        out.append(np.unique(r * (len(ids) + 1) + after, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return out


def in_common(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at places ``a`` and ``b`` have in common from their start, within their spans."""
    a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    end_a, end_b, last = ends[a], ends[b], len(ends) - 1
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        same = (a + size <= end_a) & (b + size <= end_b) & (levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)])
        step = np.where(same, size, 0)
        a, b, n = a + step, b + step, n + step
    return n


def trees(rows: list[tuple[int, int, int, int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeats of whole groups, (prefix, doc_id, start, n, span) each: doc_id, first and last window of each repeated leaf."""
    number = defaultdict(count().__next__)
    spans = [np.fromiter(map(number.__getitem__, span.split(b" ")), np.int64) for *_, span in rows]
    size = np.fromiter(map(len, spans), np.int64, len(spans))
    n = np.fromiter((r[3] for r in rows), np.int64, len(rows))
    first = np.cumsum(size) - size
    ends = np.repeat(first + size, size)
    levels = ranks(np.concatenate(spans), ends)
    row = np.repeat(np.arange(len(rows)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = first[row] + nth
    prefix, doc, start = (np.fromiter((r[i] for r in rows), np.int64, len(rows))[row] for i in range(3))
    order = np.lexsort((levels[-1][place], prefix))
    place, prefix, doc, start = place[order], prefix[order], doc[order], (start + nth)[order]
    common = np.where(prefix[1:] == prefix[:-1], in_common(levels, ends, place[:-1], place[1:]), 0)
    opens = np.flatnonzero(np.append(True, common < width))  # the first leaf below each deep inner node, or a leaf alone
    node = np.cumsum(np.append(True, common < width)) - 1
    least = np.minimum.reduceat(doc, opens)
    depth = np.minimum.reduceat(np.append(np.where(common < width, np.iinfo(np.int64).max, common), np.iinfo(np.int64).max), opens)
    hit = doc > least[node]
    return doc[hit], start[hit], start[hit] + depth[node[hit]] - width


def _trees(width: int):
    """Over suffixes sorted by prefix: the trees of as many whole groups at once as hold FOREST_WORDS words."""

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held > FOREST_WORDS and row[0] != rows[-1][0]:
                    yield _flags(*trees(rows, width))
                    rows, held = [], 0
                rows.append(row)
                held += row[3] + width
        if rows:
            yield _flags(*trees(rows, width))

    return run


def _flags(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Leaves to stretches: those of one document that meet are one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if len(doc):
        offset = (doc != np.append(doc[:1], doc[:-1])).cumsum() * (int(hi.max()) + 2)  # documents one behind the other
        reach = np.maximum.accumulate(hi + offset)
        new = np.append(True, (lo + offset)[1:] > reach[:-1] + 1)
        opens = np.flatnonzero(new)
        doc, lo, hi = doc[opens], lo[opens], np.maximum.reduceat(hi, opens)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc_id", "lo", "hi"])


def _windows(width: int, lengths: list[int]):
    """Suffixes one by one, with hashes of their first words."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, start, n, span in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at = np.append(np.flatnonzero(np.frombuffer(span + b" ", np.uint8) == 32), 0)  # the last is the place before the first word
                for j in range(n):
                    s = at[j - 1] + 1 if j else 0
                    out.append(([xxhash.xxh64_intdigest(span[s : at[j + k - 1]], k) - (1 << 63) for k in lengths], doc, start + j, span[s : at[j + width - 1]]))
                if len(out) >= 5000:
                    yield _suffixes(out)
                    out = []
            yield _suffixes(out)

    return run


def _suffixes(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["prefixes", "doc_id", "start", "path"])


def _removed(width: int):
    """(doc_id, text, flagged stretches) to the result's digests."""

    def run(batches):
        for b in batches:
            kept_texts, gone, total = [], [], []
            for text, flags in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                total.append(len(words))
                if flags:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for f in flags:
                        cover[min(f["lo"], len(words))] += 1
                        cover[min(f["hi"] + width, len(words))] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                kept_texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def stretches(docs: DataFrame, width: int = 50, gram: int = GRAM, leaves: int = 8192) -> DataFrame:
    """(doc_id, lo, hi): windows lo to hi of a document, by their first words' numbers, also start in documents with a smaller doc_id.

    Stretches of one document may overlap. ``leaves`` bounds the suffixes of a group and changes no result. Null or blank text,
    and rows without a doc_id, have none; repeated rows are one document.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    census = stash(docs.mapInArrow(_census(width, gram), "doc_id long, n_words long, digest binary, anchors array<long>").where(f"doc_id is not null and n_words >= {width}"), "substring-census")
    # Texts with the same words are one text: of each such class the least doc_id stands for all, the others go whole.
    classes = stash(census.groupBy("digest").agg(F.min("doc_id").alias("first")), "substring-classes")
    whole = census.select("doc_id", "n_words", "digest").distinct().join(classes, "digest").where("doc_id > first").select("doc_id", F.lit(0).alias("lo"), (F.col("n_words") - width).cast("int").alias("hi"))
    whole = stash(whole, "substring-whole")
    held = census.join(hinted(whole.select("doc_id")), "doc_id", "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = stash(shared, "substring-shared")
    hits = stash(held.join(hinted(shared), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared")), "substring-hits")
    hits = hits.withColumnRenamed("doc_id", "side_id")
    suffixes = attach(docs, hits).where("shared is not null").select("doc_id", "text", "shared").mapInArrow(_spans(width, gram), SUFFIXES)
    suffixes = stash(suffixes, "substring-suffixes")
    # Of stretches that are the same as a whole, the least doc_id's stand for all; the others' leaves are repeats without a tree.
    firsts = suffixes.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("digest", "a")
    firsts = hinted(stash(firsts, "substring-firsts"))
    copies = suffixes.select("doc_id", "start", "n", "digest").join(firsts, "digest").where("doc_id > a").select("doc_id", F.col("start").alias("lo"), F.expr("start + n - 1").alias("hi"))
    suffixes = stash(suffixes.join(firsts, "digest", "left").where("a is null or doc_id = a").select("anchor", "doc_id", "start", "n", "span"), "substring-distinct")
    large = hinted(stash(suffixes.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > leaves).select("anchor"), "substring-large"))
    groups = suffixes.join(large, "anchor", "left_anti").select(F.col("anchor").alias("prefix"), "doc_id", "start", "n", "span")
    lengths = [*range(gram, width, max((width - gram) // 3, 1))]
    rest = stash(suffixes.join(large, "anchor", "left_semi").select("doc_id", "start", "n", "span").mapInArrow(_windows(width, lengths), WINDOWS), "substring-windows")
    for i in range(len(lengths)):
        rest = rest.withColumn("prefix", F.get("prefixes", i))
        crowded = hinted(stash(rest.groupBy("prefix").count().where(F.col("count") > leaves).select("prefix"), f"substring-crowded-{lengths[i]}"))
        groups = groups.unionByName(rest.join(crowded, "prefix", "left_anti").select("prefix", "doc_id", "start", F.lit(1).alias("n"), F.col("path").alias("span")))
        rest = rest.join(crowded, "prefix", "left_semi")
    found = groups.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(width), FLAGS)
    nodes = rest.groupBy("path").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("path", "a")
    nodes = hinted(stash(nodes, "substring-nodes"))  # a table of its own: a hot node's rows can then be split in the join
    paths = rest.join(nodes, "path").where("doc_id > a").select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return found.unionByName(paths).unionByName(copies).unionByName(whole)


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = GRAM, leaves: int = 8192) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row.

    Removes each word covered by a window of ``width`` words that also starts in a document with a smaller doc_id; kept words
    are joined by one space. Null or blank text: no words. Rows without a doc_id lose nothing and make nothing a repeat.
    Repeated rows are one document. Extra columns are ignored; an empty table gives an empty one. Windows are compared word by
    word; texts and stretches that are the same as a whole are known by 128 bits of hash.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    flags = stretches(docs, width, gram, leaves).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("flags"))
    flags = stash(flags, "substring-flags").withColumnRenamed("doc_id", "side_id")
    return attach(docs, flags).select("doc_id", "text", "flags").mapInArrow(_removed(width), "doc_id long, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's words before and after."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS path FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY path) AS least FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM m WHERE least < doc_id),
a AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, ws, gone, list_filter(ws, lambda w, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN a USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
