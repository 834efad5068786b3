"""Line dedup with DataFrame functions alone.

Lines are exploded as hashed keys (no text moves), documents are counted per key after a partial sum, and each document
is put together again by position without the lines whose key is over the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach, fresh, hinted, let, pick, read, stash


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def lines(text: Column) -> Column:
    """Null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _mark(line: Column, least_chars: int) -> Column:
    """128 bits of hash of a key that is long enough, as two longs; null if it is shorter."""
    both = lambda key: F.when(F.char_length(key) >= least_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))
    return F.when(F.char_length(line) >= least_chars, let(line_key(line), both))


def frequent(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, drop): for each document that loses lines, the hashes of their keys."""
    marks = F.array_distinct(F.filter(F.transform(lines(F.col("text")), lambda x: _mark(x, least_chars)), lambda x: x.isNotNull()))
    held = pick(docs, "doc_id", "text").where("doc_id is not null").select("doc_id", F.explode(marks).alias("m")).select("doc_id", "m.h", "m.g")
    # Each document counts once for a key even if its row is repeated; counts of single rows are summed before they move.
    once = held if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty() else held.distinct()
    over = once.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs)
    over = stash(over.select("h", "g", "keeper"), "lines-over")
    lost = held.join(hinted(over), ["h", "g"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("drop"))


def drop_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """The rows of docs with ``kept_text``, ``n_lines`` and ``n_dropped`` in place of whatever had these names.

    A key of at least ``least_chars`` code points found in at least ``least_docs`` documents loses all its lines, except in
    the largest doc_id that holds it. Null or empty text is one empty line. Rows without a doc_id aren't counted and
    keep all lines. Repeated rows are one document, and all lose the same. An empty table gives an empty one.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    key, gone, left = (fresh(x, docs) for x in ("side_id", "drop", "kept"))
    lost = stash(frequent(docs, least_chars, least_docs).select(F.col("doc_id").alias(key), F.col("drop").alias(gone)), "lines-lost")
    out = attach(docs, lost, key)
    every = lines(F.col("text"))
    mark = lambda x: _mark(x, least_chars)
    kept = F.when(F.col(gone).isNull(), every).otherwise(F.filter(every, lambda x: F.coalesce(~F.array_contains(F.col(gone), mark(x)), F.lit(True))))
    out = out.withColumn("n_lines", F.size(every).cast("long")).withColumn(left, kept)
    return out.withColumn("n_dropped", F.col("n_lines") - F.size(left)).withColumn("kept_text", F.array_join(left, "\n")).drop(left, gone)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's lines before and after."""
    out = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.pos, o.key IS NOT NULL AND o.keeper <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
