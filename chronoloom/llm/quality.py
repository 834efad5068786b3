"""Quality rules with DataFrame functions alone: counts of symptoms, and importance weights from hashed n-grams.

Words and word pairs fall into hash buckets. A target multinomial from trusted texts and a raw one from the whole corpus give
each bucket a log-likelihood ratio; a document's verdict is the mean over its n-grams against a fixed threshold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, let, pick, read, words

BUCKETS = 10_000
#: Trusted documents that the target is taken from: at most so many labelled rows, those of the smallest hash of doc_id.
TRUSTED_ROWS = 200_000
#: A document passes if its n-grams are on average at least this likely under the target, against the corpus (natural log).
THRESHOLD = -0.04
#: How many n-grams of the corpus stand in the target beside its own: with few trusted texts, what these lack says little.
PRIOR = 100_000
_POS = (1 << 21) - 1


def features(hashes: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a document's words and pairs of neighbours, repeats included, from its words' hashes."""


    def both(hs: Column) -> Column:
        one = F.transform(hs, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
        pairs = F.transform(F.slice(hs, 1, F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hs, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, pairs)

    return let(hashes, both)


def hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, most: int = TRUSTED_ROWS) -> list[float]:
    """Each bucket's log-likelihood ratio; the corpus, add-one smoothed, is the target's prior. trusted: doc_id of texts that are known to be good.

    The corpus counts are over all of docs. Without trusted documents or without words, all ratios are 0.
    """
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)
    docs = pick(docs, "doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = docs.select(F.col("trusted_id").isNotNull().alias("good"), hashed(words(F.lower("text"))).alias("h")).select("good", F.explode(features(F.col("h"), buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum(F.col("good").cast("long")).alias("target")).collect()  # a row for each bucket at most
    raw, target = [1] * buckets, [0] * buckets
    for r in rows:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    total, corpus = sum(target), sum(raw)
    if not total:
        return [0.0] * buckets
    return [math.log((t + PRIOR * r / corpus) / (total + PRIOR) / (r / corpus)) for t, r in zip(target, raw, strict=True)]


def table(values: list[float]) -> Column:
    """A constant array, which is folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def judged(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score and kept.

    Columns of these names are replaced. Null text counts as empty: no words, base_failed, score null, not kept.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*names)
    w_, h_, t_, c_, p_, l_, f_ = (fresh(x, docs) for x in ("_w", "_h", "_t", "_c", "_p", "_l", "_f"))
    out = docs
    text = F.coalesce("text", F.lit(""))
    out = out.withColumn(w_, words(F.col("text"))).withColumn(h_, hashed(F.col(w_)))
    w, h, n = F.col(w_), F.col(h_), F.size(w_)
    packed = F.transform(F.slice(h, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long")))
    out = out.withColumn(t_, F.sort_array(packed))
    t = F.col(t_)
    same = lambda x, y: F.coalesce(F.shiftright(x.bitwiseXOR(y), 21) == 0, F.lit(False))
    out = out.withColumn(c_, F.filter(t, lambda x, i: same(x, F.get(t, i + 1)) | same(x, F.get(t, i - 1))))
    c = F.col(c_)
    at = lambda x: x.bitwiseAND(F.lit(_POS)).cast("int")
    word = lambda x, k: F.get(w, at(x) + k)
    clash = lambda x, y: same(x, y) & ((word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2)))
    doubt = (n > _POS) | F.exists(F.transform(c, lambda x, i: F.coalesce(clash(x, F.get(c, i + 1)), F.lit(False))), lambda x: x)
    exact = F.array_sort(F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    slow = let(exact, lambda e: F.transform(F.filter(e, lambda x, i: alike(x, F.get(e, i + 1)) | alike(x, F.get(e, i - 1))), lambda x: x["i"]))
    out = out.withColumn(p_, F.sort_array(F.when(doubt, slow).otherwise(F.transform(c, at))))
    p = F.col(p_)
    # Windows were sorted as (43 bits of hash, place) in one long; neighbours of one hash were compared as words, and should two
    # different windows share the bits (or the text have over 2**21 words), windows are sorted as words instead.
    # A repeated window covers three words, fewer if the next repeated one starts among them.
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn(l_, F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    out = out.withColumn(f_, features(hashed(words(F.lower("text"))), len(ratios)))
    ratio = table(ratios)
    score = F.aggregate(f_, F.lit(0.0), lambda a, b: a + F.get(ratio, b)) / F.nullif(F.size(f_), F.lit(0))
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, f"[{WS}]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(l_) - F.size(F.array_distinct(l_))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        score.alias("score"),
    )
    # A generator's output: a filter on the verdict isn't pushed below it, where all of the above would be worked out again.
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(found)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = read(spark, sf_dir, "documents")
    out = judged(docs.select("doc_id", "text"), fit(docs, trusted(read(spark, sf_dir, "labels"))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
