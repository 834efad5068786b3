"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, units and names become typed placeholders; windows of template tokens of documents and benchmark items meet in a hash
join. A capitalised word that begins a sentence may be a name or not: both readings are indexed. Windows that have too few
other tokens to tell anything meet by their very tokens instead. Windows that agree and stand at one offset make an
alignment; those of neighbouring offsets are chained, as words may be put in or left out. An alignment's slots must be
filled consistently: one value of the item always became one value of the document. So questions with other numbers or
names are found, and texts that merely have numbers in the same places are not.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, fresh, hinted, let, pick, read, stash

WINDOW = 8
#: Of an item's windows, the share that must be found in one document.
COVERAGE = 0.6
#: Or, of its tokens, the share that such windows must cover: a changed word spoils eight windows, but is one token.
COVERED = 0.8
#: Offsets that differ by so many tokens at most are chained.
REACH = 8
#: A window with fewer tokens that are no placeholders (or than its tokens, if fewer) is indexed by its tokens as they are.
LITERALS = 4
#: Bits of the constant table of the windows' first pairs, at most.
MOST_BITS = 1 << 24
#: Units that become a placeholder. Fixed values.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l litre litres liter liters gallon gallons "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph kmh hz khz mhz ghz w kw mw v kv j kj cal kcal pa kpa k c f usd eur gbp dollar dollars euro euros cent cents percent"
).split()
NUMBER, UNIT, NAME, _MARK, _FIRST = "<n>", "<u>", "<p>", "\x01", "\x02"


def raw_tokens(text: Column) -> Column:
    """Lower-cased tokens of letters and numbers (with their decimal marks); capitalised words keep a mark: one amid a sentence, another elsewhere."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.contains(t, F.lit(_MARK)) | F.contains(t, F.lit(_FIRST)), F.translate(t, _MARK + _FIRST, "  ")).otherwise(t)
    # What is rare is looked for first, and single spaces, which part most words, stay as they are.
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;] )", _MARK)
    t = F.lower(F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}{_MARK}])", _FIRST))
    t = F.regexp_replace(t, rf"[^ \p{{L}}\p{{M}}\p{{N}}.,{_MARK}{_FIRST}]+|[.,](?:(?<!\p{{N}}[.,])|(?!\p{{N}}))", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


def plain(token: Column) -> Column:
    """A token without its mark."""
    return F.when(token < "\x03", F.substring(token, 2, 1 << 30)).otherwise(token)


def _kind(token: Column, names: bool) -> Column:
    """A token, or the placeholder for its type. Marks sort before all that a token can begin with."""
    word = token if names else plain(token)
    return F.when(token < ("\x03" if names else _FIRST), NAME).when((token >= "0") & (token < ":"), NUMBER).when(word.isin(UNITS), UNIT).otherwise(word)


def template(tokens: Column, names: bool = False) -> Column:
    """Each token, or the placeholder for its type; with names, words that begin a sentence are read as names too."""
    return F.transform(tokens, lambda x: _kind(x, names))


def windows(tokens: Column, width: int | list[int], kind=lambda x: x, begins=None) -> Column:
    """(h, at, pair): hash and place of each window of tokens, or of what ``kind`` makes of them, and the hash of its first two.

    width: one or several; tokens are hashed, and places looked at, once for all of them. begins: a predicate on pairs; windows of which
    it doesn't hold are left out before they are hashed.
    """
    widths = [width] if isinstance(width, int) else width

    def whole(h: Column) -> Column:
        def of(some: list[int], pair, first) -> Column:
            fits = lambda x, i: (begins(first(x, i)) if begins else F.lit(True)) & (i <= F.size(h) - min(some))
            places = F.array_compact(F.transform(h, lambda x, i: F.when(fits(x, i), i)))
            window = lambda i, w: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(w)]).alias("h"), i.alias("at"), pair(i).alias("pair"))
            if len(some) == 1:
                return F.transform(places, lambda i: window(i, some[0]))
            return let(places, lambda at: F.concat(*[F.transform(F.filter(at, lambda i: i <= F.size(h) - w), lambda i: window(i, w)) for w in some]))  # noqa: B023

        parts = [of([1], lambda i: F.get(h, i), lambda x, _: x)] if 1 in widths else []
        if wide := [w for w in widths if w > 1]:
            parts.append(of(wide, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)), lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(F.transform(tokens, lambda x: F.xxhash64(kind(x))), whole)


def _beginnings(mine: DataFrame):
    """A predicate that holds for all first pairs of the items' windows, and for few others: a constant table of bits.

    It has 2 MB at most, so with very many windows it holds for more of the others, which the join then leaves out.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (mine.count() * 16).bit_length()))
    place = F.pmod("pair", F.lit(bits))
    cells = mine.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(pair, {bits}) & 63 AS int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("word"))
    table = [0] * (bits >> 6)
    for r in cells.collect():  # as many as the table has cells at most, 262,144
        table[r["cell"]] = r["word"]
    held = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    return lambda p: F.getbit(F.get(held, F.shiftright(p.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1


def literal(tokens: Column) -> Column:
    """How many tokens are no placeholders."""
    return F.size(F.filter(tokens, lambda x: F.substring(x, 1, 1) != "<"))


def _covered(ats: Column, size: Column) -> Column:
    """How many tokens sorted windows of a size cover."""
    step = F.transform(ats, lambda at, i: F.when(i == 0, size).otherwise(F.least(size, at - F.get(ats, i - 1))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, literals: int = LITERALS) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, reparameterised) for each document and benchmark item that it contains.

    An item of up to ``width`` tokens is one window; those of up to twice as many, if at most a quarter are placeholders, have windows
    of half or three quarters of the width, so that one changed word leaves others. Items of numbers, units and names alone are found by their tokens as they are,
    if they have ``literals`` of them; shorter ones, null or empty texts and null ids match nothing. Repeated rows count once.
    Extra columns are ignored; empty tables give an empty result.
    """
    items = pick(items, "item_id", "text").where("item_id is not null").dropDuplicates(["item_id"]).select("item_id", raw_tokens(F.col("text")).alias("item"))
    items = items.withColumn("t", template(F.col("item"))).withColumn("named", template(F.col("item"), True)).where((literal(F.col("t")) > 0) | (F.size("t") >= literals))
    n = F.size("t")
    # short windows of items rich in numbers or names would tell nothing
    size = F.when((n > 2 * width) | (n > width) & (literal(F.col("t")) * 4 < n * 3), width)
    size = size.when(n > width + width // 2, max(1, width * 3 // 4)).when(n > width, max(1, width // 2)).otherwise(n)
    items = stash(items.withColumn("size", size), "bench-items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``width`` numbers
    docs = pick(docs, "doc_id", "text").where("doc_id is not null")
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_slots"), F.lit(False).alias("reparameterised")).limit(0)
    mine = None
    for size in sizes:
        own = items.where(F.col("size") == size)
        part = lambda c: F.slice(c, F.col("x.at") + 1, F.lit(size))  # noqa: B023, E731
        readings = [own.select("item_id", F.col(c).alias("r"), F.explode(windows(F.col(c), size)).alias("x")).withColumn("told", literal(part("r")) >= min(size, literals)) for c in ("t", "named")]
        both = [r.where("told").select("item_id", "x.h", "x.pair", F.col("x.at").alias("item_at"), "told", F.lit(k == 1).alias("names")) for k, r in enumerate(readings)]
        bare = F.explode(windows(F.transform("item", plain), size)).alias("x")
        # by their tokens: windows that neither reading tells
        rest = readings[0].where("not told").select("item_id", F.col("x.at").alias("item_at"))
        rest = own.select("item_id", bare).select("item_id", "x.h", "x.pair", F.col("x.at").alias("item_at")).join(rest, ["item_id", "item_at"])
        both = both[0].unionByName(both[1]).unionByName(rest.select("item_id", "h", "pair", "item_at", F.lit(False).alias("told"), F.lit(False).alias("names"))).withColumn("size", F.lit(size))
        mine = both if mine is None else mine.unionByName(both)
    mine = stash(mine.groupBy("item_id", "h", "pair", "item_at", "told", "size").agg(F.min("names").alias("names")), "bench-windows")
    index = mine.select("item_id", "item_at", "told")
    kinds = [lambda x: _kind(x, False), lambda x: _kind(x, True), *([plain] if not mine.where("not told").isEmpty() else [])]
    # Texts are tokenised once for all sizes and readings.
    begins = _beginnings(mine)
    theirs = docs.select("doc_id", F.explode(let(raw_tokens(F.col("text")), lambda r: F.concat(*[windows(r, sizes, k, begins) for k in kinds]))).alias("x"))
    theirs = theirs.select("doc_id", "x.h", "x.pair", "x.at")
    found = theirs.join(hinted(mine), ["h", "pair"]).select("doc_id", "item_id", "at", "item_at", "told", "names")
    told = index.where("told").groupBy("item_id").agg(F.array_sort(F.collect_set("item_at")).alias("told_at"))
    counts = items.join(told, "item_id", "left").select("item_id", "size", F.size("t").alias("tokens"), (F.size("t") - F.col("size") + 1).alias("windows"), F.coalesce("told_at", F.array().cast("array<int>")).alias("told_at"))
    counts = counts.withColumn("told_tokens", _covered(F.col("told_at"), F.col("size")))
    counts = stash(counts.select("item_id", "size", "tokens", "windows", F.size("told_at").alias("told_windows"), "told_tokens"), "bench-counts")

    def enough(x: Column) -> Column:
        """Whether windows (at, told) are enough of the item, or, where templates tell most of it, enough of these."""
        at = lambda some: F.array_sort(F.array_distinct(F.transform(some, lambda w: w["at"])))
        share = lambda ats, n, tokens: (F.size(ats) >= F.col(n) * coverage) | (_covered(ats, F.col("size")) >= F.col(tokens) * COVERED)
        part = let(at(F.filter(x, lambda w: w["told"])), lambda ats: (F.size(ats) > 0) & share(ats, "told_windows", "told_tokens"))
        return let(at(x), lambda ats: share(ats, "windows", "tokens")) | (F.col("told_tokens") >= F.col("tokens") * coverage) & part

    aligned = found.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set(F.struct(F.col("item_at").alias("at"), "told", "names")).alias("own"))
    # Of each alignment, those at neighbouring offsets
    near = Window.partitionBy("doc_id", "item_id").orderBy("shift").rangeBetween(-REACH, REACH)
    aligned = aligned.withColumn("near", F.collect_list(F.struct("shift", "own")).over(near)).join(hinted(counts), "item_id")
    aligned = aligned.where(enough(F.flatten(F.transform("near", lambda x: x["own"]))))
    aligned = stash(aligned, "bench-aligned")
    holders = stash(aligned.groupBy(F.col("doc_id").alias("side_id")).agg(F.lit(True).alias("held")), "bench-holders")
    texts = attach(docs, holders).where("held").select("doc_id", raw_tokens(F.col("text")).alias("doc"))
    texts = texts.withColumn("doc_t", template(F.col("doc"))).withColumn("doc_named", template(F.col("doc"), True))
    alone = F.array(F.struct("shift", "own"))
    # An alignment alone, and with its neighbours, which fill what it leaves, the nearest first; each without and with the reading as names
    nearest = F.transform(F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x["shift"] - F.col("shift")).alias("far"), x["shift"].alias("shift"), x["own"].alias("own")))), lambda x: F.struct(x["shift"].alias("shift"), x["own"].alias("own")))
    strict = lambda runs: F.transform(runs, lambda x: F.struct(x["shift"].alias("shift"), F.filter(x["own"], lambda w: ~w["names"]).alias("own")))
    way = lambda runs, names: F.struct(F.lit(names).alias("names"), (runs if names else strict(runs)).alias("runs"))
    # Alignments grow with the documents, and a file of them is under a hundredth of what they take in memory: by its size Spark would broadcast them.
    both = aligned.join(texts.hint("merge"), "doc_id")
    both = both.withColumn("way", F.explode(F.array(*[way(runs, names) for runs in (alone, nearest) for names in (False, True)])))
    both = both.withColumn("chain", F.col("way.runs")).withColumn("used", F.flatten(F.transform("chain", lambda x: x["own"]))).where(enough(F.col("used"))).drop("near", "own")
    both = both.join(hinted(items.select("item_id", "item", "t", "named")), "item_id")
    both = both.withColumn("t", F.when(F.col("way.names"), F.col("named")).otherwise(F.col("t"))).withColumn("doc_t", F.when(F.col("way.names"), F.col("doc_named")).otherwise(F.col("doc_t")))
    holds = lambda x, i: F.exists(x["own"], lambda w: (w["at"] <= i) & (i < w["at"] + F.col("size")))
    places = F.transform(F.sequence(F.lit(0), F.col("tokens") - 1), lambda i: F.struct(i.alias("i"), F.get(F.filter("chain", lambda x: holds(x, i)), 0)["shift"].alias("shift")))
    both = both.withColumn("places", F.filter(places, lambda p: (F.substring(F.get("t", p["i"]), 1, 1) == "<") & (F.get("t", p["i"]) == F.get("doc_t", p["i"] + p["shift"]))))
    both = both.withColumn("slots", F.array_distinct(F.transform("places", lambda p: F.struct(plain(F.get("item", p["i"])).alias("a"), plain(F.get("doc", p["i"] + p["shift"])).alias("b")))))
    both = both.where(F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["a"]))))
    other = F.exists("slots", lambda s: s["a"] != s["b"])
    n = F.size(F.array_distinct(F.transform("used", lambda w: w["at"]))).cast("long")
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct(n.alias("n"), (~other).alias("same"), F.size("slots").cast("long").alias("n_slots"), "windows")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n").alias("n_windows"), (F.col("x.n") / F.col("x.windows")).alias("coverage"), "x.n_slots", (~F.col("x.same")).alias("reparameterised"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that contain no benchmark item, with the columns of docs. Rows without a doc_id stay."""
    own = fresh("own_id", docs)
    gone = stash(hits(docs, items, **how).select(F.col("doc_id").alias(own)).distinct(), "bench-gone")
    return docs.join(hinted(gone), docs["doc_id"] == F.col(own), "left_anti")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
