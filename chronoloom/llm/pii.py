"""Personal data: fixed forms, and more identifiers by bootstrapped contexts, with DataFrame functions alone.

The forms' matches are seeds: the four kinds of the contract, and secrets, which are long hexadecimal strings. What stands before a
seed is a lexical pattern: the word before, with the one before that if it is punctuation (``token =``), or the key joined to
it (``tel=``). A pattern's score for a kind is its known identifiers of that kind against what can be none: all its occurrences in
the corpus before plain words, before known ones of other kinds, before values that a form fits but not its check, and before
values of a shape (kinds of characters, and length by powers of two) that no known one of the kind has. An unseen value of such a
shape says nothing: it may be what is sought. An identifier's score is one minus the product of its patterns' doubts. Round by
round, confident patterns make unseen identifiers known, and these induce patterns in turn, till a round finds nothing new.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, drop, hinted, let, pick, read, stash, words

#: The kinds that the fixed forms must give, and all kinds of spans.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The forms, so written that a failed start isn't tried again from within the same run and no group recurses.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
}
#: White-space separated tokens that have a digit or an at sign: what may be an identifier.
TOKEN = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
#: Tokens of digits in a row, which may be one identifier together.
_PART = rf"[0-9(+][0-9()+/.-]*+(?![^{WS},;:!?])"
RUN = rf"(?<![^{WS}]){_PART}(?: {_PART})++"
_KEY = r"^[^A-Za-z]?([A-Za-z][A-Za-z_-]*[=:])[^A-Za-z0-9+]*+(?=.)"
_LETTERS = r"[\p{L}\p{N}]"
#: A pattern needs this score and so many different known identifiers; an identifier needs the score too.
LEAST_SCORE, LEAST_SUPPORT = 0.5, 3
#: Occurrences against each pattern that are assumed before any is seen, so that little support gives a lower score.
DOUBT = 1


def running(values: Column, op) -> Column:
    """Running results of an associative op over an array of ints, in blocks: n steps cost the order of n times its root, not its square."""
    none = F.array().cast("array<int>")
    last = lambda a: F.get(a, F.size(a) - 1)
    scan = lambda v: F.aggregate(v, none, lambda a, x: F.concat(a, F.array(F.coalesce(op(last(a), x), x))))
    ahead = lambda blocks, ends: F.flatten(F.transform(blocks, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda x: op(F.get(ends, i - 1), x)))))
    cut = lambda v, b: F.transform(F.sequence(F.lit(0), F.size(v) - 1, b), lambda s: scan(F.slice(v, s + 1, b)))
    whole = lambda v: let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda b: let(cut(v, b), lambda c: let(scan(F.transform(c, last)), lambda ends: ahead(c, ends))))
    return let(values, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) <= 16, scan(v)).otherwise(whole(v)))


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    worth = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when((n - i) % 2 == 1, F.when(worth(i) > 4, worth(i) * 2 - 9).otherwise(worth(i) * 2)).otherwise(worth(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _right(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.char_length(part(x)) < 3) | (F.char_length(part(x)) == 3) & (part(x) <= "255"))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(10, 15)


def found(text: Column, form: str) -> Column:
    """Matches as (at, to, m, gap), in code points: the text is cut at the matches, so lengths add up to places."""
    none = F.array().cast("array<struct<at:int,to:int,m:string,gap:string>>")
    both = F.struct(F.split(text, form, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("ms"))

    def placed(z: Column) -> Column:
        pairs = F.zip_with(F.slice(z["gaps"], 1, F.size(z["ms"])), z["ms"], lambda g, m: F.struct(g.alias("gap"), m.alias("m"), F.char_length(m).alias("n")))
        ends = lambda p: running(F.transform(p, lambda x: F.char_length(x["gap"]) + x["n"]), lambda a, x: a + x)
        return let(pairs, lambda p: F.zip_with(p, ends(p), lambda x, to: F.struct((to - x["n"]).alias("at"), to.alias("to"), x["m"].alias("m"), x["gap"].alias("gap"))))

    return let(both, lambda z: F.when(F.size(z["ms"]) == 0, none).otherwise(placed(z)))


_SPAN, _MATCH = "array<struct<at:int,kind:int,to:int>>", "array<struct<at:int,kind:int,to:int,m:string>>"


def form_spans(text: Column) -> Column:
    """(at, kind's number, to, m) of the fixed forms' matches, by place, then kind."""
    marks = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "card": F.rlike(text, F.lit("[0-9][ -]?[0-9]")), "phone": F.contains(text, F.lit("+")), "secret": F.rlike(text, F.lit("[0-9A-Fa-f]{32}"))}
    none = F.array().cast(_MATCH)

    def of(k: int, kind: str) -> Column:
        right = F.filter(found(text, FORMS[kind]), lambda x: _right(kind, x["m"]))
        return F.when(marks[kind], F.transform(right, lambda x: F.struct(x["at"].alias("at"), F.lit(k).alias("kind"), x["to"].alias("to"), x["m"].alias("m")))).otherwise(none)

    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def base_spans(spans: Column) -> Column:
    """Those of the contract's four kinds."""
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def joined(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["at"].cast("string"), s["to"].cast("string"))), ",")


def _beside(xs: Column, spans: Column) -> Column:
    """For each of xs, in order: (before: whether a span that starts earlier reaches into it, head: the first span that starts in it)."""
    mine = F.transform(xs, lambda x, i: F.struct(x["at"].alias("at"), F.lit(0).alias("s"), F.lit(-1).alias("kind"), x["to"].alias("to"), F.lit(None).cast("string").alias("m")))
    theirs = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), F.lit(1).alias("s"), s["kind"].alias("kind"), s["to"].alias("to"), s["m"].alias("m")))

    def merged(both: Column) -> Column:
        after = lambda j: F.get(both, j + 1)
        head = lambda e, j: F.when((after(j)["s"] == 1) & (after(j)["at"] < e["to"]), after(j))
        one = lambda reach: F.transform(both, lambda e, j: F.when(e["s"] == 0, F.struct((F.get(reach, j) > e["at"]).alias("before"), head(e, j).alias("head"))))
        return F.filter(let(running(F.transform(both, lambda e: F.when(e["s"] == 1, e["to"]).otherwise(-1)), F.greatest), one), lambda x: x.isNotNull())

    return let(F.sort_array(F.concat(mine, theirs)), merged)


def instances(text: Column, spans: Column) -> Column:
    """Possible identifiers as (at, run, to, ctx, value, kind, mate), by place: kind is a known one's number, null for one that no form fits.

    Tokens, and runs of digit tokens as a whole (run 1); mate is the run that begins where a token does. ctx is what stands
    before: the key, or the word before, whatever it holds; empty at a text's start.
    """
    stripped = lambda x: F.regexp_replace(x, r"^[^\p{L}0-9+]+", "")

    def one(x: Column, before: Column, beside: Column, run: int) -> Column:
        key = F.lit("") if run else F.regexp_extract(x["m"], _KEY, 0)
        name = F.lit("") if run else F.regexp_extract(x["m"], _KEY, 1)
        body = F.substr(x["m"], F.char_length(key) + 1)
        own = F.regexp_replace(stripped(body), r"[^\p{L}0-9]+$", "")
        at = x["at"] + F.char_length(key) + F.char_length(body) - F.char_length(stripped(body))
        head = beside["head"] if not run else F.lit(None).cast("struct<at:int,s:int,kind:int,to:int,m:string>")
        # a known one's value is what its form matched, which may be several tokens
        value = F.coalesce(head["m"], own)
        use = (value != "") & (head.isNotNull() | ~beside["before"] & beside["head"].isNull())
        return F.when(use, F.struct(at.alias("at"), F.lit(run).alias("run"), (at + F.char_length(value)).alias("to"), F.lower(F.when(name != "", name).otherwise(before)).alias("ctx"), value.alias("value"), head["kind"].alias("kind")))

    def context(xs: Column, x: Column, i: Column) -> Column:
        """The word before; with the one before that, if it has no letter or digit."""
        earlier = F.coalesce(F.when(i > 0, F.get(xs, i - 1)["m"]), F.lit(""))
        last, other = (F.regexp_extract(x["gap"], rf"(?:([^{WS}]+)[{WS}]+)?([^{WS}]+)[{WS}]+$", k) for k in (2, 1))
        other = F.when(other != "", other).otherwise(earlier)
        return F.when(last == "", earlier).when(last.rlike(_LETTERS) | (other == ""), last).otherwise(F.concat(other, F.lit(" "), last))

    all_of = lambda form, run: let(found(text, form), lambda xs: let(_beside(xs, spans), lambda b: F.transform(xs, lambda x, i: one(x, context(xs, x, i), F.get(b, i), run))))
    both = F.sort_array(F.filter(F.concat(all_of(TOKEN, 0), F.when(F.rlike(text, F.lit(r"[0-9(+] [0-9(+]|[0-9)/.-] [0-9(+]")), all_of(RUN, 1)).otherwise(F.array())), lambda x: x.isNotNull()))
    mate = lambda xs, x, i: F.when((x["run"] == 0) & (F.get(xs, i + 1)["at"] == x["at"]), F.get(xs, i + 1)["value"])
    return let(both, lambda xs: F.transform(xs, lambda x, i: F.struct(x["at"].alias("at"), x["run"].alias("run"), x["to"].alias("to"), x["ctx"].alias("ctx"), x["value"].alias("value"), x["kind"].alias("kind"), mate(xs, x, i).alias("mate"))))


def contexts(text: Column) -> Column:
    """The context that each word of a text makes for what follows, or, with a key joined to it, for itself."""

    def of(ws: Column, w: Column, i: Column) -> Column:
        keyed = F.when(F.contains(w, F.lit("=")) | F.contains(w, F.lit(":")), F.regexp_extract(w, _KEY, 1)).otherwise("")
        return F.lower(F.when(keyed != "", keyed).when((i > 0) & ~w.rlike(_LETTERS), F.concat(F.get(ws, i - 1), F.lit(" "), w)).otherwise(w))

    return let(words(text), lambda ws: F.transform(ws, lambda w, i: of(ws, w, i)))


def shape(value: Column) -> Column:
    """Which kinds of characters a value has (letters, digits, others, as bits) and how long it is, by powers of two: 8 numbers for each length."""
    has = lambda form, bit: F.when(value.rlike(form), bit).otherwise(0)
    return has(r"\p{L}", 1) + has("[0-9]", 2) + has(r"[^\p{L}0-9]", 4) + 8 * F.floor(F.log2(F.greatest(F.char_length(value), F.lit(1)))).cast("int")


def failed(value: Column) -> Column:
    """The numbers of the kinds whose form a value has as a whole without passing its check."""
    checked = ("ip", "card", "phone", "secret")
    return F.array_compact(F.array(*[F.when(value.rlike(f"^(?:{FORMS[kind]})$") & ~_right(kind, value), KINDS.index(kind)) for kind in checked]))


def discover(things: DataFrame, docs: DataFrame, score: float = LEAST_SCORE, support: int = LEAST_SUPPORT, rounds: int | None = None) -> DataFrame:
    """(value, kind) of the known identifiers and of those that confident patterns reveal.

    things: (ctx, value, kind[, mate]), one row for each place; a mate is a longer value at the same place. docs: the texts in which
    contexts are counted. Rounds go on till one finds nothing new, or as many as given. A value that has a kind's form but fails
    its check is never that kind. Null and empty contexts make no pattern; without known identifiers nothing is found.
    """
    things = things if "mate" in things.columns else things.withColumn("mate", F.lit(None).cast("string"))
    graph = stash(things.groupBy("ctx", "value", "mate").agg(F.count("*").alias("n"), F.min("kind").alias("kind")), "pii-graph")
    # Only contexts of several values can become patterns; how often these occur is counted in all texts.
    each = graph.where("ctx <> ''").select("ctx", F.explode(F.array("value", "mate")).alias("value")).where("value is not null")
    asked = hinted(stash(each.groupBy("ctx").agg(F.count_distinct("value").alias("d")).where(F.col("d") >= support).select("ctx"), "pii-contexts"))
    said = docs.select(F.explode(contexts(F.col("text"))).alias("ctx"))
    totals = said.join(asked, "ctx").groupBy("ctx").agg(F.count("*").alias("total"))
    held = graph.join(asked, "ctx").groupBy("ctx").agg(F.sum("n").alias("held"))
    totals = stash(totals.join(held, "ctx").select("ctx", F.greatest(F.col("total") - F.col("held"), F.lit(0)).alias("plain")), "pii-totals")
    graph = graph.join(hinted(totals), "ctx", "left").withColumn("shape", shape(F.col("value"))).withColumn("mate_shape", shape(F.col("mate"))).withColumn("failed", failed(F.col("value")))
    graph = stash(graph, "pii-counted")
    fresh = graph.where("kind is null and plain is not null").select("ctx", F.explode(F.array("value", "mate")).alias("value")).where("value is not null")
    fresh = stash(fresh.select("ctx", "value", failed(F.col("value")).alias("failed")).distinct(), "pii-fresh")
    known = stash(graph.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")), "pii-known")
    for _ in count() if rounds is None else range(rounds):
        own = hinted(known)
        said = graph.where("plain is not null").join(own.withColumnRenamed("kind", "k"), "value", "left")
        said = said.join(own.select(F.col("value").alias("mate"), F.col("kind").alias("m")), "mate", "left").withColumn("is", F.coalesce("kind", "m", "k"))
        said = stash(said.withColumn("as", F.when(F.col("m").isNotNull(), F.col("mate")).otherwise(F.col("value"))), "pii-said")
        patterns = said.where("is is not null").groupBy("ctx", F.col("is").alias("kind")).agg(F.sum("n").alias("hits"), F.count_distinct("as").alias("different"), F.first("plain").alias("plain"))
        patterns = stash(patterns.where(F.col("different") >= support).drop("different"), "pii-patterns")
        # of the other occurrences, a row for each context, kind and shape
        rest = said.groupBy("ctx", "is", F.when(F.col("is").isNull(), F.struct("shape", "mate_shape", "failed")).alias("look")).agg(F.sum("n").alias("n"))
        rest = hinted(patterns).select("ctx", "kind").join(rest, "ctx").where(F.col("is").isNull() | (F.col("is") != F.col("kind")))
        looks = own.groupBy("kind").agg(F.collect_set(shape(F.col("value"))).alias("looks"))  # a row for each kind, 8 numbers for each power of two
        rest = rest.join(F.broadcast(looks), "kind")
        alike = (F.array_contains("looks", F.col("look.shape")) & ~F.array_contains("look.failed", F.col("kind"))) | F.coalesce(F.array_contains("looks", F.col("look.mate_shape")), F.lit(False))
        rest = rest.groupBy("ctx", "kind").agg(F.sum(F.when(F.col("is").isNull() & alike, 0).otherwise(F.col("n"))).alias("against"))
        patterns = patterns.join(rest, ["ctx", "kind"], "left")
        patterns = patterns.select("ctx", "kind", (F.col("hits") / (F.col("hits") + F.col("plain") + F.coalesce("against", F.lit(0)) + DOUBT)).alias("score")).where(F.col("score") >= score)
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        new = fresh.join(patterns, "ctx").where(~F.array_contains("failed", F.col("kind"))).groupBy("value", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= score)
        new = new.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")).join(own, "value", "left_anti")
        new = stash(new, "pii-new")
        drop(said)
        if new.isEmpty():
            break
        known = stash(known.unionByName(new), "pii-known")
    return known


def spans(docs: DataFrame, score: float = LEAST_SCORE, support: int = LEAST_SUPPORT, rounds: int | None = None) -> DataFrame:
    """(doc_id, base, all) for each row: arrays of (at, kind, to), in code points, end exclusive, by place and kind.

    base has the four kinds of the fixed forms; all has secrets and discovered identifiers too. Null or empty text has none.
    Rows without a doc_id get the fixed forms alone; repeated rows are alike. Extra columns are ignored; an empty table gives an
    empty one. The work on a text grows little faster than its length.
    """
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = docs.withColumn("seeds", form_spans(F.col("text")))
    seen = seen.select("doc_id", "seeds", instances(F.col("text"), F.col("seeds")).alias("things"))
    seen = stash(seen, "pii-seen")
    things = seen.select("doc_id", F.explode("things").alias("x")).select("doc_id", "x.*")
    known = hinted(discover(things.where("run = 0"), docs, score, support, rounds))
    # A value that a form fits is no discovery where the form fits it; elsewhere, its new spans are.
    more = things.where("kind is null and doc_id is not null").drop("kind").join(known, "value").groupBy("doc_id").agg(F.collect_set(F.struct("at", (-F.col("to")).alias("end"), "kind")).alias("more"))
    # the parts of a run that is known as a whole are no spans of their own: by place, the longest first, nothing before one may reach its end
    reach = lambda xs: running(F.transform(xs, lambda s: -s["end"]), F.greatest)
    alone = lambda xs: let(reach(xs), lambda r: F.filter(xs, lambda s, i: (i == 0) | (F.get(r, i - 1) < -s["end"])))
    more = more.withColumn("more", F.transform(let(F.sort_array("more"), alone), lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), (-s["end"]).alias("to"))))
    more = stash(more.withColumnRenamed("doc_id", "side_id"), "pii-more")
    out = seen.drop("things").join(hinted(more), F.col("doc_id") == F.col("side_id"), "left")
    seeds = F.transform("seeds", lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), s["to"].alias("to")))
    return out.select("doc_id", base_spans(seeds).alias("base"), F.sort_array(F.concat(seeds, F.coalesce("more", F.array().cast(_SPAN)))).alias("all"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and spans; n_spans counts all of them. Of the kinds in spans, ``secret`` is added to the contract's four."""
    out = spans(read(spark, sf_dir, "documents"))
    number = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    counts = [number("base", k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), number("all", len(BASE)).alias("n_secret"), F.size("all").cast("long").alias("n_spans"))
