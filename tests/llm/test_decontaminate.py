"""Items rich in numbers, planted copies with other numbers and names, and items with a word put in, left out or changed, or with names that begin sentences."""

import random
import re

from pyspark.sql import functions as F

from chronoloom.llm import decontaminate

DOCS = "doc_id long, text string"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.hits(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_items_of_numbers(spark):
    items = ["What is 12 * 7 + 3?", "Find the next number: 2, 4, 8, 16, 32, 64, 128, 256.", "Add 3 km, 5 km, 7 km and 9 km, then give the sum in miles."]
    texts = [f"some words before it {x} and more after it" for x in items]
    texts += ["What is 13 * 8 + 4?", "Find the next number: 1, 3, 9, 27, 81, 243, 729, 2187.", "so Add 4 km, 6 km, 8 km and 11 km, then give the sum in miles. yes", "a list 2, 4, 8, 16, 32, 64, 128, 256 of powers"]
    assert found(spark, texts, items) == {(0, 0): False, (1, 1): False, (2, 2): False, (4, 1): True, (5, 2): True}


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega red green blue white black brown grey pink".split()


def test_changed_words(spark):
    long, short = " ".join(WORDS), " ".join(WORDS[:20])
    put_in = " ".join([*WORDS[:16], "new", *WORDS[16:]])
    left_out = " ".join([*WORDS[:16], *WORDS[17:]])
    changed = " ".join([*WORDS[:10], "new", *WORDS[11:20]])
    got = found(spark, [f"x y {t} z" for t in (put_in, left_out, changed)] + [" ".join(WORDS[:10]), " ".join(WORDS[10:20] + WORDS[:10])], [long, short])
    assert {(0, 0), (1, 0), (2, 1)} <= set(got) and not {d for d, _ in got} & {3, 4}


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Maria has 12 apples. Peter gives Tom 3 apples. How many apples does Tom have now?"
    other = item.replace("Tom", "Omar").replace("Maria", "Helena").replace("Peter", "Ines").replace("12", "14")
    mixed = other.replace("gives Omar", "gives Luis")  # one name of the item became two
    assert found(spark, [f"It was so. {other}", mixed, f"It was so. {item}"], [item]) == {(0, 0): True, (2, 0): False}


def test_items_of_placeholders_alone(spark):
    """They are found by their tokens; a single number, or a few names, tells nothing."""
    items = ["12 + 7 - 3 * 45 / 9 = ?", "12", "Maria and", "3 km 4 km 5"]
    texts = ["so 12 + 7 - 3 * 45 / 9 = ? it was", "so 13 + 8 - 4 * 45 / 9 it was", "12 of Maria", "about 3 km, 4 km, 5 or so"]
    assert found(spark, texts, items) == {(0, 0): False, (3, 3): False}


def test_one_changed_word_in_short_items(spark):
    items = [" ".join(WORDS[i : i + n]) for i, n in ((0, 9), (4, 10), (8, 12), (12, 14), (14, 16))]
    texts = []
    for item in items:
        ws = item.split()
        texts.append(" ".join(["before", *ws[: len(ws) // 2], "town", *ws[len(ws) // 2 + 1 :], "after"]))
        texts.append(" ".join(ws[: len(ws) // 2]))
    got = found(spark, texts, items)
    assert {(2 * i, i) for i in range(len(items))} <= set(got) and not {d for d, _ in got} & {1, 3, 5, 7, 9}


def test_planted_copies(spark):
    """300 items, each in a text as it is and in one with other numbers and names; texts that mix up the names or only share numbers."""
    rng = random.Random(3)
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
    word = lambda: "".join(rng.choices(syllables, k=3))
    name = lambda: word().capitalize()
    prose = lambda n: " ".join(word() for _ in range(n))
    items, texts, same, other = [], [], set(), set()
    for i in range(300):
        form = "so {a} had {x} " + prose(5) + " and {b} gave {y} km of " + prose(rng.randrange(2, 14)) + " to {a} so how many " + prose(rng.randrange(2, 8)) + " has {a} now"
        fill = lambda: form.format(a=name(), b=name(), x=rng.randrange(2, 999), y=rng.randrange(1000, 9999))  # noqa: B023, E731
        items.append(fill())
        same.add((len(texts), i))
        texts.append(f"{prose(40)} {items[-1]} {prose(20)}")
        other.add((len(texts), i))
        texts.append(f"{prose(10)} {fill()} {prose(60)}")
        texts.append(f"{prose(10)} {' '.join(re.findall('[0-9]+|[A-Z][a-z]+', items[-1]))} {prose(9)}")
    got = found(spark, texts, items)
    assert same <= set(got) and not any(got[x] for x in same)
    assert len(other & set(got)) >= 0.9 * len(other) and all(got[x] for x in other & set(got))
    assert not set(got) - same - other


def test_windows_of_several_widths(spark):
    """Those of each width, worked out together."""
    df = spark.createDataFrame([(list("abcdabcx"),), (["a", "b"],), (["a"],), ([],)], "t array<string>")
    some = lambda p: p % 2 == 0
    for begins in (None, some):
        widths = [1, 2, 3, 8]
        both = df.select(decontaminate.windows(F.col("t"), widths, begins=begins).alias("x"), F.concat(*[decontaminate.windows(F.col("t"), w, begins=begins) for w in widths]).alias("y")).collect()
        assert [sorted(r["x"]) for r in both] == [sorted(r["y"]) for r in both] and len(both[0]["x"]) > 3 and both[3]["x"] == []


def broadcasts(plan):
    """Bytes of each table that a plan has broadcast."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return broadcasts(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return broadcasts(plan.plan())
    own = [plan.metrics().get("dataSize").get().value()] if plan.nodeName().startswith("BroadcastExchange") else []
    return own + [x for i in range(plan.children().size()) for x in broadcasts(plan.children().apply(i))]


def test_alignments_are_not_broadcast(spark):
    """Only the ids of documents that hold items are, some ten bytes each; an alignment takes thousands."""
    items = spark.createDataFrame([(0, " ".join(WORDS * 2))], "item_id long, text string")
    most = []
    for n in (10, 300):
        out = decontaminate.hits(spark.createDataFrame([(i, f"some {' '.join(WORDS * 2)} more") for i in range(n)], DOCS), items)
        assert len(out.collect()) == n
        most.append(max(broadcasts(out._jdf.queryExecution().executedPlan())))
    assert most[1] - most[0] < 300 * 100
