"""Templates, bootstrapped patterns, the shard store, the pipeline, and odd tables for every operator."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import common, decontaminate, licenses, linededup, packing, pii, quality, sharding, simhash, substring, urlfilter
from chronoloom.llm.queries import ORACLES, QUERIES

from . import brute
from .test_near import classes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def frame(spark, texts, name="doc_id"):
    return spark.createDataFrame(list(enumerate(texts)), f"{name} long, text string")


ITEM = "Yesterday Maria bought 12 apples and 7 pears at the market. How many pieces of fruit did Maria carry home after she gave 3 kg of apples to Peter?"


def test_reparameterised_questions(spark):
    other = ITEM.replace("12", "25").replace("7", "9").replace("Maria", "Helena").replace("3 kg", "4 lb").replace("Peter", "Omar")
    mixed = ITEM.replace("bought 12", "bought 25").replace("did Maria", "did Helena")  # one name of the item became two
    texts = [f"Some words before. {ITEM} And after.", f"so it was that\n{other.lower().replace('helena', 'Helena').replace('omar', 'Omar')} then", mixed, ITEM[:40], "numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", None, ""]
    items = frame(spark, [ITEM, "1 2 3 4 5 6 7 8 9 10 11", "Short one", None, ""], "item_id")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.hits(frame(spark, texts), items).collect()}
    assert got == {(0, 0): False, (1, 0): True}
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame(spark, texts), items).collect()) == [2, 3, 4, 5, 6]


def test_decontamination_finds_whole_items(spark):
    docs, items = (common.read(spark, SF, t) for t in ("documents", "benchmark"))
    bench = {r["item_id"]: r["text"] for r in items.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in bench.items() if t in r["text"]}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.hits(docs, items).collect()}


def test_unseen_identifiers(spark):
    rng = random.Random(1)
    fill = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(8))
    texts = [f"{fill()} tel: +1 555 010 99{i:02d} {fill()}" for i in range(8)]
    texts += [f"{fill()} Tel: 0171/55{i}203, {fill()} room 12{i} {fill()}" for i in range(3)] + [f"phone=+44 20 7946 09{i:02d} {fill()}" for i in range(5)] + [f"é{fill()} phone=0800-1111"]
    got = {r["doc_id"]: (r["base"], r["all"]) for r in pii.spans(frame(spark, texts)).select("doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("all")).alias("all")).collect()}
    for d, t in enumerate(texts):
        assert got[d][0] == brute.op9(t)[-1]
        new = "0171/55" if "0171" in t else "0800-1111" if "0800" in t else None
        if new:
            assert f"phone:{t.index(new)}:" in got[d][1], (t, got[d])
        else:
            assert got[d][0] == got[d][1]


def test_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=20_000, least=1_000, fan_in=3)
    with pytest.raises(ValueError):
        store.rows()
    rows = [(i, None if i % 7 == 0 else f"text {i} " * (i % 50)) for i in range(400)] + [(None, ""), (5, "again"), (5, "again")]
    for i in range(0, len(rows), 50):
        store.append(spark.createDataFrame(rows[i : i + 50], DOCS).coalesce(1))
    store.append(spark.createDataFrame([], DOCS))
    before = store.manifest()
    after = store.compact()
    key = lambda rs: sorted((str(r["doc_id"]), str(r["text"])) for r in rs)
    want = sorted((str(a), str(b)) for a, b in rows)
    assert key(store.rows().collect()) == want == key(store.rows(before["version"]).collect())
    assert len(after["runs"]) < len(before["runs"]) and after["version"] > before["version"]
    sizes = defaultdict(int)
    for r in after["runs"]:
        sizes[store.tier(r)] += 1
    assert all(n < 3 for n in sizes.values())
    with pytest.raises(sharding.Conflict):
        store.commit(after["version"], [], None)
    store.append(spark.createDataFrame([(1, "x", 2.5)], f"{DOCS}, extra double"))
    assert store.rows().where("extra is not null").count() == 1
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("a",)], "doc_id string"))
    assert store.vacuum() > 0 and store.rows().count() == len(rows) + 1 and len(store.versions()) == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = frame(spark, ["one two three", None])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_first(docs).count() == 0
    assert substring.remove_repeats(docs).count() == 0 and linededup.drop_lines(docs).count() == 0
    ratios = quality.fit(docs, docs.select("doc_id"), buckets=10)
    assert ratios == [0.0] * 10 and quality.judged(docs, ratios).count() == 0
    assert decontaminate.hits(docs, items).count() == decontaminate.hits(some, items).count() == decontaminate.hits(docs, frame(spark, [ITEM], "item_id")).count() == 0
    assert decontaminate.clean(some, items).count() == 2
    assert pii.spans(docs).count() == 0 and licenses.scan(docs).count() == 0 and licenses.scan(some, {}).count() == 0
    assert packing.pack(docs, packing.vocabulary()).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_nulls_and_repeated_rows(spark):
    line = "a line that is long enough to be counted as one"
    rows = [(1, f"{line}\nx"), (1, f"{line}\nx"), (None, f"{line}\nx"), (None, None), (2, line), (3, line), (4, line), (5, line + " "), (6, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["doc_id"] is None} == {1, 6}
    assert sorted(str(r["doc_id"]) for r in simhash.keep_first(docs).collect()) == ["1", "2", "6", "None", "None"]
    lines = linededup.drop_lines(docs).collect()
    assert [r["n_dropped"] for r in lines if r["doc_id"] == 1] == [1, 1] and all(r["n_dropped"] == 0 for r in lines if r["doc_id"] is None)
    assert [r["kept_text"] for r in lines if r["doc_id"] == 5] == [line + " "]
    long = " ".join(f"w{i}" for i in range(60))
    repeats = substring.remove_repeats(spark.createDataFrame([(7, long), (7, long), (None, long), (8, long + " end"), (9, None)], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats) == [("7", 0), ("7", 0), ("8", 60), ("9", 0), ("None", 0)]
    assert len(quality.judged(docs, [0.0]).collect()) == len(rows)
    assert decontaminate.hits(spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], DOCS), frame(spark, [ITEM], "item_id")).count() == 1
    assert len(pii.spans(docs).collect()) == len(rows) and len(packing.pack(docs, packing.vocabulary()).collect()) == len(rows)


def test_packing_plans():
    for counts in ({5: 3}, {2048: 4, 1: 1}, {700: 1000, 600: 1000, 748: 1000}, {n: (n * 7919) % 50 for n in range(1, 2049)}, {1500: 10, 540: 9, 8: 100}, {}):
        slots = packing.plan(counts)
        held, given = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in slots:
            for i in range(n):
                held[first + i].append((offset, length))
                given[length].append(rank + i)
        assert {k: sorted(v) for k, v in given.items()} == {k: list(range(n)) for k, n in counts.items() if n}
        for v in held.values():
            assert [o for o, _ in sorted(v)] == [sum(x for _, x in sorted(v)[:i]) for i in range(len(v))] and sum(x for _, x in v) <= 2048
        least = -(-sum(k * n for k, n in counts.items()) // 2048)
        assert len(held) <= least * 1.02 + 3


def test_queries_and_sql_name_the_same():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 12


def test_pipeline(spark):
    docs = common.read(spark, SF, "documents")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stash(stage(spark, before, SF), "test")
        assert after.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before = after
    first = {d for d in seen if not brute.op6(seen[d])[-1]}
    assert set(kept["quality_rules"]) <= first and len(kept["quality_rules"]) > 0.6 * len(first)  # so few texts are a poor corpus
    lines = brute.op5(sorted(kept["quality_rules"].items()))
    assert {d: brute.sha(t) for d, t in kept["line_dedup"].items()} == {d: v[2] for d, v in lines.items()}
    ids, lined = zip(*sorted(kept["line_dedup"].items()), strict=True)
    assert set(kept["near_dedup"]) == {ids[i] for i, c in classes(lined).items() if i == c}  # five-word similarity of all pairs
    pieces = brute.op10(sorted(kept["decontamination"].items()), packing.vocabulary())
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == pieces
