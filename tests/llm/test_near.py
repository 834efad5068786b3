"""Near copies against the similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from chronoloom.llm import nearcopies

VOCAB = [a + b for a in "ka lo mi nu re sa to vi".split() for b in "bel dor fin gat hum jes".split()]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def classes(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return dict(enumerate(root))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(25):  # from none to many words changed
        base = [rng.choice(VOCAB) for _ in range(rng.choice([60, 150, 400]))]
        for n in (0, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(len(w))] = "other"
            out.append(" ".join(w))
    return [*out, out[0].upper(), "", None, " \n", "one", "One", "one two"]


@pytest.mark.parametrize("hot", [32, 2])
def test_near_copies(spark, texts, hot):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs, hot=hot).collect()}
    assert got == classes(texts)


def test_stage_drops_near_copies(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert got == {d for d, c in classes(texts).items() if d == c}


def test_near_copies_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A b c d e f"), (3, "a b c d e g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in nearcopies.keep_first(docs).collect()) == ["1", "3", "None", "None"]
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def shared_passage(texts=360, pairs=40):
    """Texts that share a 350-word passage, any two 0.71 alike, and among them pairs at 0.8 or more: in hot bands these are few."""
    rng = random.Random(9)
    own = lambda n: [f"{rng.choice(VOCAB)}{rng.randrange(10_000)}" for _ in range(n)]
    passage, out = own(350), []
    for i in range(texts):
        tail = own(70)
        out.append(" ".join(passage + tail))
        if i < pairs:
            for k in rng.sample(range(70), 1 + i % 6):
                tail[k] = "changed"
            out.append(" ".join(passage + tail))
    return out


@pytest.mark.parametrize("idle", [3, 0])
def test_pairs_in_hot_bands(spark, monkeypatch, idle):
    """None is lost, with drawn rounds before the exact comparison and without."""
    monkeypatch.setattr(nearcopies, "IDLE", idle)
    texts = shared_passage()
    want = classes(texts)
    assert sum(c != i for i, c in want.items()) == 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == want


def test_prefixes_hold_all_pairs(spark, texts):
    """Every pair as similar as asked, of any classes, is among those named, at several similarities."""
    sets = [sorted({hash(g) for g in shingles(t)}) for t in [*texts, *shared_passage(60, 20)]]
    rows = [(i, len(s), i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "fp long, n int, class long, s array<long>").repartition(4)
    for least in (0.5, 0.8, 0.95):
        want = {(a, b) for b in range(len(sets)) for a in range(b) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least}
        got = {(r["a"], r["b"]) for r in nearcopies.prefix_pairs(df, least).collect()}
        assert want <= got and len(want) > 10
    kin = df.withColumn("class", (df["fp"] / 7).cast("long"))
    assert all(a // 7 != b // 7 for a, b in nearcopies.prefix_pairs(kin, 0.8).collect())


def test_classes_meet_only_if_sizes_and_places_allow(spark, monkeypatch):
    """Sets of many sizes with shingles of one pool: few of the classes that share one may be as similar as asked."""
    rng, sets, met = random.Random(4), [], {}
    for i in range(120):
        sets.append(rng.sample(sets[-1], int(len(sets[-1]) * 0.93)) if i % 5 == 4 else rng.sample(range(2000), rng.randrange(60, 400)))
    df = spark.createDataFrame([(i, len(s), i, sorted(s)) for i, s in enumerate(sets)], "fp long, n int, class long, s array<long>").repartition(4)
    kept = nearcopies.stash
    monkeypatch.setattr(nearcopies, "stash", lambda d, name: met.setdefault(name, kept(d, name)))
    got = {(r["a"], r["b"]) for r in nearcopies.prefix_pairs(df, 0.8).collect()}
    assert {(i - 1, i) for i in range(4, 120, 5)} <= got
    assert met["near-meet"].count() < met["near-prefixes"].count()
