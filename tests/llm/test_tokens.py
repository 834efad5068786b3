"""Byte-level BPE and token alignment against the libraries on whole texts."""

import base64
import hashlib
import random
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from chronoloom.llm import alignment, bytebpe, common
from chronoloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH, PATTERN = bytebpe.defaults()


def le(ids):
    return hashlib.sha256(array("I", ids).tobytes()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = ["a", "b", "é", "1", "22", " ", "  ", "\n", "\n ", "\t", ".", "'", "'re", "'s", "x's ", "语", "ß", " ", "🙂", "<|endoftext|>", "the", " and", "don't", "\x1c", "▁", "́"]
    out = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 5, 8, 60, 63, 64, 65, 66, 127, 128, 129, 400, 3000)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(50, 400))) for _ in range(60)]
    out += [" ".join(rng.choice(["the", "of", "hello,", "Berge", "intergalactic", "x-ray", "42"]) for _ in range(n)) for n in (10, 100, 1000)]
    out += ["", None, " ", "   ", "\n", "a" * 1000, " " * 1000 + "x", "x" + " " * 1000, "-" * 200 + "a b c d e f " * 40, "12" * 300 + "'re" * 200, "՘퟿࢏" * 60 + "abc " * 50, "a ͸ b" * 80, "same same", "same same", "\x00 ﻿x", "é­​ z"]
    return out + [t.replace("▁", "") for t in out[:78]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns, two named like the operators' own."""
    rows = [(i, t, f"k{i}", [i], i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, ids array<int>, N_links long").repartition(3)


def plain_encoding():
    return bytebpe.encoding(PATH, PATTERN)


@pytest.mark.parametrize(("size", "overlap"), [(64, 16), (40, 8), (200, 60), (1 << 15, 1 << 10)])
def test_encoding(docs, texts, size, overlap):
    own = plain_encoding()
    out = bytebpe.encode(docs, PATH, PATTERN, size, overlap)
    assert out.columns == ["doc_id", "row", "N_links", "ids"]
    got = {r["doc_id"]: r for r in bytebpe.decode(out, PATH, PATTERN, packed="packed").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert got[i]["ids"] == want, (i, t)
        assert bytes(got[i]["decoded"]) == (t or "").encode()
        assert got[i]["row"] == f"k{i}"
        assert hashlib.sha256(bytes(got[i]["packed"])).hexdigest() == le(want)


def test_chunks_of_one_text_are_many_rows(spark):
    """Pieces meet where the chunks' boundaries do, and a long text is dealt out."""
    text = "".join(random.Random(3).choice(["word ", "an, ", "3.14 ", "ü'll ", "\n\n"]) for _ in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text[::-1]), (None, text)], "doc_id long, text string")
    got = bytebpe.encode(docs, PATH, PATTERN, 1000, 50).collect()
    own = plain_encoding()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((d, own.encode_ordinary(t)) for d, t in ((1, text), (2, text[::-1]), (0, text)))


def test_bytes_that_are_no_text(spark):
    ids = spark.createDataFrame([([0, 188, 222],), ([],), (None,)], "ids array<int>")
    got = [r["decoded"] for r in bytebpe.decode(ids, PATH, PATTERN).collect()]
    assert [None if b is None else bytes(b) for b in got] == [plain_encoding().decode_bytes([0, 188, 222]), b"", None]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.encode(empty, PATH, PATTERN).count() == 0
    alone = bytebpe.encode(spark.createDataFrame([("a b",)], "text string"), PATH, PATTERN)
    assert alone.columns == ["ids"] and alone.count() == 1
    with pytest.raises(ValueError, match="overlap"):
        bytebpe.encode(empty, PATH, PATTERN, 10, 10)
    assert alignment.align(empty, *alignment.defaults()).documents().count() == 0


def test_query_of_encoding(spark):
    own = plain_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    want = {d: own.encode_ordinary(t) for d, t in texts.items()}
    assert got == {d: (len(ids), le(ids), hashlib.sha256(texts[d].encode()).hexdigest()) for d, ids in want.items()}


def brute_alignment(texts):
    """{key: the seven results} from whole texts, byte ranges and plain sets; and the pairs' counts."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        a_bytes = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())}
    links, shapes, docs_of = {}, {}, defaultdict(set)
    for key, text in texts.items():
        links[key], shapes[key] = [], (0, 0, 0, "")
        if not text:
            continue
        raw = f" {text}".encode()
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        if b"".join(a_bytes[i] for i in ids_a) != raw or b"".join(b_bytes[i] for i in ids_b) != raw:
            continue
        ranges = []
        for ids, table in ((ids_a, a_bytes), (ids_b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            ranges.append(own)
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if begin <= s and e <= cut) for own in ranges) if len(raw) < 4000 else None)
            begin = cut
        if None in groups:  # the same, not for each group anew
            marks = [{e: n for n, (_, e, _) in enumerate(own, 1)} for own in ranges]
            last, groups = (0, 0), []
            for cut in cuts:
                now = (marks[0][cut], marks[1][cut])
                groups.append("|".join(",".join(str(x[2]) for x in own[last[k] : now[k]]) for k, own in enumerate(ranges)))
                last = now
        shapes[key] = (len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
        j = 0
        for s, e, i in ranges[0]:
            while ranges[1][j][1] <= s:
                j += 1
            m = j
            while m < len(ranges[1]) and ranges[1][m][0] < e:
                links[key].append((i, ranges[1][m][2]))
                docs_of[i, ranges[1][m][2]].add(key)
                m += 1
    counts = {p: len(d) for p, d in docs_of.items()}
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    done = {k: (*shapes[k][:3], len(v), sum(counts[p] == best[p[0]] for p in v), sum(counts[p] for p in v), shapes[k][3]) for k, v in links.items()}
    return done, counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("parts", [1 << 16, 20])
def test_alignment(monkeypatch, docs, texts, parts):
    """With 20 parts next to nothing is hot, so both joins' other way is taken."""
    monkeypatch.setattr(common, "PARTS", parts)
    done, counts = brute_alignment(dict(enumerate(texts)))
    found = alignment.align(docs, *alignment.defaults())
    out = found.documents()
    assert out.columns == ["doc_id", "row", "ids", *COLUMNS]
    rows = out.collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == done and len(rows) == len(texts)
    assert {(r["a"], r["b"]): r["n_docs"] for r in found.pairs.collect()} == counts
    assert sum(1 for v in done.values() if v[0]) > 60 and sum(1 for t, v in zip(texts, done.values(), strict=True) if t and not v[0]) > 5


def test_query_of_alignment(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_token_alignment"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == brute_alignment(texts)[0]


def test_no_document_is_expanded(docs):
    """Links are made of the dictionary, not of the texts: the plan of the sums explodes groups only."""
    found = alignment.align(docs, *alignment.defaults())
    assert found.groups.groupBy("g").count().where(F.col("count") > 1).isEmpty()
    assert found.members.count() > found.groups.count()


def test_libraries_agree_on_classes():
    """Where Python's tables know a character, the pattern's classes are those of the encoder."""
    import unicodedata

    import regex

    toy = {bytes([i]): i for i in range(256)}
    chars = [chr(c) for c in range(0x80, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    for c in chars:
        for k in range(2, len(c.encode()) + 1):
            toy.setdefault(c.encode()[:k], len(toy))
    for c in chars:
        for h in ("a", "1", "!"):
            toy.setdefault((h + c).encode(), len(toy))
    own = tiktoken.Encoding("toy", pat_str=PATTERN, mergeable_ranks=toy, special_tokens={})
    find = regex.compile(PATTERN).findall
    for c in chars:
        for h in ("a", "1", "!"):
            assert (own.encode_ordinary(h + c) == [toy[(h + c).encode()]]) == (find(h + c) == [h + c]), (h, c)
