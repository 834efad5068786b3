"""Links between the tokens of two tokenizers over the same texts, by a dictionary of groups.

A text's tokens are cut into groups where tokens of both end at the same byte. Few distinct groups make up all texts: they are
interned, their links are worked out once for each, and what a group counts for is multiplied by the documents that hold
it. A document's sums come from a join of its distinct groups with the dictionary.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .bytebpe import schema, segments, slices, texts_of
from .common import lookup, others, read, stash

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments a task remembers.
REMEMBERED = 250_000
OWN = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(A_FILE)), str(public_tokenizers.path(B_FILE))


class Pair:
    """Both tokenizers, their tokens' bytes, and what is known of segments."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(letters[c] for c in token) for token, i in names.items() if all(c in letters for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        # Where a piece has a space behind other characters, tokens may run over a segment's end.
        self.cut = (lambda text: [text]) if any("▁" in p.lstrip("▁") for p in pieces) else segments
        self.len_a, self.len_b = [len(self.a_bytes.get(i, b"")) for i in range(max(names.values()) + 1)], [len(self.b_bytes[i]) for i in range(len(pieces))]
        self.known, self.old = {}, {}
        # Groups have numbers here: their names, pairs, and tokens of A and B, as one number.
        self.number: dict = {}
        self.names, self.pairs, self.sizes = [], [], []

    def group(self, a: list[int], b: list[int]) -> int:
        key = (a[0], b[0]) if len(a) == len(b) == 1 else f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.names)
            name = key if isinstance(key, str) else f"{a[0]}|{b[0]}"
            self.names.append(name)
            self.pairs.append(tuple(x << 32 | y for x, y in self.links(name)))
            self.sizes.append(len(a) << 32 | len(b))
        return at

    def groups(self, a: list[int], b: list[int]) -> tuple[int, ...]:
        """The groups' numbers: tokens are taken from whichever side is behind till both end at one byte."""
        out, len_a, len_b = [], self.len_a, self.len_b
        i = j = first_a = first_b = ahead = 0
        while i < len(a):
            if ahead <= 0:
                ahead += len_a[a[i]]
                i += 1
            while ahead > 0:
                ahead -= len_b[b[j]]
                j += 1
            if not ahead:
                out.append(self.group(a[first_a:i], b[first_b:j]))
                first_a, first_b = i, j
        return tuple(out)

    def encoded(self, texts: list[str]) -> list:
        """The groups of each text, or None if a tokenizer doesn't give its bytes back."""
        out = []
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            every = zip(part, self.a.encode_batch_fast([f" {t}" for t in part], add_special_tokens=False), self.b.encode(part, num_threads=1), strict=True)
            for text, a, b in every:
                a, raw = a.ids, f" {text}".encode()
                same = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
                out.append(self.groups(a, b) if same else None)
        return out

    def learn(self, texts: set[str]) -> dict:
        """The groups of these segments. What two generations of short ones had is remembered."""
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        if len(self.names) > 5 * REMEMBERED:
            for held in (self.known, self.old, self.number, self.names, self.pairs, self.sizes):
                held.clear()
        known, old, new, found = self.known, self.old, [], {}
        for t in texts:
            if t in known:
                found[t] = known[t]
            elif t in old:
                found[t] = known[t] = old[t]
            else:
                new.append(t)
        for t, groups in zip(new, self.encoded(new), strict=True):
            found[t] = groups
            if len(t) <= 100:
                known[t] = groups
        return found

    def links(self, group: str) -> Counter:
        """How often each (A id, B id) is linked in a group: the tokens' ranges overlap."""
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        out, i, j = Counter(), 0, 0
        end_a, end_b = self.len_a[a[0]], self.len_b[b[0]]
        while True:
            out[a[i], b[j]] += 1
            step_a, step_b = end_a <= end_b, end_b <= end_a
            i, j = i + step_a, j + step_b
            if i == len(a) or j == len(b):
                return out
            end_a += self.len_a[a[i]] if step_a else 0
            end_b += self.len_b[b[j]] if step_b else 0


TABLE = "n_a long, n_b long, n_groups long, groups_sha256 string, groups array<struct<g: string, n: long>>, again array<struct<a: int, b: int, n: long>>"


def _tabulate(a_path: str, b_path: str):
    """(row, rest, what TABLE says) from (rest, text). ``again``: pairs that several distinct groups of the text have, with the number beyond one."""

    def run(batches):
        from pyspark import TaskContext

        pair, row = Pair(a_path, b_path), TaskContext.get().partitionId() << 33
        for b in slices(batches, 1):
            texts = [(t, pair.cut(t) if t else []) for t in texts_of(b.column(1))]
            found = pair.learn({p for _, parts in texts for p in parts})
            cols: list[list] = [[] for _ in range(5)]
            groups, counts, again, held, more = [], [], [], [0], [0]
            for text, parts in texts:
                seen = [found[p] for p in parts]
                # A segment that isn't given back: the whole text is asked.
                flat = list(chain.from_iterable(seen)) if None not in seen else pair.encoded([text])[0] or []
                times = Counter(flat)
                linked = list(chain.from_iterable(map(pair.pairs.__getitem__, times)))
                if len(set(linked)) < len(linked):
                    again += [(p, n - 1) for p, n in Counter(linked).items() if n > 1]
                name = pair.names.__getitem__
                groups.extend(map(name, times))
                counts += times.values()
                held.append(len(groups))
                more.append(len(again))
                sha = hashlib.sha256(";".join(map(name, flat)).encode()).hexdigest() if flat else ""
                size = sum(map(pair.sizes.__getitem__, flat))
                n_a, n_b = size >> 32, size & 0xFFFFFFFF
                for c, v in zip(cols, (row, n_a, n_b, len(flat), sha), strict=True):
                    c.append(v)
                row += 1
            groups_ = pa.StructArray.from_arrays([pa.array(groups, pa.string()), pa.array(counts, pa.int64())], ["g", "n"])
            again_ = pa.StructArray.from_arrays([pa.array([p >> 32 for p, _ in again], pa.int32()), pa.array([p & 0xFFFFFFFF for p, _ in again], pa.int32()), pa.array([n for _, n in again], pa.int64())], ["a", "b", "n"])
            flat_ = [pa.array(c, pa.int64()) for c in cols[:4]]
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((held, groups_), (more, again_))]
            yield pa.RecordBatch.from_arrays([flat_[0], b.column(0), *flat_[1:], pa.array(cols[4], pa.string()), *lists], names=["row", "rest", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "again"])

    return run


def _expand(a_path: str, b_path: str):
    """(g, n_docs, a, b, times) from (g, n_docs): the links of each distinct group."""

    def run(batches):
        pair = Pair(a_path, b_path)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for (a, b), times in pair.links(g).items():
                    for c, v in zip(cols, (g, n, a, b, times), strict=True):
                        c.append(v)
                if len(cols[0]) > 100_000:
                    yield _links(cols)
                    cols = [[] for _ in range(5)]
            yield _links(cols)

    def _links(cols):
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "n_docs", "a", "b", "times"])

    return run


class Alignment:
    """The tables of an alignment, each worked out once and kept in the scratch folder.

    ``texts``: a row for each of docs. ``groups`` (g, n_docs): the dictionary. ``pairs`` (a, b, n_docs, best, n_groups): how many documents
    hold a pair linked, whether that is its A id's most, and how many distinct groups have it. ``scores`` (g, n_docs, links, best, counts):
    the sums over a group's links.
    """

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        self.keep = others(docs, "text", *OWN)
        rest = F.struct(*[docs[c] for c in self.keep]) if self.keep else F.struct(F.lit(0).alias("_"))
        own = docs.select(rest.alias("rest"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))
        table = schema("row long", StructField("rest", own.schema["rest"].dataType), TABLE)
        self.texts = stash(own.mapInArrow(_tabulate(a_path, b_path), table), "align-texts")
        self.members = self.texts.select("row", F.explode("groups").alias("x")).select("row", "x.g", "x.n")
        self.groups = stash(self.members.groupBy("g").agg(F.count("*").alias("n_docs")), "align-groups")
        links = stash(self.groups.mapInArrow(_expand(a_path, b_path), "g string, n_docs long, a int, b int, times long"), "align-links")
        # A document that holds a pair in several groups was counted in each of these.
        again = self.texts.select(F.explode("again").alias("x")).select("x.a", "x.b", (-F.col("x.n")).alias("n_docs"), F.lit(0).alias("n_groups"))
        pairs = links.select("a", "b", "n_docs", F.lit(1).alias("n_groups")).unionByName(again).groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_groups").alias("n_groups"))
        pairs = stash(pairs, "align-pairs")
        most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each entry of A's vocabulary
        self.pairs = stash(pairs.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"), "n_groups"), "align-best")
        counted = lookup(links.select("g", F.col("n_docs").alias("held"), "a", "b", "times"), self.pairs, ["a", "b"], "n_groups")
        times = F.col("times")
        scores = counted.groupBy("g").agg(F.first("held").alias("n_docs"), F.sum("times").alias("links"), F.sum(F.when(F.col("best"), times).otherwise(0)).alias("best"), F.sum(times * F.col("n_docs")).alias("counts"))
        self.scores = stash(scores, "align-scores")

    def documents(self) -> DataFrame:
        """The columns of docs but ``text``, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
        held = lookup(self.members, self.scores, ["g"], "n_docs")
        n = F.col("n")
        sums = held.groupBy("row").agg(F.sum(n * F.col("links")).alias("n_links"), F.sum(n * F.col("best")).alias("n_best"), F.sum(n * F.col("counts")).alias("count_sum"))
        out = self.texts.select("row", "rest", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        return out.select(*[F.col("rest")[c].alias(c) for c in self.keep], "n_a", "n_b", "n_groups", *[zero(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str) -> Alignment:
    """Aligns the tokens of `` `` + text by a byte-level BPE file (A) with those of text by a SentencePiece file (B).

    Null and empty texts, and those whose tokens of either kind don't give back `` `` + text, have no tokens: zeros and ''. Each row is a
    document: repeated rows count as often as they come, a null key as any other. Ties for an A id's highest count are all best. Other
    columns are passed through; those with names of the results are left out. An empty table gives empty ones.
    """
    return Alignment(docs, a_path, b_path)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links."""
    out = align(read(spark, sf_dir, "documents").select("doc_id", "text"), *defaults()).documents()
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
