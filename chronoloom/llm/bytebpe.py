"""Byte-level BPE: texts to ids and back.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised alone; where, within an overlap, both chunks have a
boundary at the same place, they agree from there on, as the pattern never looks back over a boundary. The text is cut
anew at these places into pieces of whole pre-tokens, which are encoded in parallel and put together by position. Decoding
concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import others, read, stash

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a chunk, and of what the next one repeats.
SIZE, OVERLAP = 1 << 15, 1 << 10
#: The pattern looks this far beyond a pre-token's end.
AHEAD = 3


def defaults() -> tuple[str, str]:
    """The rank file's path and the pattern of the installed vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts_of(column) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def slices(batches, column: int, most: int = 1 << 21):
    """Batches of so many bytes in a column at most, or of one row: what a task holds doesn't depend on how rows are batched."""
    for b in batches:
        begin, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if held and held + n > most:
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += n + 64
        if begin < b.num_rows:
            yield b.slice(begin)


#: White space before a space, a space at an end.
_BLANK = re.compile(r"\s |\A | \Z")


def segments(text: str) -> list[str]:
    """The parts of a text between single spaces, so that `` `` + part, all joined, is `` `` + text.

    A space that follows white space, or ends the text, stays in a part. At all others pre-tokens end, whatever is around.
    """
    if not _BLANK.search(text):
        return text.split(" ")
    out, (now, *parts) = [], text.split(" ")
    for p in parts:
        if not now or now[-1].isspace():
            now = f"{now} {p}"
        else:
            out.append(now)
            now = p
    if not now and out:
        out[-1] += " "
    else:
        out.append(now)
    return out


class Memory(dict):
    """What was worked out for short texts. Of two generations the older goes, so that frequent ones stay."""

    def __init__(self, work, most: int = 250_000, chars: int = 100):
        super().__init__()
        self.work, self.most, self.chars, self.old = work, most, chars, {}

    def __missing__(self, text: str):
        out = self.old.get(text)
        out = self.work(text) if out is None else out
        if len(text) <= self.chars:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = out
        return out


class Encoder:
    """Ids of a text as packed 32-bit numbers. What is between spaces is encoded with the space before it, once."""

    def __init__(self, path: str, pattern: str):
        self.own = encoding(path, pattern)
        self.known = Memory(lambda part: array("i", self.own.encode_ordinary(f" {part}")).tobytes())

    def __call__(self, text: str) -> bytes:
        first, *rest = segments(text)
        return array("i", self.own.encode_ordinary(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))


def schema(*parts: str | StructField) -> StructType:
    """Fields, and what DDL strings say, in this order."""
    return StructType([f for p in parts for f in (StructType.fromDDL(p) if isinstance(p, str) else [p])])


def _lists(rows: list) -> pa.Array:
    ends = list(accumulate((len(r) for r in rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([v for r in rows for v in r], pa.int64()))


def _encode(path: str, pattern: str):
    """ids in place of the text, the last column."""

    def run(batches):
        encode = Encoder(path, pattern)
        for b in slices(batches, -1):
            ids = [encode(t) for t in texts_of(b.column(b.num_columns - 1))]
            ends = pa.array(accumulate((len(i) // 4 for i in ids), initial=0), pa.int32())
            flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, flat)], names=[*b.schema.names[:-1], "ids"])

    return run


def _cut(size: int, overlap: int):
    """(row, no, n, chunk, rest) from (rest, text): row numbers are this task's; rest goes with the first chunk."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, text in enumerate(texts_of(b.column(1))):
                places = range(0, len(text), size)
                rest = pa.concat_arrays([b.column(0).slice(i, 1), pa.nulls(len(places) - 1, b.column(0).type)])
                cols = [pa.array([row] * len(places), pa.int64()), pa.array(range(len(places)), pa.int32()), pa.array([len(text)] * len(places), pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([text[p : p + size + overlap] for p in places]), rest], names=["row", "no", "n", "chunk", "rest"])
                row += 1

    return run


def _boundaries(pattern: str, size: int, overlap: int):
    """Adds the boundaries between pre-tokens in a chunk's first and last ``overlap`` characters, as places in the whole text.

    Only those behind no white space: a piece that ended with it would be read as if nothing followed. None for a chunk with characters that Unicode's tables of Python leave unassigned: libraries differ in what they take these for.
    """

    def run(batches):
        import unicodedata

        import regex

        find = regex.compile(pattern).finditer
        for b in slices(batches, 3):
            heads, tails = [], []
            for no, n, chunk in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                first = no * size
                # What touches the end of a chunk may go on behind it.
                sure = len(chunk) if first + len(chunk) == n else len(chunk) - AHEAD
                doubtful = any(unicodedata.category(c) == "Cn" for c in set(chunk))
                starts = [] if doubtful else [m.end() for m in find(chunk) if m.end() <= sure and not m[0][-1].isspace()]
                heads.append([first + s for s in starts if s < overlap])
                tails.append([first + s for s in starts if s >= size])
            cols = [*b.columns, _lists(heads), _lists(tails)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "head", "tail"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The columns of docs but ``text``, and ``ids`` (array of int) in place of any column of that name.

    Each match of the pattern is encoded by the ranks alone; no special tokens. Null and empty texts have no ids. Each row is
    encoded for itself, so repeated rows and null keys need no care; other columns are passed through. An empty table gives an
    empty one. Bytes that are no UTF-8 count as U+FFFD. Texts of more than ``size`` characters are cut into chunks.
    Where neighbours share no boundary (a pre-token longer than the overlap), the rest of the text from the last one is one piece.
    """
    if not 0 < overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    keep = others(docs, "text", "ids")
    own = docs.select((F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(0).alias("_"))).alias("rest"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rest, ids = StructField("rest", own.schema["rest"].dataType), "ids array<int>"
    own = own.select("rest", F.col("text").cast("binary").alias("text"), (F.char_length("text") > size).alias("long"))
    short = own.where("not long").select("rest", "text").mapInArrow(_encode(path, pattern), schema(rest, ids))
    cut = own.where("long").select("rest", "text").mapInArrow(_cut(size, overlap), schema("row long, no int, n long, chunk string", rest))
    split = cut.repartition("row", "no")
    split = stash(split.mapInArrow(_boundaries(pattern, size, overlap), schema(*split.schema, "head array<long>, tail array<long>")), "bpe-chunks")
    w = Window.partitionBy("row").orderBy("no")
    places = split.select("row", "no", F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w)))).alias("at"))
    # A chunk without a common boundary, and all behind it, belong to the piece before.
    places = places.withColumn("ok", F.max(F.col("at").isNull().cast("int")).over(w) == 0).withColumn("owner", F.max(F.when(F.col("ok"), F.col("no"))).over(w))
    own_end = (F.col("no") + 1).cast("long") * size
    places = places.select(
        "row", "no", "owner",
        F.when(F.col("ok"), F.col("at")).otherwise(F.col("no").cast("long") * size).alias("begin"),
        F.when(F.lead("ok").over(w), F.lead("at").over(w)).otherwise(own_end).alias("end"),
        F.count("*").over(Window.partitionBy("row", "owner")).alias("parts"),
    )
    part = F.substr(F.col("chunk"), (F.col("begin") - F.col("no").cast("long") * size + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    pieces = split.drop("head", "tail").join(places, ["row", "no"]).select("row", "owner", "no", "parts", "rest", part.alias("text"))
    one = pieces.where("parts = 1").select("row", "owner", "rest", "text")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "")
    many = pieces.where("parts > 1").groupBy("row", "owner").agg(F.first("rest", ignorenulls=True).alias("rest"), joined.alias("text"))
    done = one.unionByName(many).mapInArrow(_encode(path, pattern), schema("row long, owner int", rest, ids))
    long = done.groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("owner", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long.select("rest", "ids")).select(*[F.col("rest")[c].alias(c) for c in keep], "ids")


def decode(df: DataFrame, path: str, pattern: str, name: str = "decoded", packed: str | None = None) -> DataFrame:
    """df, which has ``ids``, with their bytes under ``name`` (binary; they need not be UTF-8). Null ids have null bytes.

    ``packed`` names a column for the ids as little-endian unsigned 32-bit numbers. Columns of these names are replaced.
    """
    df = df.select(*others(df, name, packed or name))
    at = df.columns.index("ids")

    def run(batches):
        own = encoding(path, pattern)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                found = [None if ids is None else own.decode_bytes(ids) for ids in b.column(at).to_pylist()]
                more = [pa.array(found, pa.binary())]
                if packed:
                    more.append(pa.array([None if x.values is None else x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for x in b.column(at)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, name, *([packed] if packed else [])])

    return df.mapInArrow(run, schema(*df.schema, *[StructField(n, BinaryType()) for n in (name, packed) if n]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes that these decode to, as digests."""
    path, pattern = defaults()
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    out = decode(ids, path, pattern, packed="packed")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
