"""Best-fit packing of tokenised documents by linear grouping.

Everything that decides is a histogram: how many pieces there are of each length (``size`` numbers at most, for any input).
On it, large lengths are put into groups of equal cardinality and rounded up within these; few sizes remain, for which the
best mix of configurations (what one sequence holds) is a small linear program, solved by column generation. Whole
configurations are filled with the actual pieces; what is left, small pieces last, goes by best fit. The plan is a
list of runs of equal sequences, so pieces find their places by their length and their rank in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read, stash

SIZE, SEPARATOR, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Pieces of more than this share of a sequence are large; these have so many groups.
LARGE, GROUPS = 0.25, 96
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


class Encoder:
    """Token ids of a text as packed unsigned 32-bit numbers. Text between white space is encoded once and remembered.

    The tokenizer drops white space and looks at nothing beyond it, so parts can be encoded alone; so can a word and the full stop
    or comma behind it. Words of common letters go straight to the model: what the tokenizer does to them before is to
    lower their case and write their UTF-8 bytes as letters.
    """

    def __init__(self, path: str, most: int = 750_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.model = self.tokenizer.model
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(odd)}

    def part(self, text: bytes) -> bytes:
        s = text.decode()
        if s and s[-1] in ".," and s[:-1].isalpha():
            return self.remembered(text[:-1]) + self.remembered(text[-1:])
        if s.isalpha() and max(s) < "\u0130":  # all of these are their own normal form
            ids = [t.id for t in self.model.tokenize(s if s.isascii() else s.lower().encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def remembered(self, text: bytes) -> bytes:
        out = self.known.get(text)
        if out is None:
            out = self.part(text)
            if len(text) <= 100:  # long ones hardly come again
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[text] = out
        return out

    def __call__(self, text: bytes) -> bytes:
        chunks, known = text.lower().split(), self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            return b"".join([self.remembered(c) for c in chunks])


def _pieces(path: str, size: int, separator: int):
    def run(batches):
        import os

        import sys
        import types

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # One encoder for a worker process: what a task has encoded, the next remembers.
        held = sys.modules.setdefault("_chronoloom_encoders", types.ModuleType("_chronoloom_encoders")).__dict__
        encode = held[path] if path in held else held.setdefault(path, Encoder(path))
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            cols = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = encode(text or b"") + separator.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    n = len(cut) // 4
                    for c, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(cut), part, ranks[n]), strict=True):
                        c.append(v)
                    ranks[n] += 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def groups(counts: dict[int, int], k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """At most k groups of equal cardinality, longest first: (largest length, [(length, count)]). k lengths or fewer: one for each."""
    if len(counts) <= k:
        return [(length, [(length, counts[length])]) for length in sorted(counts, reverse=True)]
    total = sum(counts.values())
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append((length, []))
                room = -(-total // k)
            m = min(n, room)
            out[-1][1].append((length, m))
            n, room = n - m, room - m
    return out


def configurations(sizes: list[int], demand: list[int], size: int) -> list[tuple[list[int], float]]:
    """How often each configuration is used: the linear program by column generation, to a ten-thousandth of its optimum.

    A configuration is a count for each size, together no longer than ``size``. The new column is a knapsack's optimum.
    """
    n = len(sizes)
    columns = [[size // s if i == j else 0 for i in range(n)] for j, s in enumerate(sizes)]
    basis, d = np.array(columns, float).T, np.array(demand, float)
    for _ in range(20 * n):  # the gain tails off; any basis is a valid mix
        inverse = np.linalg.inv(basis)
        x, worth = inverse @ d, inverse.sum(0)
        best, last = np.zeros(size + 1), np.full(size + 1, -1)
        for j in np.argsort(-worth):
            s = sizes[j]
            if worth[j] <= 1e-12:
                continue
            for at in range(s, size + 1, s):  # in strides, so that each stride sees the one before
                hi = min(at + s, size + 1)
                gain = best[at - s : hi - s] + worth[j]
                better = gain > best[at:hi] + 1e-12
                best[at:hi] = np.where(better, gain, best[at:hi])
                last[at:hi] = np.where(better, j, last[at:hi])
        if best.max() <= 1 + 1e-4:
            break
        column, at = [0] * n, int(best.argmax())
        while at > 0 and last[at] >= 0:
            column[last[at]] += 1
            at -= sizes[last[at]]
        way = inverse @ np.array(column, float)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = column
        basis[:, out] = column
    return list(zip(columns, np.linalg.solve(basis, d).tolist(), strict=True))


def plan(counts: dict[int, int], size: int = SIZE, large: float = LARGE, k: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, how many, first sequence, offset): piece first + i of that length goes to sequence first + i.

    counts: pieces by length, 1 to ``size``. The number of slots is bounded by lengths and residues, not by the input.
    """
    counts = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= size for length in counts):
        raise ValueError(f"lengths must be 1 to {size}")
    used: dict[int, int] = defaultdict(int)  # ranks given out by length
    slots: list[tuple[int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: runs (first sequence, how many)
    rooms: list[int] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        slots.append((length, used[length], n, first, offset))
        used[length] += n

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((first, n))

    big = {length: n for length, n in counts.items() if size > length > size * large}
    rest = dict(counts)
    made = groups(big, k)
    merged: dict[int, list[list[int]]] = {}
    for top, members in made:  # groups with one largest length are one size
        merged.setdefault(top, []).extend([list(m) for m in members])
    sizes = sorted(merged, reverse=True)
    if sizes:
        for column, x in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], size):
            left = int(x + 1e-6)
            while left > 0:
                wanted = [s for s, c in zip(sizes, column, strict=True) for _ in range(c)]
                if any(not merged[s] for s in wanted):
                    break
                # The actual pieces, longest first: a run of sequences while no length changes.
                need: dict[int, int] = defaultdict(int)
                for s in wanted:
                    need[s] += 1
                run = min([left, *[merged[s][0][1] // c for s, c in need.items()]])
                if run:
                    filled, take = 0, [(merged[s][0][0], s) for s in wanted]
                    for length, s in take:
                        put(length, run, sequences, filled)
                        filled += length
                        merged[s][0][1] -= run
                else:  # one sequence across a change of length
                    run, filled = 1, 0
                    short = [s for s, c in need.items() if sum(n for _, n in merged[s]) < c]
                    if short:
                        break
                    for s in wanted:
                        while not merged[s][0][1]:
                            merged[s].pop(0)
                        put(merged[s][0][0], 1, sequences, filled)
                        filled += merged[s][0][0]
                        merged[s][0][1] -= 1
                for s in need:
                    while merged[s] and not merged[s][0][1]:
                        merged[s].pop(0)
                keep(size - filled, sequences, run)
                sequences += run
                left -= run
        for length in big:
            rest[length] = counts[length] - used[length]
    for length in sorted(rest, reverse=True):  # what is left, by best fit
        left = rest[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # new sequences, each filled with as many as fit
                each = size // length
                n = left // each
                if n:
                    for j in range(each):
                        put(length, n, sequences, j * length)
                    keep(size - each * length, sequences, n)
                    sequences += n
                    left -= n * each
                if left:
                    for j in range(left):
                        put(length, 1, sequences, j * length)
                    keep(size - left * length, sequences, 1)
                    sequences += 1
                    left = 0
                continue
            room = rooms[i]
            first, n = bins[room].pop()
            if not bins[room]:
                rooms.pop(i)
            each = room // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                put(length, full, first, size - room + j * length)
            keep(room - each * length, first, full)
            left -= full * each
            first, n = first + full, n - full
            if n and left and left < each:  # the last ones share one sequence
                for j in range(left):
                    put(length, 1, first, size - room + j * length)
                keep(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            keep(room, first, n)
    return slots


def _placed(slots: list[tuple[int, int, int, int, int]]):
    by: dict[int, list] = defaultdict(list)
    for s in sorted(slots):
        by[s[0]].append(s[1:])
    by = {length: np.array(v, np.int64) for length, v in by.items()}

    def run(batches):
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                here, v = np.flatnonzero(lengths == length), by[int(length)]
                at = np.searchsorted(v[:, 0], ranks[here], side="right") - 1
                sequence[here], offset[here] = v[at, 2] + ranks[here] - v[at, 0], v[at, 3]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pack(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR, large: float = LARGE, k: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row.

    Null or empty text is the separator alone. Only documents longer than ``size`` are cut. A null doc_id and repeated rows
    are packed like others. Extra columns are ignored; an empty table gives an empty one. path: the tokenizer's file.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    pieces = stash(docs.mapInArrow(_pieces(path, size, separator), PIECES), "pack-pieces")
    # Ranks are by length, then part, then place: the parts' counts are summed, no length's pieces meet in one task.
    tally = stash(pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")), "pack-tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    slots = plan(counts, size, large, k)
    before = F.sum("n").over(_by_part())
    starts = tally.select("length", "part", (before - F.col("n")).alias("base"))
    ranked = pieces.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_placed(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_part():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack(read(spark, sf_dir, "documents"), vocabulary())
