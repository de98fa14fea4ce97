"""Best-fit packing of token pieces into sequences by exact-complement hashing.

A document's tokens plus an end token are one piece, or pieces of ``CAPACITY``
tokens of which the first may be shorter. What is packed are counts of pieces by
length, at most ``CAPACITY`` numbers however many documents there are. Sums of one,
two and three available lengths are indexed. For each length, longest first, the rest
of a sequence is looked up there, and combinations that fill it exactly are consumed as
often as the counts allow, until the index has none; what is left goes best-fit, longest
first.
The plan is a list of patterns with a multiplicity. Pieces of a length are
numbered by running numbers within a task plus the tasks' offsets, and a number
leads to its place in the plan, so no group of pieces is ever gathered.

Edge cases: null and empty texts are the end token alone; texts of any length are
tokenized whole; pieces of one length are alike, and go in the order of tasks and rows;
repeated rows are packed each; null ids are kept; extra columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

CAPACITY = 1024
END_ID = 2
#: The vocabulary, and the same one as ranks for the faster of two libraries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|endoftext|>"


@functools.cache
def _reference(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _fast(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> np.ndarray:
    """Token ids of a text, as the tokenizer file gives them; texts with its special token take the slower library."""
    if not text:
        return np.zeros(0, np.uint32)
    if SPECIAL not in text:
        try:
            return _fast(ranks).encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the library's own panic at extreme runs isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    return np.array(_reference(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(capacity: int, end_id: int, vocabulary: str, ranks: str, with_ids: bool):
    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py(), vocabulary, ranks), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(head, len(ids), capacity)], range(head, len(ids) + 1, capacity), strict=True)):
                    row = [doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])] + [ids[a:b].astype(np.int32)] * with_ids
                    seen[b - a] += 1
                    for to, x in zip(out, row, strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    return run


class Sums:
    """An index of the sums of one, two and three available lengths, kept as counts run out.

    ``pair[s]`` and ``triple[s]`` are the larger, or largest, length of a combination of the sum ``s``
    that was available when last looked at. Lengths only ever run out, so one that isn't found again
    from there downwards is gone for good, and every sum is walked down once.
    """

    def __init__(self, left: np.ndarray):
        self.left, n = left, len(left)
        self.pair, self.triple = np.arange(n) - 1, np.arange(n) - 2

    def has(self, lengths: tuple[int, ...], used: int) -> bool:
        """Whether a sequence can hold these lengths beside one of length ``used``."""
        return all(self.left[x] >= (used == x) + lengths.count(x) for x in lengths)

    def filling(self, gap: int, used: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to ``gap``, or None."""
        if gap > 0 and self.has((gap,), used):
            return (gap,)
        return self.two(gap, used) or self.three(gap, used)

    def two(self, gap: int, *used: int) -> tuple[int, int] | None:
        while 2 * self.pair[gap] >= gap > 1:
            a = int(self.pair[gap])
            if self.left[a] and self.left[gap - a]:
                for x in range(a, (gap - 1) // 2, -1):
                    if self.left[x] and self.left[gap - x] and all(self.left[y] >= (x, gap - x, *used).count(y) for y in (x, gap - x)):
                        return x, gap - x
                return None
            self.pair[gap] -= 1
        return None

    def three(self, gap: int, used: int) -> tuple[int, int, int] | None:
        while 3 * self.triple[gap] >= gap > 2:
            a = int(self.triple[gap])
            if self.left[a] and self.two(gap - a) is not None:
                for x in range(a, (gap - 1) // 3, -1):
                    two = self.two(gap - x, used, x) if self.left[x] else None
                    if two and self.has((x, *two), used):
                        return x, *two
                return None
            self.triple[gap] -= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used; uses every piece once.

    At most ``capacity`` distinct lengths come in, so the work and the number of
    patterns don't depend on how many pieces there are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    patterns: list[tuple[list[int], int]] = []

    def take(*lengths: int) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        if times:
            left[used] -= need[used] * times
            patterns.append((list(lengths), times))

    index = Sums(left)
    for size in range(capacity, 0, -1):
        while left[size]:
            rest = index.filling(capacity - size, size) if size < capacity else ()
            if rest is None:
                break
            take(size, *rest)
    open_bins: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            gap = next((g for g in range(size, capacity) if open_bins[g]), None)
            if gap is None:
                fit = capacity // size
                whole, rest = divmod(n, fit)
                for lengths, times in (([size] * fit, whole), ([size] * rest, 1 if rest else 0)):
                    if times:
                        open_bins[capacity - sum(lengths)].append((lengths, times))
                n = 0
            else:
                lengths, times = open_bins[gap].pop()
                used = min(n, times)
                if times > used:
                    open_bins[gap].append((lengths, times - used))
                open_bins[gap - size].append(([*lengths, size], used))
                n -= used
    return patterns + [x for bins in open_bins for x in bins]


def places(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, sequence of that number, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for i, size in enumerate(lengths):
            at = used.get(size, 0)
            used[size] = at + times
            rows.append((size, at, sequence, offset))
            offset += size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray, keep: list[str]):
    def run(batches):
        keys = (table[:, 0] << 45) + table[:, 1]
        for batch in batches:
            number = (batch.column("length").to_numpy() << 45) + batch.column("number").to_numpy()
            row = table[np.searchsorted(keys, number, "right") - 1] if len(table) else np.zeros((0, 4), np.int64)
            sequence = row[:, 2] + batch.column("number").to_numpy() - row[:, 1]
            yield pa.record_batch([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(row[:, 3])], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document, tokens, checksum (and ids, if asked for), sequence and offset."""
    schema = PIECE + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(capacity, end_id, vocabulary, ranks, with_ids), schema), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(by_task.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("number", F.col("before") + F.col("nth"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    table = places(plan(counts, capacity))
    return numbered.select(*keep, "number").mapInArrow(_place(table, keep), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
