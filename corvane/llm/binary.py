"""Packing by power-of-two decomposition: sequences of binary lengths that never cross documents.

A document's tokens plus an end token are cut into pieces of ``capacity`` tokens, as many
as fit, and the rest into one piece for each set bit of its length, longest first. Every
piece is a sequence of its own, at offset 0, so no sequence holds two documents, and
since its length is a power of two it needs no padding. Sequences of equal length form a
bucket and are numbered within it without a gap, the longest bucket first, so a bucket is
a range of ``sequence_id`` and ``batches`` can deal it out by numbers alone.

Pieces are numbered within the task that made them; the tasks' counts (at most one row for
a task and bucket) give the offsets. No bucket is ever gathered or sorted.

Edge cases: null and empty texts are the end token alone, a sequence of length 1; texts of
any length are tokenized whole; pieces of one length are alike and go in the order of tasks
and rows; repeated rows and ids are packed each; null ids are kept; extra columns are
ignored, whatever their names; no documents give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .packing import RANKS, VOCABULARY, encode
from .tables import BROADCAST_ROWS, materialize

CAPACITY = 2048
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def decompose(tokens: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start in its document and length of each piece, for documents of so many tokens."""
    powers = capacity >> np.arange(1, capacity.bit_length())
    whole, rest = tokens // capacity, tokens % capacity
    row, bit = np.nonzero(rest[:, None] & powers)
    doc = np.concatenate([np.repeat(np.arange(len(tokens)), whole), row])
    size = np.concatenate([np.full(whole.sum(), capacity, np.int64), powers[bit].astype(np.int64)])
    order = np.argsort(doc, kind="stable")
    doc, size = doc[order], size[order]
    ends = np.cumsum(size)
    before = np.cumsum(tokens) - tokens
    return doc, ends - size - before[doc], size


def _pieces(capacity: int, end_id: int, vocabulary: str, ranks: str, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"] + ["ids"] * with_ids

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for rows, _, _ in K.chunks(batches):
            each = [encode(text, vocabulary, ranks) for text in rows.column("text").to_pylist()]
            tokens = np.array([len(x) + 1 for x in each], np.int64)
            ids = np.concatenate([x for one in each for x in (one, end)]).astype("<u4")
            doc, start, size = decompose(tokens, capacity)
            cuts, view = [0, *(4 * np.cumsum(size)).tolist()], memoryview(ids).cast("B")
            crc = [zlib.crc32(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            nth = np.zeros(len(size), np.int64)
            for x in np.unique(size):
                at = np.flatnonzero(size == x)
                nth[at] = seen[x] + np.arange(len(at))
                seen[x] += len(at)
            out = [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(np.full(len(size), part, np.int32)), pa.array(nth)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.array(cuts) // 4, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.record_batch(out, names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document, place there, tokens, checksum (and ids, if asked for), sequence, and number in its bucket."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    more = ["ids"] * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(capacity, end_id, vocabulary, ranks, with_ids), f"{PIECE}, part int, nth long" + ", ids array<int>" * with_ids)
    pieces = materialize(pieces, "binary")
    by_task = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "buckets")
    sizes = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each power of two
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    offsets = by_task.select("length", "part", before.alias("before"))
    base = F.lit(0).cast("long")
    for size in sizes:
        base = F.when(F.col("length") == size, F.lit(sum(n for s, n in sizes.items() if s > size)).cast("long")).otherwise(base)
    numbered = pieces.join(F.broadcast(offsets) if by_task.count() <= BROADCAST_ROWS else offsets, ["length", "part"])
    number = F.col("before") + F.col("nth")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (base + number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), number.alias("number"), *more)


def batches(sequences: DataFrame, tokens: int) -> DataFrame:
    """Sequences with ``batch``: of one length, ``tokens`` tokens each but for the last of a bucket; a batch is told by ``length, batch``."""
    return sequences.withColumn("batch", F.expr(f"number div greatest(1, {int(tokens)} div length)"))
