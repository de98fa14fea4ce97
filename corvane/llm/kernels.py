"""Vectorised work on batches of UTF-8 texts inside Spark's Arrow tasks.

A batch is one flat byte array plus offsets. Words are spans of it, hashed with
XXH64 by numpy, so no Python object is made for a word. Peak memory is a small
multiple of ``CHUNK_BYTES``, or of one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
MASK64 = (1 << 64) - 1

_codes = np.arange(256)
#: Letters, digits and everything that isn't ASCII.
WORD = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes | 0x20 >= 0x61) & (_codes | 0x20 <= 0x7A) & (_codes >= 0x41) & (_codes < 0x80)) | (_codes >= 0x80)
#: Everything but ASCII white space.
TOKEN = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)


@dataclass
class Words:
    """Words of a run of texts: lower-cased (A-Z) bytes with one space after each word, and spans."""

    data: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    first: np.ndarray  # of each text, its first word; one more than texts

    def text(self, a: int, b: int) -> str:
        """Words a to b - 1 of one text, joined by spaces."""
        return self.data[self.starts[a] : self.starts[b - 1] + self.lens[b - 1]].tobytes().decode("utf-8", "replace") if b > a else ""


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``size`` bytes of text."""
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of ``kind`` within each text."""
    n = len(data)
    inside = kind[data]
    heads = offsets[:-1][offsets[:-1] < n]
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    start[heads] = inside[heads]
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    lens = ends - starts
    first = np.searchsorted(starts, offsets)
    keep = inside.copy()
    after = ends[ends < n]
    keep[after] = True
    compact = LOWER[data[keep]]
    gap = np.zeros(len(ends), np.int64)
    gap[: len(ends)] = (ends < n) & ~inside[np.minimum(ends, max(n - 1, 0))] if n else 0
    begin = np.zeros(len(starts), np.int64)
    if len(starts):
        np.cumsum((lens + gap)[:-1], out=begin[1:])
        compact[(begin + lens)[gap > 0]] = 0x20
    return Words(compact, begin, lens, first)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotate(acc + lane * np.uint64(P2), 31) * np.uint64(P1)


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span, one vectorised pass for each distinct length."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lane8 = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    lane4 = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    small = lens.astype(np.uint16) if lens.max() < 65536 else lens
    order = np.argsort(small, kind="stable")
    bounds = np.flatnonzero(np.diff(small[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, bounds):
            size, at = int(lens[rows[0]]), starts[rows].astype(np.int64)
            pos = 0
            if size >= 32:
                v = [np.full(len(rows), (seed + d) & MASK64, np.uint64) for d in (P1 + P2, P2, 0, -P1)]
                while pos + 32 <= size:
                    for i in range(4):
                        v[i] = _round(v[i], lane8[at + (pos + 8 * i)])
                    pos += 32
                acc = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
                for x in v:
                    acc = (acc ^ _round(np.zeros_like(x), x)) * np.uint64(P1) + np.uint64(P4)
            else:
                acc = np.full(len(rows), (seed + P5) & MASK64, np.uint64)
            acc = acc + np.uint64(size)
            while pos + 8 <= size:
                acc = _rotate(acc ^ _round(np.zeros_like(acc), lane8[at + pos]), 27) * np.uint64(P1) + np.uint64(P4)
                pos += 8
            if pos + 4 <= size:
                acc = _rotate(acc ^ (lane4[at + pos].astype(np.uint64) * np.uint64(P1)), 23) * np.uint64(P2) + np.uint64(P3)
                pos += 4
            while pos < size:
                acc = _rotate(acc ^ (padded[at + pos].astype(np.uint64) * np.uint64(P5)), 11) * np.uint64(P1)
                pos += 1
            acc ^= acc >> np.uint64(33)
            acc *= np.uint64(P2)
            acc ^= acc >> np.uint64(29)
            acc *= np.uint64(P3)
            acc ^= acc >> np.uint64(32)
            out[rows] = acc
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(P2)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(P3)
        return x ^ (x >> np.uint64(32))


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive word hashes; runs may cross texts, callers mask those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k * P3 & MASK64, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix(acc * np.uint64(P1) + hashes[j : j + n])
    return acc


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set; a true answer can be wrong, a false one can't."""
    bit = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
