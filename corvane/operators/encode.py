"""Vectors of texts: an encoder is any function from a list of token lists to a matrix, or a ``TokenEncoder``.

The encoders that ship are a hashed bag of words and a linear mix of token codes, so that
everything runs without a model; neural ones have the same shapes. One is made once a task, by its factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed, tokens, windows

Encoder = Callable[[list[list[str]]], np.ndarray]
BATCH = 256
LIMIT = 510
#: Places of a padded run.
PADDED = 1 << 15
#: Words that are Python objects at once, on top of one text's; a batch of Spark's may hold many times as many.
WORDS = 1 << 18


def hashed_encoder(dim: int = 64) -> Encoder:
    """Signed hashed counts of lower-cased tokens; no tokens give zeros."""

    def encode(texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, words in enumerate(texts):
            for w in words:
                h = crc32(w.lower().encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return encode


def pooled(states: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """A vector for each text of token states: the first token's (``cls``), or the mean of those that the mask has."""
    if pooling == "cls":
        return states[:, 0]
    m = mask[:, :, None].astype(states.dtype)
    return (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


class TokenEncoder(Protocol):
    """States of tokens in padded batches, as transformers give them.

    ``first`` and ``last`` are the ids of the marks around a text, None where there are none.
    """

    first: int | None
    last: int | None
    pad: int

    def ids(self, words: list[str]) -> list[int]: ...

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Texts x places x dimensions, of ids and a mask of the places that count."""
        ...


class LinearEncoder:
    """A token's state is its own code plus the mean code of its text, marks included, so that pooling by the first token reads the whole text.

    A code is what is left of an id by each of a few divisors; an id is made of a word's first letter and its length.
    """

    first, last, pad = 2, 1, 0
    DIVISORS = (5, 7, 11, 13)

    def ids(self, words: list[str]) -> list[int]:
        return [64 * ord(w[0]) + min(len(w), 63) for w in words]

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        codes = np.stack([ids % d for d in self.DIVISORS], axis=2).astype(np.float64)
        return codes + pooled(codes, mask, "mean")[:, None, :]


def padded_runs(sizes: np.ndarray, most: int = PADDED, rows: int = BATCH) -> Iterator[np.ndarray]:
    """Rows in the order of their sizes, in runs that hold ``most`` places at most when padded (or one row)."""
    order, a = np.argsort(sizes, kind="stable"), 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < rows and (b + 1 - a) * sizes[order[b]] <= most:
            b += 1
        yield order[a:b]
        a = b


def slices(batch: pa.RecordBatch, words: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that have about ``WORDS`` words together."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.flatnonzero(np.diff((np.cumsum(sizes + 1) - 1) // WORDS)) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def encode_states(df: DataFrame, words: str, factory: Callable[[], TokenEncoder], pooling: str = "pooling", out: str = "v") -> DataFrame:
    """The rows with ``out``, unit vectors of the token arrays in ``words``, pooled as the column ``pooling`` says (``cls`` or ``mean``).

    A batch is worked on in ``slices``. Texts get the encoder's marks, and those of about one length are padded to the longest of their
    run, so that little is computed for padding; the mask keeps padding out of the means.
    """
    names = [c for c in df.columns if c != words]

    def run(batches):
        model = factory()
        lead, tail = ([m] if m is not None else [] for m in (model.first, model.last))
        for batch in (part for whole in batches for part in slices(whole, words)):
            seqs = [lead + model.ids(w or []) + tail for w in batch.column(words).to_pylist()]
            kinds, sizes = batch.column(pooling).to_pylist(), np.array([len(x) for x in seqs], np.int64)
            v = None
            for kind in sorted(set(kinds)):
                mine = np.flatnonzero([k == kind for k in kinds])
                for part in padded_runs(sizes[mine]):
                    rows = mine[part]
                    mask = np.arange(max(1, sizes[rows].max())) < sizes[rows, None]
                    ids = np.full(mask.shape, model.pad, np.int64)
                    ids[mask] = [i for r in rows for i in seqs[r]]
                    x = pooled(model.states(ids, mask), mask, kind)
                    v = np.zeros((batch.num_rows, x.shape[1])) if v is None else v
                    v[rows] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            if v is not None:
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.float32).reshape(-1)))
                yield pa.record_batch([batch.column(n) for n in names] + [cells], [*names, out])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != words)
    return df.mapInArrow(run, f"{kind}, `{out}` array<float>")


def encode(df: DataFrame, words: str, factory: Callable[[], Encoder], out: str = "v") -> DataFrame:
    """The rows with ``out``, unit vectors of the token arrays in ``words``."""
    names = [c for c in df.columns if c != words]

    def run(batches):
        model = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                v = model([w or [] for w in part.column(words).to_pylist()]).astype(np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1)))
                yield pa.record_batch([part.column(n) for n in names] + [cells], [*names, out])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != words)
    return df.mapInArrow(run, f"{kind}, `{out}` array<float>")


def embed(items: DataFrame, models: DataFrame, factory: Callable[[], Encoder | TokenEncoder], limit: int = LIMIT, token_states: bool = False) -> tuple[DataFrame, DataFrame]:
    """Query vectors and window vectors of ``site, genre, doc_idx, query, target`` items for each model of ``model, q_prefix, d_prefix``.

    Queries are cut at ``limit`` tokens; targets are cut into windows, the prefix
    being in the first only; a target without tokens, even of a prefix, has none.
    With ``token_states`` the factory's are token encoders, pooled as the column ``pooling`` of ``models`` says.
    """
    pooling = ["pooling"] * token_states
    each = items.crossJoin(F.broadcast(models.select("model", "q_prefix", "d_prefix", *pooling)))  # a row for each model of the panel
    keys = ["site", "genre", "model", "doc_idx", *pooling]
    q = each.select(*keys, F.slice(tokens(F.concat("q_prefix", "query")), 1, limit).alias("words"))
    d = computed(each, tokens=tokens(F.concat("d_prefix", "target"))).select(*keys, F.posexplode(windows(F.col("tokens"))).alias("chunk_no", "words"))
    if pooling:
        return encode_states(q, "words", factory).drop("pooling"), encode_states(d, "words", factory).drop("pooling")
    return encode(q, "words", factory), encode(d, "words", factory)
