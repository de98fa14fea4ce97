"""Alignment of two tokenizers: which tokens of the one end where tokens of the other do, and how often.

A space and the text are tokenized by byte-level BPE (A) and by a sentence-piece model (B,
which adds the space itself). Where both tokens end at a byte, the tokens before form a group
of either side, and the two that end there are linked. A link's id pair is one packed
int64, B's id above A's, so that sorting by it sorts by B, then A.

Counts of pairs: each task sorts the keys of its documents and gives ``np.unique`` partial
counts; these are range-partitioned by key and sorted within, and each task adds up runs of
equal keys as they stream by. So a pair in every document is as many rows as there were partial counts,
never as many as it has links. Each range becomes a shard: two flat files of sorted keys and
counts in the shared folder. Documents look their keys up with ``searchsorted`` on the
memory-mapped shards, so a task holds no table of pairs: the pages it touches are the
operating system's cache, shared by all tasks of a machine. What the driver sees is a line for each
shard and the highest count of each B id, which the vocabulary bounds.

Where the shared folder is no mounted file system, shards are read through Arrow's file systems
into an unlinked scratch file of the task, and mapped from there.

Edge cases: texts that are null, empty, or don't come back from either tokenizer byte by byte
(such as those holding U+2581, which stands for a space in B) have no tokens, zeros and an
empty digest; special tokens' strings are plain text; texts of any length are tokenized
whole; counts that tie for the highest of a B id all count as highest; repeated rows count
each; null ids are kept; extra columns are ignored, whatever their names; no documents
give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import packing
from .tables import materialize, shared_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CHUNK_BYTES = 1 << 20
#: Keys of a task that are counted at once, and partial counts that it keeps before it hands them on.
SORTED_KEYS, KEPT_COUNTS = 1 << 20, 1 << 20
#: Partial counts to a shard, and the most shards: beyond, shards grow instead.
SHARD_COUNTS, MOST_SHARDS = 1 << 20, 4096
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"
DIGITS = 7


# --- tokens and groups


@functools.cache
def _byte_bpe(path: str) -> list[bytes]:
    """Bytes of each id of the ranks."""
    known = {i: b for b, i in packing._fast(path)._mergeable_ranks.items()}
    return [known.get(i, b"") for i in range(max(known) + 1)]


@functools.cache
def _pieces(path: str):
    """The sentence-piece model, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def byte_tokens(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    """A's ids, with special tokens' strings as plain text."""
    try:
        return packing._fast(ranks).encode_to_numpy(text, disallowed_special=())
    except BaseException as e:  # the library's own panic at extreme runs isn't an Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
    return np.array(_plain(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def _plain(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return own


@functools.cache
def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``n``, left-aligned with room for a mark behind, and how many there are."""
    size = np.char.str_len(np.arange(n).astype(str))
    return np.array([str(i).ljust(DIGITS).encode() for i in range(n)], f"S{DIGITS}").view(np.uint8).reshape(n, DIGITS), size


def _groups(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, first_link: np.ndarray, first_token: np.ndarray, most: int) -> list[str]:
    """A digest for each document of ``a1,a2|b1;a3|b2,b3``, where ``at_a`` and ``at_b`` are the last tokens of each group."""
    digits, sizes = _decimal(most)
    group_a, group_b = np.searchsorted(at_a, np.arange(len(a))), np.searchsorted(at_b, np.arange(len(b)))
    place_a = np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]
    place_b = np.arange(len(b)) + (at_a + 1)[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[at_a]], mark[place_b[at_b]] = ord("|"), ord(";")
    chars, size = digits[ids], sizes[ids]
    chars[np.arange(len(ids)), size] = mark
    flat = chars[np.arange(DIGITS) <= size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    cut = ends[first_token]
    return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _aligned(vocabulary: str, ranks: str, pieces: str):
    def run(batches):
        bytes_a, (model, bytes_b) = _byte_bpe(ranks), _pieces(pieces)
        size_a, size_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        most = max(len(bytes_a), len(bytes_b))
        for rows, _, _ in K.chunks(batches, size=CHUNK_BYTES):
            texts = rows.column("text").to_pylist()
            live = [i for i, t in enumerate(texts) if t]
            n_a, n_b, of_a, of_b, widths = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], [], np.zeros(len(texts), np.int64)
            for i, y in zip(live, model.encode([texts[i] for i in live], num_threads=1) if live else [], strict=True):
                whole = " " + texts[i]
                x, raw = byte_tokens(whole, vocabulary, ranks), whole.encode()
                if b"".join(map(bytes_a.__getitem__, x.tolist())) == raw and b"".join(map(bytes_b.__getitem__, y)) == raw:
                    n_a[i], n_b[i], widths[i] = len(x), len(y), len(raw)
                    of_a.append(x)
                    of_b.append(np.array(y, np.int64))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (of_a, of_b))
            ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])  # documents end together, so these run on from one to the next
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
            links = np.concatenate([[0], np.searchsorted(common, np.cumsum(widths), "right")])
            digests = _groups(a, b, at_a, at_b, links, np.concatenate([[0], np.cumsum(n_a + n_b)]), most)
            cells = pa.ListArray.from_arrays(pa.array(links, pa.int32()), pa.array((b[at_b] << 32) | a[at_a]))
            yield pa.record_batch([rows.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(np.diff(links)), pa.array(digests, pa.string()), cells], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


def align(docs: DataFrame, vocabulary: str = BYTE_BPE, ranks: str = BYTE_RANKS, pieces: str = PIECES) -> DataFrame:
    """Tokens, groups, the groups' digest and the packed id pairs of the links of each document, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_aligned(vocabulary, ranks, pieces), ALIGNED)


# --- counts of pairs


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _partial(batches):
    """Links to partial counts."""
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        keys = batch.column("links").flatten().to_numpy()
        for at in range(0, len(keys), SORTED_KEYS):
            found = np.unique(keys[at : at + SORTED_KEYS], return_counts=True)
            kept = _merged(*(np.concatenate(x) for x in zip(kept, found, strict=True)))
            if len(kept[0]) > KEPT_COUNTS:
                yield pa.record_batch([pa.array(x) for x in kept], ["key", "n"])
                kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    yield pa.record_batch([pa.array(x) for x in kept], ["key", "n"])


def _local(path: str) -> str | None:
    """The path on this machine of a mounted folder, or None where it is in another store."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") else None


def _store(path: str):
    """The file system of a path in another store, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _create(path: str):
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    store, inner = _store(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


@functools.lru_cache(maxsize=2 * MOST_SHARDS)
def mapped(path: str) -> np.ndarray:
    """The longs of a shard's file, memory-mapped."""
    local = _local(path)
    if local:
        return np.memmap(local, "<i8", "r")
    store, inner = _store(path)
    with tempfile.TemporaryFile() as f, store.open_input_stream(inner) as source:
        while piece := source.read(1 << 24):
            f.write(piece)
        f.flush()
        return np.memmap(f, "<i8", "r")


def _shards(folder: str):
    """Sorted partial counts to one shard: files of keys and of counts, and a row that tells of it and of each B id's highest count."""

    def run(batches):
        path = f"{folder}/{uuid.uuid4().hex}"  # of this attempt alone, so a task that runs again harms nothing
        keys_file = counts_file = None
        first, n, tops = 0, 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        last = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the run that may go on

        def put(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal keys_file, counts_file, first, n, tops
            if not len(keys):
                return
            if keys_file is None:
                keys_file, counts_file, first = _create(path + ".keys"), _create(path + ".counts"), int(keys[0])
            keys_file.write(keys.astype("<i8").tobytes())
            counts_file.write(counts.astype("<i8").tobytes())
            n += len(keys)
            ids = keys >> 32
            begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, most = np.concatenate([tops[0], ids[begin]]), np.concatenate([tops[1], np.maximum.reduceat(counts, begin)])
            if len(tops[0]) and ids[len(tops[0]) - 1] == ids[len(tops[0])]:
                at = len(tops[0])
                most[at] = max(most[at], most[at - 1])
                ids, most = np.delete(ids, at - 1), np.delete(most, at - 1)
            tops = ids, most

        for batch in batches:
            if batch.num_rows:
                keys, counts = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(last, ("key", "n"), strict=True))
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, counts = keys[begin], np.add.reduceat(counts, begin)
                put(keys[:-1], counts[:-1])
                last = keys[-1:], counts[-1:]
        put(*last)
        if n:
            keys_file.close()
            counts_file.close()
            yield pa.record_batch([pa.array([path]), pa.array([first]), pa.array([n]), pa.array([tops[0]], pa.list_(pa.int64())), pa.array([tops[1]], pa.list_(pa.int64()))], ["path", "first", "n", "ids", "tops"])

    return run


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as tasks need it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``path, first, n, ids, tops``: a row for each shard of the counts of all pairs, in key order by ``first``."""
    spark = aligned.sparkSession
    partial = materialize(aligned.select("links").mapInArrow(_partial, "key long, n long"), "partial")
    shards = min(MOST_SHARDS, 1 + partial.count() // SHARD_COUNTS)
    ranges = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    folder = f"{_qualified(spark, shared_dir(spark))}/corvane-pairs-{uuid.uuid4().hex}"
    return materialize(ranges.mapInArrow(_shards(folder), "path string, first long, n long, ids array<long>, tops array<long>"), "shards")


def pair_table(shards: DataFrame) -> DataFrame:
    """``b, a, n`` of every pair, read from the shards: the table that maps one vocabulary to the other."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                keys, counts = mapped(path + ".keys"), mapped(path + ".counts")
                for at in range(0, len(keys), KEPT_COUNTS):
                    k = np.array(keys[at : at + KEPT_COUNTS])
                    yield pa.record_batch([pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(np.array(counts[at : at + KEPT_COUNTS]))], ["b", "a", "n"])

    return shards.select("path").mapInArrow(run, "b long, a long, n long")


def _looked_up(firsts: np.ndarray, paths: list[str], top: np.ndarray):
    def counts_of(keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, each of which some shard has."""
        out = np.empty(len(keys), np.int64)
        cuts = [*np.searchsorted(keys, firsts).tolist(), len(keys)]
        for path, a, b in zip(paths, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                out[a:b] = mapped(path + ".counts")[np.searchsorted(mapped(path + ".keys"), keys[a:b])]
        return out

    def run(batches):
        for batch in batches:
            lists = batch.column("links")
            cuts = lists.offsets.to_numpy()
            row = 0
            while row < batch.num_rows:
                end = min(batch.num_rows, max(row + 1, int(np.searchsorted(cuts, cuts[row] + SORTED_KEYS, "right")) - 1))
                part = batch.slice(row, end - row)
                offsets = cuts[row : end + 1] - cuts[row]
                keys, back = np.unique(part.column("links").flatten().to_numpy(), return_inverse=True)
                n = counts_of(keys)
                each, best = n[back], (n == top[keys >> 32])[back].astype(np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (best, each)]
                yield pa.record_batch([part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(np.diff(offsets).astype(np.int64)), *(pa.array(np.diff(x)) for x in sums), part.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
                row = end

    return run


def score(docs: DataFrame, vocabulary: str = BYTE_BPE, ranks: str = BYTE_RANKS, pieces: str = PIECES) -> DataFrame:
    """Each document's tokens, groups and links, the links that are their B id's commonest, and the sum of the links' counts."""
    aligned = materialize(align(docs, vocabulary, ranks, pieces), "aligned", compression="zstd")
    shards = pair_counts(aligned)
    index = shards.select("path", "first").orderBy("first").collect()  # at most MOST_SHARDS rows
    highest = shards.select(F.explode(F.arrays_zip("ids", "tops")).alias("t")).groupBy("t.ids").agg(F.max("t.tops").alias("top")).collect()  # a row for each B id
    top = np.zeros(max((r["ids"] for r in highest), default=0) + 1, np.int64)
    for r in highest:
        top[r["ids"]] = r["top"]
    firsts = np.array([r["first"] for r in index], np.int64)
    return aligned.mapInArrow(_looked_up(firsts, [r["path"] for r in index], top), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
