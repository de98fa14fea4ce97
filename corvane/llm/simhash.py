"""SimHash near-duplicates by pigeonhole blocks.

The fingerprint of a text is the bitwise majority of the XXH64 (seed 42) of its
3-word shingles. A fingerprint is split into ``BLOCKS`` blocks; two that differ in
at most ``DISTANCE`` bits agree in ``BLOCKS - DISTANCE`` of them, so every such pair
shares the key made of some choice of that many blocks. Equal fingerprints are one
vertex from the start, so copies never meet each other in the join. Rows that share
a key are verified by Hamming distance; each group gives a spanning forest of its
links rather than all pairs, and a group over ``TILE`` vertices is dealt out over
tiles so that no task holds all of it. Components come from alternating star
contraction.

Edge cases: null and empty texts have no shingles and fingerprint zero, which links
like any other; fewer than three words are one shingle; texts of any length are read
whole; a bit set in exactly half of the hashes is 0; repeated rows and ids give a row each; null ids take part but are never a component's id (a component of null
ids only has a null id); extra columns are ignored; no documents give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import free_name, materialize, without

WORDS = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
TILE = 2048


def _majority(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text, the bits set in over half of its hashes."""
    out = np.zeros(texts, np.uint64)
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    for begin in range(0, texts, 512):
        a, b = np.searchsorted(text, (begin, begin + 512))
        size = min(512, texts - begin)
        base = (text[a:b] - begin) * 256
        total = np.bincount(text[a:b] - begin, minlength=size)
        for byte in range(8):
            value = ((hashes[a:b] >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            counts = np.bincount(base + value, minlength=size * 256).reshape(size, 256) @ bits
            packed = ((counts * 2 > total[:, None]) << np.arange(8)).sum(axis=1).astype(np.uint64)
            out[begin : begin + size] |= packed << np.uint64(8 * byte)
    return out


def simhashes(data: np.ndarray, offsets: np.ndarray, size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of a run of texts."""
    w = K.words(data, offsets, K.TOKEN)
    texts = len(offsets) - 1
    counts = np.diff(w.first)
    of_text = K.owner(w.first)
    begin = np.arange(len(w.starts))
    end = np.minimum(begin + size - 1, len(begin) - 1)
    whole = of_text[begin] == of_text[end] if len(begin) else np.zeros(0, bool)
    whole &= begin + size - 1 < len(begin)
    short = (counts > 0) & (counts < size)
    lead = w.first[:-1][short]
    begin, end = np.concatenate([begin[whole], lead]), np.concatenate([end[whole], (w.first[1:] - 1)[short]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    lens = w.starts[end] + w.lens[end] - w.starts[begin] if len(begin) else np.zeros(0, np.int64)
    return _majority(K.xxh64(w.data, w.starts[begin], lens, seed), of_text[begin], texts)


def _fingerprint(batches):
    for rows, data, offsets in K.chunks(batches):
        yield pa.record_batch([rows.column("doc_id"), pa.array(simhashes(data, offsets).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (the bits of a long) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of the choices of ``blocks - distance`` blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(c) for c in combinations(part, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(distance: int):
    """For each tile, links that connect what links within ``distance`` connect, no more of them than vertices."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps"):
                left = np.asarray(fps.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                while len(left) > 1:
                    reached, left = [left[0]], left[1:]
                    while reached and len(left):
                        x = reached.pop()
                        near = np.bitwise_count(left ^ x) <= distance
                        if near.any():
                            found = left[near]
                            a += [int(x.view(np.int64))] * len(found)
                            b += found.view(np.int64).tolist()
                            reached += list(found)
                            left = left[~near]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(vertices: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp``, enough of them to connect all that link."""
    masks = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(block_masks(blocks, distance))])
    keyed = vertices.select("fp", F.explode(masks).alias("k")).select("fp", "k.c", "k.m")
    shared = keyed.groupBy("c", "m").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    rows = keyed.join(shared, ["c", "m"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("c", "m", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "fp")
    grouped = tiles.groupBy("c", "m", "i", "j").agg(F.collect_list("fp").alias("fps")).select("fps")
    return grouped.mapInArrow(_forest(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, root``: for each vertex of ``a, b`` edges, the smallest vertex reachable.

    Alternating large-star and small-star steps; every round is a few joins and
    aggregations over the edges and is cut by a table in the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "edges")
    last = None
    while True:
        both = now.union(now.select(F.col("root").alias("v"), F.col("v").alias("root")))
        low = both.groupBy("v").agg(F.min("root").alias("low")).withColumn("low", F.least("v", "low"))
        large = both.join(low, "v").where(F.col("root") > F.col("v")).select(F.col("root").alias("v"), F.col("low").alias("root")).distinct()
        down = large.groupBy("v").agg(F.min("root").alias("low"))
        small = large.join(down, "v").select(F.col("root").alias("v"), F.col("low").alias("root")).where("v <> root").union(down.select("v", F.col("low").alias("root"))).distinct()
        now = materialize(small, "star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if state == last:
            return now
        last = state


def classes(rows: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``fp, low, root`` for each distinct fingerprint of ``doc_id, fp`` rows: its smallest id, and its component."""
    vertices = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(vertices, distance, blocks))
    return vertices.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of documents."""
    rows = materialize(fingerprints(docs), "fingerprints")
    of = classes(rows, distance, blocks)
    ids = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The documents, all columns, of which one of each component stays: the one of the smallest id, of equal ones the first.

    Documents are written once with row numbers, by Spark alone. Python sees ids, texts and row
    numbers; what goes is a list of row numbers, found among numbers alone.
    """
    number = free_name(docs, "row_number")
    full = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")

    def marked(batches):
        for rows, data, offsets in K.chunks(batches):
            yield pa.record_batch([rows.column("row"), rows.column("doc_id"), pa.array(simhashes(data, offsets).view(np.int64))], ["row", "doc_id", "fp"])

    texts = full.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(marked, "row long, doc_id long, fp long"), "fingerprints")
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    best = materialize(best, "vertices")
    roots = components(links(best.select("fp"), distance, blocks)).withColumnRenamed("v", "fp")
    stay = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")).select("best.row")
    gone = materialize(rows.select("row").join(stay, "row", "left_anti"), "gone")
    return without(full, gone.withColumnRenamed("row", number), number).select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
