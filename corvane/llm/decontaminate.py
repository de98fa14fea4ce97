"""Benchmark decontamination by a prefix-filtered set join.

Every item is a set of windows of ``WINDOW`` consecutive words, every window a set
of shingles of ``SHINGLE`` words. A document can contain a window only if it has
the window's rarest shingle, so that one shingle is the necessary prefix of the
join (containment 1.0 needs a prefix of one element). Rarity is the count of the
shingle over all documents. The join is on prefix shingles; the positions on both
sides give the alignment, the length bound drops alignments whose window leaves the
document, and the words around the shingle are then compared exactly.

A bitmap, whose size goes by the number of shingles up to a bound (``BITMAP_BYTES``), tells
tasks which shingles can be in the join at all. It never misses a shingle; a benchmark
too large for the bound only lets more rows through to the join.

Inputs and their edge cases: null or empty texts have no words; texts of any length are
read whole; of a window's equally rare shingles the one of the smallest hash is its
prefix, which changes no result; an item shorter
than a window is one window; an item without words has none; repeated documents
give a row each; repeated item ids count once; items with a null id still mark
words but have no id to list; extra columns are ignored; without documents the
result is empty, without items nothing is hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .tables import free_name, materialize, without

WINDOW = 13
SHINGLE = 4
#: Least and most bytes of the bitmap; two for each shingle in between.
BITMAP_BYTES = (1 << 20, 1 << 24)


def _shingles(w: K.Words, hashes: np.ndarray, size: int, of_text: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each shingle that lies within one text."""
    grams = K.ngrams(hashes, size)
    at = np.arange(len(grams))
    inside = of_text[: len(grams)] == of_text[size - 1 : size - 1 + len(grams)]
    return grams[inside], at[inside]


def _item_rows(window: int, shingle: int):
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.string()), ("pos", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("sh", pa.int64()), ("left", pa.int32()), ("around", pa.string())])

    def run(batches):
        for rows, data, offsets in K.chunks(batches):
            w = K.words(data, offsets, K.WORD)
            hashes = K.xxh64(w.data, w.starts, w.lens)
            out = {k: [] for k in schema.names}
            for i, (key, item_id) in enumerate(zip(rows.column("item").to_pylist(), rows.column("item_id").to_pylist(), strict=True)):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if a == b:
                    continue
                size = min(shingle, b - a)
                for p, sh in enumerate(K.ngrams(hashes[a:b], size).view(np.int64).tolist()):
                    left = min(p, window - size)
                    values = (key, item_id, p, size, b - a, sh, left, w.text(a + p - left, min(b, a + p + window)))
                    for name, v in zip(schema.names, values, strict=True):
                        out[name].append(v)
            yield pa.record_batch(out, schema=schema)

    return run


def item_shingles(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row for each shingle of each item: where it is, and the words that windows around it can hold."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_item_rows(window, shingle), "item long, item_id string, pos int, size int, n int, sh long, left int, around string")


def bitmap(shingles: DataFrame) -> bytes:
    """The bitmap of a shingle column ``sh``; at most ``BITMAP_BYTES[1]`` bytes, as words of 32 bits, reach the driver."""
    n = shingles.select("sh").distinct().count()
    size = 1 << int(np.clip(np.ceil(np.log2(max(1, 2 * n))), *np.log2(BITMAP_BYTES)))
    bit = F.col("sh").bitwiseAND(F.lit(size * 8 - 1))
    rows = shingles.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(sh & 31L AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size // 4, "<u4")
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype("<u4")
    return out.tobytes()


def _counter(bits: bytes, sizes: list[int]):
    def run(batches):
        member = np.frombuffer(bits, np.uint8)
        for _, data, offsets in K.chunks(batches):
            w = K.words(data, offsets, K.WORD)
            hashes, of_text = K.xxh64(w.data, w.starts, w.lens), K.owner(w.first)
            for size in sizes:
                grams, _ = _shingles(w, hashes, size, of_text, w.first)
                sh, n = np.unique(grams[K.in_bitmap(member, grams)], return_counts=True)
                yield pa.record_batch({"sh": pa.array(sh.view(np.int64)), "n": pa.array(n)})

    return run


def shingle_counts(docs: DataFrame, bits: bytes, sizes: list[int]) -> DataFrame:
    """How often each shingle that the bitmap has occurs in the documents."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(bits, sizes), "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n"))


def prefixes(shingles: DataFrame, counts: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rarest shingle of each window, each once however many windows it serves."""
    rows = shingles.join(counts.select("sh", F.col("n").alias("seen")), "sh", "left").withColumn("rank", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "sh", "pos", "size", "left", "around"))
    span = Window.partitionBy("item").orderBy("pos").rowsBetween(0, window - shingle)
    best = rows.withColumn("best", F.min("rank").over(span)).where(F.col("pos") <= F.greatest(F.col("n") - window, F.lit(0)))
    return best.select("item_id", F.least("n", F.lit(window)).alias("needs"), "best.sh", "best.pos", "best.size", "best.left", "best.around", "item").distinct().drop("item", "pos")


def _candidates(bits: bytes, sizes: list[int], window: int):
    def run(batches):
        member = np.frombuffer(bits, np.uint8)
        for rows, data, offsets in K.chunks(batches):
            w = K.words(data, offsets, K.WORD)
            hashes, of_text = K.xxh64(w.data, w.starts, w.lens), K.owner(w.first)
            found = [[] for _ in range(rows.num_rows)]
            for size in sizes:
                grams, at = _shingles(w, hashes, size, of_text, w.first)
                hit = K.in_bitmap(member, grams)
                for sh, p in zip(grams[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                    t = int(of_text[p])
                    a, b = int(w.first[t]), int(w.first[t + 1])
                    begin, end = max(a, p - (window - size)), min(b, p + window)
                    found[t].append({"sh": sh, "pos": p - a, "left": p - begin, "around": w.text(begin, end)})
            yield pa.record_batch([rows.column("rid"), rows.column("doc"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(found, pa.list_(pa.struct([("sh", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("around", pa.string())])))], ["rid", "doc", "n_words", "found"])

    return run


def _verify(batches):
    """Extend each alignment over equal words; keep those that hold a whole window."""
    for batch in batches:
        begins, ends = [], []
        d = {k: batch.column(k).to_pylist() for k in ("pos", "left", "around", "size", "needs", "item_left", "item_around")}
        for pos, left, around, size, needs, item_left, item_around in zip(*d.values(), strict=True):
            begin = end = None
            if item_around is not None and around is not None:
                mine, theirs, shift = around.split(" "), item_around.split(" "), item_left - left
                lo = left
                while lo > 0 and lo + shift > 0 and mine[lo - 1] == theirs[lo - 1 + shift]:
                    lo -= 1
                hi = left
                while hi < len(mine) and hi + shift < len(theirs) and mine[hi] == theirs[hi + shift]:
                    hi += 1
                if hi >= left + size and hi - lo >= needs:
                    begin, end = pos - left + lo, pos - left + hi
            begins.append(begin)
            ends.append(end)
        yield pa.record_batch([batch.column("rid"), batch.column("doc"), batch.column("n_words"), batch.column("item_id"), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["rid", "doc", "n_words", "item_id", "begin", "end"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: Column | None = None) -> DataFrame:
    """A row for each document: ``rid, doc_id, key, n_words, spans`` (word ranges that items cover, merged) and ``items``."""
    shingles = materialize(item_shingles(items, window, shingle), "items")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most ``shingle`` of them
    index = materialize(prefixes(shingles, shingle_counts(docs, bitmap(shingles), sizes), window, shingle), "prefixes")
    bits = bitmap(index)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if key is None else key).cast("long").alias("key")).alias("doc"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_candidates(bits, sizes, window), "rid long, doc struct<doc_id: long, key: long>, n_words long, found array<struct<sh: long, pos: int, left: int, around: string>>")
    one = found.select("rid", "doc", "n_words", F.explode_outer("found").alias("c")).select("rid", "doc", "n_words", F.coalesce("c.sh", F.xxhash64("rid")).alias("sh"), "c.pos", "c.left", "c.around")
    index = index.select("sh", "item_id", "needs", "size", F.col("left").alias("item_left"), F.col("around").alias("item_around"))
    joined = one.join(index, "sh", "left").mapInArrow(_verify, "rid long, doc struct<doc_id: long, key: long>, n_words long, item_id string, begin int, end int")
    held = F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))
    out = joined.groupBy("rid").agg(F.max("doc").alias("doc"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(held)).alias("spans"), F.array_sort(F.collect_set(F.when(F.col("begin").isNotNull(), F.col("item_id")))).alias("items"))
    return out.select("rid", "doc.doc_id", "doc.key", "n_words", merged("spans").alias("spans"), "items")


def merged(spans: str) -> Column:
    """Sorted (begin, end) ranges, with those that overlap or touch made one."""
    return F.expr(
        f"""aggregate({spans}, cast(array() as array<struct<begin:int,end:int>>), (done, x) ->
            if(size(done) > 0 and element_at(done, -1).end >= x.begin,
               concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, x.end)))),
               concat(done, array(named_struct('begin', x.begin, 'end', x.end)))))"""
    )


def decisions(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: Column | None = None) -> DataFrame:
    """Counts for each document, and whether items cover a twentieth of its words or more."""
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.begin)")
    return contamination(docs, items, window, shingle, key).select(
        "rid",
        "doc_id",
        "key",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all columns, that aren't contaminated.

    A decision depends on the text alone, so a document is told by its id and the
    hash of its text, and repeated rows share their fate.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad_id, bad_key = free_name(docs, "bad_id"), free_name(docs, "bad_key")
    bad = decisions(marked, items, window, shingle, key=text).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    return without(docs, materialize(bad, "bad"), F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (text == F.col(bad_key)))


def oracle_sql(window: int = WINDOW) -> str:
    """The decisions of the query in DuckDB's SQL, by every window of every document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    windows = "list_transform(range(0, len(words) - n + 1), lambda y: array_to_string(words[y + 1 : y + n], ' '))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
i0 AS (SELECT item_id, {words} AS words FROM benchmark),
i AS (SELECT item_id, words, least({window}, len(words)) AS n FROM i0 WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, unnest({windows}) AS win FROM i),
q AS (SELECT rid, n, unnest(range(len(words) - n + 1)) AS pos, unnest({windows}) AS win FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n),
h AS (SELECT rid, n, pos, item_id FROM q JOIN w USING (n, win)),
x AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS pos FROM h) GROUP BY rid),
s AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN x USING (rid) LEFT JOIN s USING (rid)"""
