"""A counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their first bytes. Where a labelled
text mentions an identity term, the terms of its sentences are swapped for others,
and training penalises the squared change of the score, so a neutral mention of a
group carries no weight of its own. Features are 64-bit hashes; those whose
association with the label is significant over the training rows are kept, all of them.
Training rows are a bounded sample of the labelled documents: the ``MAX_ROWS`` distinct
texts of the smallest hashes of id and text; scoring covers all texts. At most as many
features as those texts have words reach the driver, however many rows repeat them.

Edge cases: null and empty texts have no features and get the score of the bias;
texts of any length are scored whole; repeated rows give a row each, and are one training
row; there are no ties, as a sample goes by hashes of what it holds; null ids are kept, and count as held out or not by
the crc of the empty text; labels that are null or of unknown documents are left
out, ones that contradict each other count as toxic; extra columns are ignored;
without labels every score is low; no documents give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import held_out_bucket, mapped_rows, materialize

THRESHOLD = 0.3
MAX_ROWS = 20_000
LEAST_ROWS = 4
SIGNIFICANT = 12.0
L2 = 2e-5
FAIRNESS = 1.0
PREFIXES = (4, 5)
FOLDS, HELD_OUT = 4, 2

# Terms for groups of people, in four languages.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists catholics protestants blacks whites asians africans "
    "europeans americans mexicans arabs indians chinese gays lesbians immigrants refugees disabled elderly teenagers "
    "frauen männer muslime christen juden ausländer flüchtlinge femmes hommes musulmans chrétiens juifs immigrés "
    "mujeres hombres musulmanes cristianos judíos inmigrantes refugiados"
).split()


def _bitmap(keys: np.ndarray, size: int = 1 << 15) -> np.ndarray:
    out = np.zeros(size, np.uint8)
    bit = keys & np.uint64(size * 8 - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7))).astype(np.uint8))
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word and of each word's first bytes, repeats included."""
    w = K.words(data, offsets, K.WORD)
    of_text = K.owner(w.first)
    hashes, texts = [K.xxh64(w.data, w.starts, w.lens, 1)], [of_text]
    for size in PREFIXES:
        longer = w.lens > size
        hashes.append(K.xxh64(w.data, w.starts[longer], np.full(int(longer.sum()), size), 100 + size))
        texts.append(of_text[longer])
    return np.concatenate(texts), np.concatenate(hashes)


def swap_terms(text: str, terms: list[str] = IDENTITY_TERMS, pattern: re.Pattern | None = None) -> str:
    """The text with each identity term replaced by the next one, sentence by sentence."""
    pattern = pattern or re.compile(r"\b(" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE)
    following = dict(zip(terms, [*terms[1:], terms[0]], strict=True))
    return "".join(pattern.sub(lambda m: following[m[0].lower()], s) for s in re.split(r"(?<=[.!?\n])", text))


def _new(batches, seen: set):
    """The rows whose id and hash of the text haven't come in this task."""
    for batch in batches:
        keep = []
        for key in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _examples(terms):
    def run(batches):
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE)
        seen = set()  # of a sample of max_rows documents
        for rows, data, offsets in K.chunks(_new(batches, seen)):
            texts = rows.column("text").to_pylist()
            swapped = [swap_terms(t, terms, pattern) if t and pattern.search(t) else "" for t in texts]
            sets = []
            for d, o in ((data, offsets), K.flat(pa.array(swapped, pa.string()))):
                t, h = features(d, o)
                order = np.lexsort((h, t))
                t, h = t[order], h[order]
                new = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])) if len(t) else np.zeros(0, bool)
                t, h = t[new], h[new]
                sets.append([x.view(np.int64) for x in np.split(h, np.searchsorted(t, np.arange(1, rows.num_rows)))])
            kind = pa.list_(pa.int64())
            yield pa.record_batch([*(rows.column(c) for c in ("doc_id", "h", "toxic")), pa.array(sets[0], kind), pa.array([s if w else None for s, w in zip(sets[1], swapped, strict=True)], kind)], ["doc_id", "h", "toxic", "have", "swapped"])

    return run


class Model:
    """Sorted 64-bit feature hashes, their weights, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = np.full(len(offsets) - 1, self.bias)
        if len(self.keys):
            text, hashes = features(data, offsets)
            maybe = K.in_bitmap(_bitmap(self.keys), hashes)
            text, hashes = text[maybe], hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            one = np.unique(text[hit] * len(self.keys) + at[hit])
            np.add.at(logit, one // len(self.keys), self.weights[one % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _descend(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], size: int, l2: float, fairness: float, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, plus the mean squared score change of the swapped texts."""
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    plus = [(i, f, 1.0) for i, (_, s) in enumerate(swaps) for f in s] + [(i, f, -1.0) for i, (r, _) in enumerate(swaps) for f in rows[r]]
    pair, pair_col, sign = (np.array(x) for x in zip(*plus, strict=True)) if plus else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    n, w = max(1, len(rows)), np.zeros(size + 1)
    w[-1] = np.log((labels.sum() + 0.1) / ((1 - labels).sum() + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1 if len(rows) else 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + w[-1], -30, 30)))
        miss = (p - labels) / n
        g = np.append(np.bincount(col, miss[row], size), miss.sum())
        if len(swaps):
            change = np.bincount(pair, w[pair_col] * sign, len(swaps))
            g[:-1] += 2 * fairness / len(swaps) * np.bincount(pair_col, change[pair] * sign, size)
        g[:-1] += 2 * l2 * w[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, fairness: float = FAIRNESS, l2: float = L2, terms: list[str] = IDENTITY_TERMS) -> Model:
    """Fit on at most ``max_rows`` distinct labelled documents outside the held-out fold."""
    label = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(held_out_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keys = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).distinct()
    sample = materialize(keys.join(label, "doc_id").orderBy("h", "doc_id").limit(max_rows), "labelled")  # at most max_rows rows of three numbers
    rows = texts.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(sample), ["doc_id", "h"])
    examples = materialize(rows.select("doc_id", "h", "toxic", "text").mapInArrow(_examples(tuple(terms)), "doc_id long, h long, toxic int, have array<long>, swapped array<long>"), "examples")
    if examples.count() > examples.select("doc_id", "h").distinct().count():  # copies in several tasks; the others needn't be shuffled
        examples = materialize(examples.dropDuplicates(["doc_id", "h"]), "examples")
    totals = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1")).first()
    n, n1 = float(totals["n"]), float(totals["n1"])
    seen = examples.select("toxic", F.explode("have").alias("f")).groupBy("f").agg(F.count("*").alias("a"), F.sum("toxic").alias("k")).where(F.col("a") >= LEAST_ROWS)
    part = lambda k, a: F.when(k > 0, k * F.log(k / a)).otherwise(0.0)
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    rest, rest1 = F.lit(n) - a, F.lit(n1) - k
    g2 = 2 * (part(k, a) + part(a - k, a) + part(rest1, rest) + part(rest - rest1, rest) - (n1 * np.log(n1 / n) if n1 else 0.0) - ((n - n1) * np.log((n - n1) / n) if n > n1 else 0.0)) if n else F.lit(0.0)
    chosen = seen.withColumn("g2", g2).where(F.col("g2") > SIGNIFICANT).select("f").collect()  # features of max_rows texts that occur in several
    keys = np.sort(np.array([r.f for r in chosen], np.int64).view(np.uint64))

    def kept(batches):  # lists are cut to the chosen features before they leave the tasks
        for batch in batches:
            out = []
            for name in ("have", "swapped"):
                lists = []
                for x in batch.column(name):
                    if not x.is_valid:
                        lists.append(None)
                        continue
                    h = np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                    lists.append(at[keys[at] == h].astype(np.int32) if len(keys) else np.zeros(0, np.int32))
                out.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.record_batch([batch.column("toxic"), *out], ["toxic", "have", "swapped"])

    data = examples.mapInArrow(kept, "toxic int, have array<int>, swapped array<int>").toArrow()  # max_rows rows at most
    have = [np.array(x, np.int64) for x in data["have"].to_pylist()]
    swaps = [(i, np.array(x, np.int64)) for i, x in enumerate(data["swapped"].to_pylist()) if x is not None]
    weights, bias = _descend(have, np.array(data["toxic"].to_pylist(), float), swaps, len(keys), l2, fairness)
    return Model(keys, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""

    def run(batches):
        for rows, data, offsets in K.chunks(batches):
            yield pa.record_batch([rows.column("doc_id"), pa.array(model.score(data, offsets))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (held_out_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is under the threshold."""

    def run(batches):
        for rows, data, offsets in K.chunks(batches):
            yield rows.filter(pa.array(model.score(data, offsets) < threshold))

    return mapped_rows(docs, run)
