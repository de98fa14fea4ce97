"""A quality classifier from overlapping heuristic labellers.

Each labeller votes good, bad or not at all on a document. Expectation-maximisation
estimates how often each votes what for good and for bad documents, from the counts
of vote patterns, of which there are at most three to the number of labellers. The
posterior of a document's pattern is its weak label, and weak labels of a bounded
sample (the ``MAX_ROWS`` distinct texts of the smallest hashes) train a linear scorer,
which scores every document. Its features are square roots of shares of hashed
trigrams of byte kinds, hashed runs of four bytes, and hashed words.

Edge cases: null and empty texts are voted bad for shortness and have no features;
a text of any length is one row of numbers, and is read whole; a document's answer
depends on its text alone, so repeated rows give a row each and the same answer, and
there are no ties to break; null ids are kept; extra columns are ignored; no documents
give no rows, and a model that has seen none scores one half.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MAX_ROWS = 8_000
KINDS, GRAMS, WORDS = 1024, 1024, 2048
BUCKETS = KINDS + GRAMS + WORDS
EPOCHS, BATCH = 25, 1000
L2 = 1e-4
KEEP = 0.5
LABELLERS = ("length", "capitals", "symbols", "tables", "word_size", "variety", "lines", "sentences", "runs", "echoes")
BAD, NONE, GOOD = 0, 1, 2

_code = np.arange(256)
_upper = (_code >= 0x41) & (_code <= 0x5A)
_letter = _upper | ((_code >= 0x61) & (_code <= 0x7A)) | (_code >= 0x80)
_digit = (_code >= 0x30) & (_code <= 0x39)
_space = ~K.TOKEN
_stop = np.isin(_code, np.frombuffer(b".!?", np.uint8))
_symbol = ~_letter & ~_digit & ~_space
#: Kinds of bytes: lower, upper, other letter, digit, space, line end, stop, comma, bar, other.
_kind = np.select([_upper, _code >= 0x80, _letter, _digit, _code == 0x0A, _space, _stop, _code == 0x2C, _code == 0x7C], [1, 2, 0, 3, 5, 4, 6, 7, 8], 9).astype(np.int32)


def _kinds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how many bytes of each kind it has."""
    texts = len(offsets) - 1
    of = np.repeat(np.arange(texts, dtype=np.int32) * 16, np.diff(offsets))
    return np.bincount(of + _kind[data], minlength=texts * 16).reshape(texts, 16)


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text, told apart by 44 bits."""
    texts = len(first) - 1
    keys = np.sort((K.owner(first).astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=texts)


def votes(data: np.ndarray, offsets: np.ndarray, w: K.Words, h: np.ndarray) -> np.ndarray:
    """A row of votes for each text, from its bytes and its words and their hashes."""
    n = np.diff(w.first)
    some = np.maximum(n, 1)
    share = lambda x, y: x / np.maximum(y, 1)
    kinds = _kinds(data, offsets)
    letters, ink = kinds[:, :3].sum(axis=1), kinds.sum(axis=1) - kinds[:, 4] - kinds[:, 5]
    capitals, symbols, bars = share(kinds[:, 1], letters), share(kinds[:, 6:].sum(axis=1), ink), share(kinds[:, 8], ink)
    size = share(_sums(w.lens, w.first), some)
    variety = share(_distinct(h, w.first), some)
    line_kind = np.ones(256, bool)
    line_kind[0x0A] = False
    lines = K.words(data, offsets, line_kind)
    n_lines = np.diff(lines.first)
    ends = lines.starts + lines.lens
    crc = np.fromiter((crc32(lines.data[a:b]) for a, b in zip(lines.starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
    repeated = 1 - share(_distinct(K.mix(crc), lines.first), n_lines)
    same = np.flatnonzero((data[2:] == data[1:-1]) & (data[2:] == data[:-2]))
    same = same[_symbol[data[same]]]
    text_of = np.searchsorted(offsets, same, "right") - 1
    same = same[same + 2 < offsets[text_of + 1]]  # a run ends with its text
    runs = share(np.diff(np.searchsorted(same, offsets)), some)
    echo = np.append(h[1:] == h[:-1], False)[: len(h)]
    echo[w.first[1:][n > 0] - 1] = False  # the last word of a text has none after it
    echoes = share(_sums(echo, w.first), some)
    stops = share(kinds[:, 6], some)
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    never = np.zeros(len(n), bool)
    return np.stack(
        [
            pick(n < 1, n >= 20),
            pick((capitals > 0.3) & (n >= 4), capitals < 0.12),
            pick((symbols > 0.15) & (n >= 10), symbols < 0.08),
            pick((bars > 0.02) & (n >= 10), never),
            pick(((size < 2.5) | (size > 14)) & (n >= 10), (size >= 3) & (size <= 10)),
            pick((variety < 0.2) & (n >= 50), variety > 0.35),
            pick((repeated > 0.3) & (n_lines >= 4), (repeated < 0.15) & (n_lines >= 2)),
            pick((stops < 0.01) & (n >= 20) | (stops > 0.6), (stops >= 0.02) & (stops <= 0.4)),
            pick((runs > 0.1) & (n >= 10), runs == 0),
            pick((echoes > 0.1) & (n >= 10), echoes < 0.02),
        ],
        axis=1,
    )


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
    w = K.words(data, offsets, K.WORD)
    return w, K.xxh64(w.data, w.starts, w.lens)


def _within(offsets: np.ndarray, size: int) -> np.ndarray:
    """Of the runs of ``size`` bytes, which lie in one text."""
    keep = np.ones(max(0, int(offsets[-1]) - size + 1), bool)
    for back in range(1, size):
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    return keep


def _shares(of: np.ndarray, bucket: np.ndarray, texts: int, buckets: int) -> np.ndarray:
    counts = np.bincount(of * buckets + bucket, minlength=texts * buckets).reshape(texts, buckets).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def features(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, square roots of the shares of its hashed features, kind by kind."""
    texts = len(offsets) - 1
    of = np.repeat(np.arange(texts, dtype=np.int32), np.diff(offsets))
    k = _kind[data]
    three, four = _within(offsets, 3), _within(offsets, 4)
    kinds = ((k[:-2] * 100 + k[1:-1] * 10 + k[2:]) % KINDS)[three] if len(three) else np.zeros(0, np.int32)
    low = np.append(K.LOWER[data], np.zeros(4, np.uint8))
    grams = np.ndarray((len(four),), "<u4", low, 0, (1,))[four] * np.uint32(0x9E3779B1) >> np.uint32(16)
    words = (hashes >> np.uint64(30)).astype(np.int32) % WORDS
    return np.concatenate([_shares(of[: len(three)][three], kinds, texts, KINDS), _shares(of[: len(four)][four], grams.astype(np.int32) % GRAMS, texts, GRAMS), _shares(K.owner(first).astype(np.int32), words, texts, WORDS)], axis=1)


def _in_groups(data: np.ndarray, offsets: np.ndarray, w: K.Words, h: np.ndarray, size: int = 256):
    """Features of up to ``size`` texts at a time, which bounds the matrix."""
    for i in range(0, len(offsets) - 1, size):
        j = min(i + size, len(offsets) - 1)
        yield features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], h[w.first[i] : w.first[j]], w.first[i : j + 1] - w.first[i])


PLACE = 3 ** np.arange(len(LABELLERS))


def _patterns(batches):
    for _, data, offsets in K.chunks(batches):
        yield pa.record_batch([pa.array((votes(data, offsets, *_word_hashes(data, offsets)) * PLACE).sum(axis=1).astype(np.int64))], ["pattern"])


def _examples(batches):
    """Hash, vote pattern, and the places and values of the features that aren't zero."""
    for rows, data, offsets in K.chunks(batches):
        w, h = _word_hashes(data, offsets)
        pattern = pa.array((votes(data, offsets, w, h) * PLACE).sum(axis=1).astype(np.int64))
        at, values = [], []
        for group in _in_groups(data, offsets, w, h):
            for x in group:
                some = np.flatnonzero(x)
                at.append(some.astype("<u2").tobytes())
                values.append(x[some].astype("<f2").tobytes())
        yield pa.record_batch([rows.column("h"), pattern, pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["h", "pattern", "at", "values"])


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: each pattern's probability of good, and ``rates[labeller, class, vote]``."""
    v = (patterns[:, None] // PLACE) % 3
    good = np.where((v == BAD).any(axis=1), 0.1, 0.95)  # labellers look for different faults, so one that finds any is believed at first
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)
    rates = np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(steps):
        weight = np.stack([(1 - good) * counts, good * counts])
        rates = np.einsum("cp,pjv->jcv", weight, one_hot) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        log = np.einsum("pjv,jcv->pc", one_hot, np.log(rates)) + np.log(prior)
        after = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(after - good).max(initial=0) < 1e-6:
            break
        good = after
    return good, rates


class Model:
    def __init__(self, weights: np.ndarray, bias: float, posterior: dict[int, float]):
        self.weights, self.bias, self.posterior = weights, bias, posterior


def _descend(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, l2: float = L2) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss of one batch after another, in single precision; rows come in the order of their hashes."""
    w, b, y = np.zeros(x.shape[1], np.float32), 0.0, y.astype(np.float32)
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    steps = epochs * -(-len(x) // batch)
    for step in range(steps):
        at = step * batch % (-(-len(x) // batch) * batch)
        part, want = x[at : at + batch], y[at : at + batch]
        miss = 1 / (1 + np.exp(-np.clip(part @ w + np.float32(b), -30, 30))) - want
        g = np.append(part.T @ miss / len(part) + l2 * w, miss.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = 0.1 * (1 - step / steps) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.999 ** (step + 1))) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w, b


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Estimate the labellers over all documents, and fit the scorer on at most ``max_rows`` distinct texts."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = rows.mapInArrow(_patterns, "pattern long").groupBy("pattern").count().collect()  # 3 ** labellers rows at most
    patterns, counts = np.array([r["pattern"] for r in table], np.int64), np.array([r["count"] for r in table], float)
    good, _ = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    hashed = rows.select(F.xxhash64("text").alias("h"), "text")
    n = hashed.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 1.3 * max_rows / n) if n else 1.0  # about as many texts as are wanted, so that others aren't looked at again
    few = hashed.where(F.col("h") <= min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))).mapInArrow(_examples, "h long, pattern long, at binary, values binary")
    few = few.groupBy("h").agg(*[F.first(c).alias(c) for c in ("pattern", "at", "values")])  # copies are one example
    fit = few.orderBy("h").limit(max_rows).toArrow()  # max_rows rows at most
    x = np.zeros((fit.num_rows, BUCKETS), np.float32)
    for i, (at, values) in enumerate(zip(fit["at"].to_pylist(), fit["values"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f2")
    w, b = _descend(x, np.array([posterior[p] for p in fit["pattern"].to_pylist()], float))
    return Model(w, b, posterior)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``doc_id, n_bad, n_good, weak_label, score, keep`` for each row: votes, their posterior, and the scorer's answer."""

    def run(batches):
        for rows, data, offsets in K.chunks(batches):
            w, h = _word_hashes(data, offsets)
            v = votes(data, offsets, w, h)
            weak = [model.posterior.get(p, 0.5) for p in (v * PLACE).sum(axis=1).tolist()]
            logit = np.concatenate([(x.astype(np.float64) * model.weights).sum(axis=1) for x in _in_groups(data, offsets, w, h)]) + model.bias
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.record_batch([rows.column("doc_id"), pa.array((v == BAD).sum(axis=1)), pa.array((v == GOOD).sum(axis=1)), pa.array(weak, pa.float64()), pa.array(p.astype(float)), pa.array(p >= keep)], ["doc_id", "n_bad", "n_good", "weak_label", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bad long, n_good long, weak_label double, score double, keep boolean")
