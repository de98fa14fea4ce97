"""Scoring texts with a hashed maximum-entropy language model.

Token counts come from all training documents. The probability of a token is that
of its class given the two tokens before it, times that of the token in its class
(a class-factored softmax). Classes are bands of frequency: ``TOP_CLASSES`` of
``TOP_WIDTH`` tokens each, whose members are told apart by a softmax over a hashed
feature; wider bands of the other listed tokens, and one class of all the rest, in
which a token's probability is its share of the class. Tokens that training hasn't seen
are of that class, and are taken to be as frequent as all those seen once (Good-Turing):
a listed token seen once counts as one of its class and as an unseen one. Class features are the
token before (an n-gram), the one before that (a skip) and both together, hashed;
there are more buckets of them the more training tokens there are, up to a bound.

Training is by distributed gradients. What a feature and a class have seen together
is counted over all training documents by Spark. A gradient is that count less the
expected one, and each step moves a weight by the logarithm of their ratio times a
rate (iterative scaling). The first step, from the frequencies of classes, has its
expectations in closed form, as has the softmax in a class, of one feature; each of
``ROUNDS`` more takes them from a pass over all training documents. So a model is the
same however the documents are dealt over tasks. Tasks' sums are added up by block of
parameters, ``FAN_IN`` at a time, level by level.

The parameters, and the list of the most frequent tokens, have a bounded size and are
broadcast. Every other token is joined to the counts, so the counts are whole. Tokens
are told apart by a 64-bit hash (XXH64 with seed 42).

Edge cases: null and empty texts are the end token alone; texts of any length are read
whole; tokens of one count are listed all or none, and rank by hash; repeated rows give a
row each and count each; null ids are in the training part or not by the crc of the
empty text; extra columns are ignored; without training documents every token is
unknown and of the last class; no documents give no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import held_out_bucket, materialize

FOLDS, HELD_OUT = 10, 0
ADD = 0.1
LISTED = 1 << 18
TOP_CLASSES, TOP_WIDTH = 48, 64
BANDS = 15
CLASSES = TOP_CLASSES + BANDS + 1
#: Buckets of the features, least and most; one for so many training tokens in between.
BUCKETS = {"previous": (16, 4096), "skip": (16, 1024), "pair": (64, 32768)}
TOKENS_A_BUCKET = {"previous": 1024, "skip": 4096, "pair": 128}
INNER = 256
ROUNDS = 1
FIRST_RATES = {"previous": 0.6, "skip": 0.2, "pair": 0.6}
RATE = 0.4
#: Counts that each bucket is taken to have beforehand, dealt as the classes are.
BEFORE = 100.0
MINIBATCH = 4096
#: Exponentials of sums up to this, and of their negatives, are well within single precision.
RANGE = 80.0
BLOCK = 1 << 16
FAN_IN, LEVELS = 32, 4
#: The hash of the end token; a line feed is in no token.
END = 0x2B7A0E7B5B0F3D61


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's tokens and its end, and where each text begins."""
    w = K.words(data, offsets, K.TOKEN)
    h = K.xxh64(w.data, w.starts, w.lens)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    out[inside] = h
    return out, first


def _count(batches):
    """Counts of token hashes, summed over as many texts as keep a million distinct ones."""
    keys, counts = [], []

    def merged():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    for _, data, offsets in K.chunks(batches):
        k, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
        keys.append(k)
        counts.append(n)
        if sum(map(len, keys)) > 1 << 20:
            k, n = merged()
            keys, counts = [k], [n]
            if len(k) > 1 << 19:
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], ["h", "n"])
                keys, counts = [], []
    if keys:
        k, n = merged()
        yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], ["h", "n"])


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, n``: the count of each token hash in all of the documents, ends included."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The listed tokens in order of hash: counts, classes, places in their classes, and what their bands give them."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    place: np.ndarray
    inner: np.ndarray  # log probability in the class, for classes without a softmax
    total: int  # N
    distinct: int  # V
    rest_total: int
    unseen: float  # what tokens not seen in training are taken to weigh
    again: float  # how much more the last class weighs than listed tokens seen once and unlisted ones
    class_bias: np.ndarray
    top_bias: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def least_count(counts: DataFrame, listed: int) -> int:
    """The smallest count that at most ``listed`` tokens reach, as far as a histogram of some thousand steps tells."""
    exact = 4096
    step = F.when(F.col("n") <= exact, F.col("n")).otherwise(exact + 1 + F.floor(F.log2(F.col("n") / exact) * 64)).cast("long")
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect()  # at most exact + 64 * 64 rows
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["tokens"]
        if total > listed:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def vocabulary(counts: DataFrame, listed: int = LISTED) -> Vocabulary:
    """The most frequent tokens, dealt into classes by rank; at most ``listed`` rows reach the driver."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    top = counts.where(F.col("n") >= least_count(counts, listed)).toArrow()
    top = top.take(np.lexsort((top["h"].to_numpy(), -top["n"].to_numpy().astype(np.int64))))
    n = top["n"].to_numpy().astype(np.int64)
    rank = np.arange(len(n))
    edge = TOP_CLASSES * TOP_WIDTH
    width = max(1.0, np.log2(max(2, listed / edge))) / BANDS
    band = np.clip((np.log2(np.maximum(rank + 1, edge) / edge) / width).astype(int), 0, BANDS - 1)
    classes = np.where(rank < edge, rank // TOP_WIDTH, TOP_CLASSES + band)
    mass = np.bincount(classes, n, CLASSES)
    rest = int(sums[0]) - int(n.sum())
    unseen = max(0.5, float(sums[2]))
    mass[CLASSES - 1] = rest + unseen
    inner = np.log(n / mass[classes]) if len(n) else np.zeros(0)
    top_bias = np.full((TOP_CLASSES, TOP_WIDTH), -30.0, np.float32)
    top_bias.reshape(-1)[: min(edge, len(n))] = inner[:edge]
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    return Vocabulary(
        top["h"].to_numpy().view(np.uint64)[order], n[order], classes[order].astype(np.int16), np.where(rank < edge, rank % TOP_WIDTH, -1)[order].astype(np.int16), inner[order],
        int(sums[0]), int(sums[1]), rest, unseen, (rest + unseen) / max(0.5, rest + float((n == 1).sum())), np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES)).astype(np.float32), top_bias,
    )


FEATURES = ("previous", "skip", "pair")


class Parameters:
    """Weights by feature, of one flat vector."""

    def __init__(self, tokens: int, flat: np.ndarray | None = None, kind=np.float32):
        self.buckets = {f: 1 << int(np.clip(np.log2(max(1, tokens) / TOKENS_A_BUCKET[f]), *np.log2(BUCKETS[f]))) for f in FEATURES}
        self.shapes = {**{f: (self.buckets[f], CLASSES) for f in FEATURES}, "inner": (INNER * TOP_CLASSES, TOP_WIDTH)}
        sizes = [a * b for a, b in self.shapes.values()]
        self.flat = np.zeros(sum(sizes), kind) if flat is None else flat
        self.parts = {f: part.reshape(shape) for (f, shape), part in zip(self.shapes.items(), np.split(self.flat, np.cumsum(sizes)[:-1]), strict=True)}

    def __getitem__(self, feature: str) -> np.ndarray:
        return self.parts[feature]


def contexts(hashes: np.ndarray, first: np.ndarray, buckets: dict[str, int]) -> dict[str, np.ndarray]:
    """Feature rows of each token, from the two tokens before it (fixed values at a text's beginning)."""
    one, two = np.roll(hashes, 1), np.roll(hashes, 2)
    heads = first[:-1]
    one[heads] = 1
    two[heads] = 2
    second = heads[np.diff(first) > 1] + 1
    two[second] = 1
    one, two = K.mix(one), K.mix(two + np.uint64(77))
    with np.errstate(over="ignore"):
        both = K.mix(one * np.uint64(K.P1) + two)
    rows = {"previous": one % np.uint64(buckets["previous"]), "skip": two % np.uint64(buckets["skip"]), "pair": both % np.uint64(buckets["pair"]), "inner": (one >> np.uint64(20)) % np.uint64(INNER)}
    return {k: v.astype(np.int32) for k, v in rows.items()}


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities of each row, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log probability of one entry of each row."""
    logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return own - np.log(logits.sum(axis=1))


def _class_logits(p: Parameters, v: Vocabulary, c: dict, rows: slice) -> np.ndarray:
    out = np.take(p["previous"], c["previous"][rows], axis=0)
    out += np.take(p["skip"], c["skip"][rows], axis=0)
    out += np.take(p["pair"], c["pair"][rows], axis=0)
    out += v.class_bias
    return out


def _inner_logits(p: Parameters, v: Vocabulary, c: dict, top: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.take(p["inner"], c["inner"][top] * TOP_CLASSES + classes[top], axis=0)
    out += np.take(v.top_bias, classes[top], axis=0)
    return out


class Tables:
    """What a model gives for all tokens alike, made once: exponentials of the class weights, and logs of the probabilities inside classes.

    A context's class probabilities are products of the exponentials, and no exponential is taken for a token. Where weights could
    add up to what single precision can't hold, they are added up token by token instead.
    """

    def __init__(self, p: Parameters, v: Vocabulary):
        self.p, self.v = p, v
        most = sum(float(np.abs(p[f]).max(initial=0.0)) for f in FEATURES) + float(np.abs(v.class_bias).max())
        self.powers = {f: np.exp(p[f]) for f in FEATURES} if most < RANGE else None
        if self.powers:
            self.powers["previous"] *= np.exp(v.class_bias)

    def _weights(self, c: dict, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """What each class weighs after some tokens' contexts, and the sums of that."""
        out = np.take(self.powers["previous"], c["previous"][rows], axis=0)
        out *= np.take(self.powers["skip"], c["skip"][rows], axis=0)
        out *= np.take(self.powers["pair"], c["pair"][rows], axis=0)
        return out, out @ np.ones(CLASSES, np.float32)

    def probabilities(self, c: dict, rows: slice, times: np.ndarray) -> np.ndarray:
        """Those of each class after some tokens' contexts, each row so many times."""
        if not self.powers:
            return _softmax(_class_logits(self.p, self.v, c, rows)) * times[:, None]
        out, total = self._weights(c, rows)
        out *= (times / total)[:, None]
        return out

    def log_classes(self, c: dict, rows: slice, classes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's class."""
        if not self.powers:
            return _log_softmax_at(_class_logits(self.p, self.v, c, rows), classes)
        out, total = self._weights(c, rows)
        return np.log(out[np.arange(len(out)), classes] / total)

    @functools.cached_property
    def inside(self) -> np.ndarray:
        """Natural logs by the inner feature's bucket, class and place."""
        classes = np.tile(np.arange(TOP_CLASSES), INNER)
        logits = _inner_logits(self.p, self.v, {"inner": np.repeat(np.arange(INNER), TOP_CLASSES)}, np.arange(len(classes)), classes)
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits.reshape(INNER, TOP_CLASSES, TOP_WIDTH)


def _placed(v: Vocabulary, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and place in it where it has a softmax, -1 else."""
    if not len(v.keys):
        return np.full(len(found), CLASSES - 1), np.full(len(found), -1)
    return np.where(found >= 0, v.classes[found], CLASSES - 1).astype(np.int64), np.where(found >= 0, v.place[found], -1).astype(np.int64)


def log_probabilities(p: Parameters, v: Vocabulary, hashes: np.ndarray, first: np.ndarray, found: np.ndarray, tables: Tables | None = None) -> np.ndarray:
    """Natural log of each listed token's probability; of the others, that of their class."""
    c, tables = contexts(hashes, first, p.buckets), tables or Tables(p, v)
    classes, place = _placed(v, found)
    out = np.zeros(len(hashes))
    for a in range(0, len(hashes), MINIBATCH):
        rows = slice(a, a + MINIBATCH)
        out[rows] = tables.log_classes(c, rows, classes[rows])
    top = place >= 0
    out[top] += tables.inside[c["inner"][top], classes[top], place[top]]
    band = (found >= 0) & (place < 0)
    out[band] += v.inner[found[band]]
    return out


def seen_once(v: Vocabulary, found: np.ndarray) -> np.ndarray:
    """Which tokens are listed and were seen once."""
    return (found >= 0) & (v.counts[found] == 1) if len(v.keys) else np.zeros(len(found), bool)


def observed(p: Parameters, v: Vocabulary, hashes: np.ndarray, first: np.ndarray) -> None:
    """Adds what each feature and class, and in classes each feature and token, have seen together."""
    c, found = contexts(hashes, first, p.buckets), v.find(hashes)
    classes, place = _placed(v, found)
    once = seen_once(v, found)
    for f in FEATURES:
        at = np.concatenate([c[f] * CLASSES + classes, c[f][once] * CLASSES + CLASSES - 1])
        p[f][:] += np.bincount(at, minlength=p[f].size).reshape(p[f].shape)
    top = place >= 0
    p["inner"][:] += np.bincount((c["inner"][top] * TOP_CLASSES + classes[top]) * TOP_WIDTH + place[top], minlength=p["inner"].size).reshape(p["inner"].shape)


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the bucket ``at``: rows of one bucket are put together and added up by pairs, pairs of pairs and so on."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at, x = at[order], np.take(rows, order, axis=0)
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sizes = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, sizes)
    left = np.repeat(sizes, sizes) - place
    i, step = np.flatnonzero((place & 1 == 0) & (left > 1)), 1
    while len(i):
        x[i] += x[i + step]
        step *= 2
        i = i[(place[i] & (2 * step - 1) == 0) & (left[i] > step)]
    out[at[heads]] += x[heads]


def expected(out: Parameters, tables: Tables, hashes: np.ndarray, first: np.ndarray) -> None:
    """Adds what the model expects each feature and class to see together."""
    v, c = tables.v, contexts(hashes, first, out.buckets)
    times = 1 + seen_once(v, v.find(hashes)).astype(np.float32)
    for a in range(0, len(hashes), MINIBATCH):
        rows = slice(a, a + MINIBATCH)
        g = tables.probabilities(c, rows, times[rows])
        for f in FEATURES:
            _add_rows(out[f], c[f][rows], g)


def _sums(v: Vocabulary, flat: np.ndarray | None):
    """One task's observed counts, or its expected ones by the parameters ``flat``, by block."""

    def run(batches):
        p, out, some = Parameters(v.total, flat), Parameters(v.total, kind=np.float64), False
        tables = None if flat is None else Tables(p, v)
        for _, data, offsets in K.chunks(batches):
            hashes, first = _tokens(data, offsets)
            some = True
            observed(out, v, hashes, first) if tables is None else expected(out, tables, hashes, first)
        part = TaskContext.get().partitionId()
        for b, a in enumerate(range(0, len(out.flat), BLOCK) if some else ()):
            values = out.flat[a : a + BLOCK].astype(np.float32)
            if values.any():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["block", "part", "values"])

    return run


SUMS = "block int, part int, values binary"


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["values"].to_pylist())
    return pa.table({"block": table["block"][:1], "part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int32()), "values": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def summed(docs: DataFrame, v, flat=None) -> np.ndarray:
    """The sums of all tasks, added up ``FAN_IN`` at a time; ``v`` and ``flat`` are broadcasts. The parameters' size reaches the driver."""
    sums = docs.select("text").mapInArrow(lambda batches: _sums(v.value, None if flat is None else flat.value)(batches), SUMS)
    for _ in range(LEVELS):
        sums = sums.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("of")).applyInArrow(_added, SUMS)
    out = Parameters(v.value.total, kind=np.float64)
    for row in sums.collect():
        values = np.frombuffer(row["values"], np.float32)
        out.flat[row["block"] * BLOCK : row["block"] * BLOCK + len(values)] += values
    return out.flat


def first_step(seen: Parameters, v: Vocabulary) -> Parameters:
    """Weights after the step from the frequencies of classes; those in classes are there at once."""
    p = Parameters(v.total)
    share = _softmax(v.class_bias.astype(np.float64)[None, :])[0]
    for f in FEATURES:
        p[f][:] = FIRST_RATES[f] * np.log((seen[f] + BEFORE * share) / (seen[f].sum(axis=1, keepdims=True) * share + BEFORE * share))
    inside = np.tile(_softmax(v.top_bias.astype(np.float64)), (INNER, 1))
    p["inner"][:] = np.log((seen["inner"] + BEFORE * inside) / ((seen["inner"].sum(axis=1, keepdims=True) + BEFORE) * inside))
    return p


def next_step(p: Parameters, seen: Parameters, expects: Parameters, v: Vocabulary) -> Parameters:
    """Weights moved towards what has been seen, from what was expected."""
    out = Parameters(v.total, p.flat.copy())
    share = _softmax(v.class_bias.astype(np.float64)[None, :])[0]
    for f in FEATURES:
        out[f][:] += RATE * np.log((seen[f] + BEFORE * share) / (expects[f] + BEFORE * share))
    return out


def fit(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    """Parameters after the first step and ``rounds`` rounds over all of the documents."""
    if not len(v.keys):
        return Parameters(v.total)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(v)
    seen = Parameters(v.total, summed(docs, known))
    for f in FEATURES:
        seen[f][:, CLASSES - 1] *= v.again
    p = first_step(seen, v)
    for _ in range(rounds):
        p = next_step(p, seen, Parameters(v.total, summed(docs, known, sc.broadcast(p.flat))), v)
    return p


REST = pa.list_(pa.struct([("h", pa.int64()), ("times", pa.int64())]))


def _score(flat: np.ndarray, v: Vocabulary):
    """Sums over the listed tokens of each text, and how often it has each other token."""

    def run(batches):
        p = Parameters(v.total, flat)
        tables = Tables(p, v)
        z = v.total + ADD * (v.distinct + 1)
        for rows, data, offsets in K.chunks(batches):
            hashes, first = _tokens(data, offsets)
            found = v.find(hashes)
            known = found >= 0
            base = np.where(known, np.log10((v.counts[found] + ADD) / z), 0.0) if len(v.keys) else np.zeros(len(hashes))
            model = log_probabilities(p, v, hashes, first, found, tables) / np.log(10)
            of, h = K.owner(first)[~known], hashes[~known]
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            heads = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            rest = pa.StructArray.from_arrays([pa.array(h[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(h))))], ["h", "times"])
            cuts = np.searchsorted(of[heads], np.arange(rows.num_rows + 1))
            yield pa.record_batch(
                [rows.column("rid"), rows.column("doc_id"), pa.array(np.diff(first)), pa.array(np.add.reduceat(known.astype(np.int64), first[:-1])), pa.array(np.add.reduceat(base, first[:-1])), pa.array(np.add.reduceat(model, first[:-1])), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rest)],
                ["rid", "doc_id", "n_tokens", "n_known", "base", "model", "rest"],
            )

    return run


def score(docs: DataFrame, listed: int = LISTED, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row; learns from the rows not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.where(held_out_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = materialize(token_counts(train), "tokens")
    v = vocabulary(counts, listed)
    flat, known = spark.sparkContext.broadcast(fit(train, v, rounds).flat), spark.sparkContext.broadcast(v)
    scored = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(
        lambda batches: _score(flat.value, known.value)(batches), "rid long, doc_id long, n_tokens long, n_known long, base double, model double, rest array<struct<h: long, times: long>>"
    )
    # a row of the document itself, and one for each token that isn't listed
    itself = F.array(F.struct(F.xxhash64("rid").alias("h"), F.lit(0).cast("long").alias("times")))
    each = scored.select("rid", "doc_id", "n_tokens", "n_known", "base", "model", F.explode(F.concat(itself, "rest")).alias("x"))
    each = each.select("rid", "x.h", "x.times", *[F.when(F.col("x.times") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_tokens", "n_known", "base", "model")])
    joined = each.join(counts.withColumnRenamed("n", "seen"), "h", "left")
    times, c = F.col("times"), F.coalesce("seen", F.lit(0))
    z, rest = v.total + ADD * (v.distinct + 1), v.rest_total + v.unseen
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(c > 0, times).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(times * F.log10((c + ADD) / F.lit(z)))).alias("base_score"),
        (F.max("model") + F.sum(times * F.log10(F.when(c > 0, c).otherwise(F.lit(v.unseen)) / F.lit(rest)))).alias("score"),
    )
    return sums.select("doc_id", (held_out_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")
