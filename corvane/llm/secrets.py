"""Secret scans: fixed patterns, and two character Markov models compared by likelihood.

The patterns find assignments, access keys and hex strings. What they leave of every
run of token characters is scored by the log-likelihood ratio of its character pairs
under a model of random strings and one of ordinary identifiers. Pieces of at least
``MIN_RUN`` characters with a mean above ``THRESHOLD`` are spans of kind ``markov``. Of
other pieces, so are the stretches of at least ``MIN_STRETCH`` characters whose ratios
exceed the threshold most in sum, by at least ``EXCESS`` (so that a shorter one needs a
higher mean), and which mix digits, capitals and small letters; each is extended to the
next of ``/ = _ -``, so that no end of a key stays. UUIDs, which name things, are left out
as the patterns' spans are. Both models are pair counts of labelled samples, made by Spark; a
pair table is bounded by the alphabet, whatever the number of samples.

Edge cases: null and empty texts have no spans; texts of any length are scanned whole,
runs of any length too; spans of one start go in the order of kinds; repeated rows give a row each; null
ids are kept; extra columns are ignored (``redact`` keeps them); no documents give
no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import mapped_rows

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_RUN = 20
THRESHOLD = 0.55
MIN_STRETCH = 16
EXCESS = 10.0
#: Characters of a run; the models' alphabet.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
SAMPLES = 20_000

# Parts of ordinary identifiers.
PARTS = (
    "account action active address agent answer array attribute background balance batch begin binary block border buffer "
    "button cache callback category channel character client cluster collection column command comment component condition "
    "config connection constant container content context control counter country create current customer data database "
    "date default delete description destination detail device dictionary directory display document domain driver duration "
    "element email enable encoding error event example exception execute export factory field file filter folder format "
    "frame function gateway global group handler header height history identifier image import index information input "
    "instance integer interface internal invoice item iterator journal keyboard label language layout length level library "
    "limit listener local location logger lookup manager mapping margin matrix maximum member memory message metadata method "
    "minimum model module monitor name namespace network node notification number object offset operation option order output "
    "owner package page parameter parent parser partition path pattern payment percent period permission platform plugin "
    "pointer policy position prefix previous price primary priority process product profile project property protocol "
    "provider proxy query queue random range reader record reference region register release remote report request resource "
    "response result return role route sample schedule schema scope screen script search section segment selection sequence "
    "server service session setting shadow signature simple single size source space stack standard start state static status "
    "storage stream string structure style subject summary support symbol system table target task template terminal text "
    "thread threshold time title toolbar total trace transaction transform transport trigger type update upload user utility "
    "validation value variable vector version view virtual visible volume warning weight widget width window worker wrapper writer"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``n`` random strings (label 1) and ``n`` ordinary identifiers and words (label 0), the same ones every time."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    raw = F.unhex(digest)
    kind = F.pmod(F.col("id"), F.lit(4))
    size = (F.lit(MIN_RUN) + F.pmod(F.xxhash64("id"), F.lit(23))).cast("int")
    random = F.when(kind == 0, digest).when(kind == 1, F.upper(F.regexp_replace(F.base64(raw), "[+/=]", ""))).otherwise(F.base64(raw))
    words = F.array(*[F.lit(w) for w in PARTS])
    part = lambda i: F.element_at(words, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))).cast("int") + 1)
    title = lambda i: F.initcap(part(i))
    styles = [
        F.concat_ws("_", part(1), part(2), part(3)),
        F.concat(part(1), title(2), title(3), title(4)),
        F.concat_ws("-", part(1), part(2), part(3)),
        F.upper(F.concat_ws("_", part(1), part(2), part(3))),
        F.concat(part(1), part(2), part(3)),
        F.concat_ws("/", part(1), part(2), part(3), F.concat(part(4), F.pmod(F.col("id"), F.lit(100)).cast("string"))),
    ]
    style = F.element_at(F.array(*styles), F.pmod(F.col("id"), F.lit(len(styles))).cast("int") + 1)
    ids = spark.range(n)
    return ids.select(F.substring(random, F.lit(1), size).alias("text"), F.lit(1).alias("label")).union(ids.select(style, F.lit(0)))


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each pair of characters, smoothed by one."""
    pairs = F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")
    rows = samples.where("length(text) >= 2").select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    counts = np.ones((2, len(ALPHABET), len(ALPHABET)))
    code = {c: i for i, c in enumerate(ALPHABET)}
    known = F.length(F.translate("pair", ALPHABET, "")) == 0
    for r in rows.where(known).collect():  # at most 2 * 67 * 67 rows
        counts[r["label"], code[r["pair"][0]], code[r["pair"][1]]] += r["count"]
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (p[1] - p[0]).astype(np.float32)


_codes = np.full(256, 255, np.uint8)
_codes[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_run = _codes < 255
_stop = np.zeros(256, bool)
_stop[np.frombuffer(b"/=_-", np.uint8)] = True
_hex = np.zeros(256, bool)
_hex[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def _long_runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of maximal runs of ``kind`` within a text, of at least ``least`` bytes."""
    inside = np.concatenate([[False], kind[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & np.append(np.ones(len(data), bool), False))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    long = ends - starts >= least
    return starts[long], ends[long]


def _promising(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray, threshold: float) -> np.ndarray:
    """Which spans may hold a likely piece or stretch; few others are looked at again."""
    out = np.zeros(len(starts), bool)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        code = _codes[data[a:b]]
        over = model[code[:-1], code[1:]] - threshold
        out[i] = over.sum() > 0 or np.maximum(over, 0).sum() >= EXCESS or (b - a > MIN_RUN and over.max() > 0)
    return out


def _mixed(run: np.ndarray) -> bool:
    """Whether bytes mix digits, capitals (other than a first one) and small letters."""
    digit, upper, lower = (run >= 0x30) & (run <= 0x39), (run >= 0x41) & (run <= 0x5A), (run >= 0x61) & (run <= 0x7A)
    return int(digit.any()) + int(upper[1:].any()) + int(lower.any()) >= 2


def _stretches(run: np.ndarray, model: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spans of a piece of a run that are likely random: the whole of it, or its best stretches."""
    code = _codes[run]
    over = model[code[:-1], code[1:]].astype(np.float64) - threshold
    if len(run) >= MIN_RUN and over.mean() > 0:
        return [(0, len(run))]
    stops = np.flatnonzero(_stop[run])
    out, todo = [], [(0, len(run))]
    while todo:
        a, b = todo.pop()
        if b - a < MIN_STRETCH:
            continue
        sums = np.concatenate([[0.0], np.cumsum(over[a : b - 1])])
        gain = sums - np.minimum.accumulate(sums)
        last = int(gain.argmax())
        if gain[last] < EXCESS:
            continue
        first = int(sums[: last + 1].argmin())
        s, e = a + first, a + last + 1
        left, right = stops[stops < s], stops[stops >= e]
        s2, e2 = max(a, int(left[-1]) + 1 if len(left) else 0), min(b, int(right[0]) if len(right) else len(run))
        if e2 - s2 >= MIN_STRETCH and _mixed(run[s:e]):
            out.append((s2, e2))
        todo += [(a, s2), (e2, b)]
    return sorted(out)


def _left(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What spans leave of a run."""
    out, at = [], start
    for a, b, _ in base:
        if b > at and a < end:
            if a > at:
                out.append((at, a))
            at = max(at, b)
    return [*out, (at, end)] if at < end else out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= HEX_MIN]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _spans(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, threshold: float):
    """For each text that has any: its number, text, and spans with those of the models."""
    flagged = set()
    for starts, _ in (_long_runs(data, offsets, _hex, HEX_MIN),):
        flagged.update((np.searchsorted(offsets, starts, "right") - 1).tolist())
    low = K.LOWER[data].tobytes()
    for word in KEYWORDS + (b"akia",):
        at = low.find(word)
        while at >= 0:
            t = int(np.searchsorted(offsets, at, "right")) - 1
            flagged.add(t)
            at = low.find(word, max(at + 1, int(offsets[t + 1]) - len(word)))
    starts, ends = _long_runs(data, offsets, _run, MIN_STRETCH)
    likely = _promising(data, starts, ends, model, threshold)
    runs: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(starts[likely].tolist(), ends[likely].tolist(), strict=True):
        runs.setdefault(int(np.searchsorted(offsets, a, "right")) - 1, []).append((a, b))
    for t in sorted(flagged | set(runs)):
        begin = int(offsets[t])
        raw = data[begin : int(offsets[t + 1])]
        text = raw.tobytes().decode("utf-8", "replace")
        base = base_spans(text)
        more = []
        if t in runs:
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            names = [(m.start(), m.end(), "uuid") for m in UUID.finditer(text)]
            known = sorted(base + names)
            for a, b in runs[t]:
                s, e = int(point[a - begin]), int(point[b - begin])
                for x, y in _left(s, e, known):
                    piece = raw[a - begin + x - s : a - begin + y - s]
                    if (x, y) != (s, e):  # no separators where a base span has been cut off
                        keep = np.flatnonzero(~_stop[piece])
                        if not len(keep):
                            continue
                        x, piece = x + int(keep[0]), piece[keep[0] : keep[-1] + 1]
                    if len(piece) >= MIN_STRETCH:
                        more += [(x + i, x + j, "markov") for i, j in _stretches(piece, model, threshold)]
        if base or more:
            yield t, text, base, more


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _scan(model: np.ndarray, threshold: float):
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for rows, data, offsets in K.chunks(batches):
            n = rows.num_rows
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            sha, spans = [nothing] * n, [""] * n
            for t, _, base, more in _spans(data, offsets, model, threshold):
                for _, _, kind in base + more:
                    counts[kind][t] += 1
                sha[t], spans[t] = hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + more)
            yield pa.record_batch([rows.column("doc_id"), *map(pa.array, counts.values()), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: counts by kind, a digest of the patterns' spans, and all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(model, threshold), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def blank(text: str, spans, mark: str) -> str:
    """The text with each of the spans, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact(model: np.ndarray, threshold: float, mark: str):
    def run(batches):
        for rows, data, offsets in K.chunks(batches):
            texts = rows.column("text").to_pylist()
            sizes: dict[int, int] = {}
            for t, text, base, more in _spans(data, offsets, model, threshold):
                texts[t] = blank(text, base + more, mark)
                sizes[t] = len(texts[t])
            columns = dict(zip(rows.schema.names, rows.columns, strict=True))
            columns["text"] = pa.array(texts, rows.schema.field("text").type)
            if "n_chars" in columns and sizes:
                n = columns["n_chars"].to_pylist()
                for t, size in sizes.items():
                    n[t] = size
                columns["n_chars"] = pa.array(n, rows.schema.field("n_chars").type)
            yield pa.record_batch(list(columns.values()), schema=rows.schema)

    return run


def redact(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (and ``n_chars``, if there, counted again)."""
    return mapped_rows(docs, _redact(model, threshold, mark))
