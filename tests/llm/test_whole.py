"""Cases in which an operator once did less than the whole job."""

import random
import re
import string
import zlib

import numpy as np
import public_tokenizers

from corvane.llm import ann, kernels, lmscore, quality, secrets, simhash, tokencount, toxicity

from . import brute
from .test_models import counted


# --- nearest neighbours


def test_a_walk_goes_on_to_the_end_of_a_chain(spark):
    n = 12
    node = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "id long, v array<float>")
    graph = spark.createDataFrame([(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "id long, to long")
    queries = spark.createDataFrame([(0, [0.0, 1.0], 0)], "query long, q array<float>, home long")
    found = ann.search(queries, node, graph, top=2, landmarks=0).orderBy("sim", ascending=False).collect()
    assert [r.id for r in found[:2]] == [n - 1, n - 2]


def test_opposite_clusters_are_connected(spark):
    r = np.random.default_rng(5)
    rows = [(i, ((1 if i % 2 else -1) * (np.array([20.0] + [0.0] * 7) + r.standard_normal(8) / 100)).tolist()) for i in range(30)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).groupBy("query_id").count().collect()
    assert {x.query_id: x["count"] for x in got} == {0: 20, 20: 20}


def test_rings_connect_every_node(spark):
    ids = spark.range(3000)
    root = list(range(3000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ann.rings(ids, 3000).collect():
        root[find(a)] = find(b)
    assert len({find(i) for i in range(3000)}) == 1


def answers(spark, rows, kind="double"):
    got = ann.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).orderBy("query_id", "rank").collect()
    out = {}
    for x in got:
        out.setdefault(x.query_id, []).append((x.vec_id, x.score))
    return out


def test_doubles_that_floats_cannot_tell_apart(spark):
    got = answers(spark, [(i, [1 + i * 1e-10, 0.5]) for i in range(40)])
    assert [v for v, _ in got[0]] == list(range(39, 19, -1))
    assert [s for _, s in got[0]] == [(1 + v * 1e-10) + 0.25 for v, _ in got[0]]


def test_very_unequal_norms(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((1500, 16))
    x[7] *= 1e20
    x[8] *= 1e-20
    got = answers(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
        assert all(abs(score - x[q] @ x[v]) <= 1e-9 * abs(score) + 1e-30 for v, score in found)
    assert len(got) == 75 and hits >= 0.95 * 20 * 75


def test_shorter_vectors_count_as_filled_up_with_zeros(spark):
    got = answers(spark, [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0, 1.0, 9.0])])
    assert got == {0: [(2, 3.0), (3, 3.0), (1, 1.0)]}


def test_a_third_of_all_rows_are_copies(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(600)] + [(600 + i, [3.0] * 6) for i in range(300)]
    got = answers(spark, rows)
    assert len(got) == 45 and all(len(v) == 20 for v in got.values())
    assert all([v for v, _ in got[q]] == [i for i in range(600, 621) if i != q][:20] for q in got if q >= 600)


# --- quality


def plain_votes(text):
    """The labellers' rules, text by text."""
    raw = (text or "").encode()
    w = brute.words(text)
    n = len(w)
    count = lambda f: sum(map(f, raw))
    upper, letter = lambda b: 65 <= b <= 90, lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    space, digit = lambda b: b == 32 or 9 <= b <= 13, lambda b: 48 <= b <= 57
    ink = count(lambda b: not space(b))
    part = lambda a, b: a / max(b, 1)
    capitals, bars = part(count(upper), count(letter)), part(raw.count(b"|"), ink)
    symbols = part(count(lambda b: not (letter(b) or digit(b) or space(b))), ink)
    size, variety = part(sum(len(x.encode()) for x in w), n), part(len(set(w)), n)
    lines = [x.translate(brute.LOWER) for x in (text or "").split("\n") if x]
    repeated = 1 - part(len(set(lines)), len(lines))
    stops = part(sum(raw.count(c) for c in (b".", b"!", b"?")), n)
    runs = part(sum(raw[i] == raw[i + 1] == raw[i + 2] and not (letter(raw[i]) or digit(raw[i]) or space(raw[i])) for i in range(len(raw) - 2)), n)
    echoes = part(sum(a == b for a, b in zip(w, w[1:], strict=False)), n)
    pick = lambda bad, good: quality.BAD if bad else quality.GOOD if good else quality.NONE
    return [
        pick(n < 1, n >= 20),
        pick(capitals > 0.3 and n >= 4, capitals < 0.12),
        pick(symbols > 0.15 and n >= 10, symbols < 0.08),
        pick(bars > 0.02 and n >= 10, False),
        pick((size < 2.5 or size > 14) and n >= 10, 3 <= size <= 10),
        pick(variety < 0.2 and n >= 50, variety > 0.35),
        pick(repeated > 0.3 and len(lines) >= 4, repeated < 0.15 and len(lines) >= 2),
        pick(stops < 0.01 and n >= 20 or stops > 0.6, 0.02 <= stops <= 0.4),
        pick(runs > 0.1 and n >= 10, runs == 0),
        pick(echoes > 0.1 and n >= 10, echoes < 0.02),
    ]


def plain_score(text, model):
    """The linear scorer, feature by feature."""
    import xxhash

    raw = (text or "").encode()
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if b >= 128 else 0 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 5 if b == 10 else 4 if b == 32 or 9 <= b <= 13 else 6 if b in b".!?" else 7 if b == 44 else 8 if b == 124 else 9
    k, low = [kind(b) for b in raw], raw.translate(bytes(kernels.LOWER.tolist()))
    parts = [
        (0, quality.KINDS, [(k[i] * 100 + k[i + 1] * 10 + k[i + 2]) % quality.KINDS for i in range(len(k) - 2)]),
        (quality.KINDS, quality.GRAMS, [((int.from_bytes(low[i : i + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % quality.GRAMS for i in range(len(low) - 3)]),
        (quality.KINDS + quality.GRAMS, quality.WORDS, [(xxhash.xxh64_intdigest(x.encode(), 42) >> 30) % quality.WORDS for x in brute.words(text)]),
    ]
    logit = model.bias
    for base, buckets, found in parts:
        counts = np.bincount(found, minlength=buckets) if found else np.zeros(buckets)
        logit += float(np.sqrt(counts / max(counts.sum(), 1)) @ model.weights[base : base + buckets])
    return 1 / (1 + np.exp(-logit))


TEXTS = [None, "", "next text", "!next text", "the same the", "end!!", "!!! ...", "a a a a a a a a a a a b", "ÉCOLE École x", "one | two | three | four | five | six | seven | eight | nine | ten |", "x\nx\nx\nx\ny\n", "w" * 5000, "SHOUTING WORDS ARE HERE NOW. " * 9, "word. " * 900, "line one\nline two. " * 40, "?"]


def test_quality_against_brute_force_whatever_the_neighbours(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = TEXTS + [t for _, t in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = quality.train(df)
    for order in ("doc_id", "-doc_id", "xxhash64(doc_id)"):
        got = {r.doc_id: r for r in quality.score(df.selectExpr("*", f"{order} AS o").sort("o"), model).collect()}
        for i, t in enumerate(texts):
            v = plain_votes(t)
            assert (got[i].n_bad, got[i].n_good) == (v.count(quality.BAD), v.count(quality.GOOD)), (order, t)
            assert got[i].weak_label == model.posterior[int((np.array(v) * quality.PLACE).sum())]
            assert abs(got[i].score - plain_score(t, model)) < 1e-5


def test_quality_learns_from_distinct_texts_alike_in_any_order(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('word number ', id % 90, '. And another one, then more words here.') AS text")
    a, b = quality.train(docs, 50), quality.train(docs.repartition(7, "doc_id"), 50)
    assert np.allclose(a.weights, b.weights) and abs(a.bias - b.bias) < 1e-9


# --- token counts


def test_pieces_with_other_capitals_are_kept(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    names = [p for p in names if not re.search("[A-Z]", p)]
    begin, more = {p[1:] for p in names if p[0] == "▁" and len(p) > 1}, {p for p in names if "▁" not in p}
    capitals = sorted(p for p in begin if p != p.lower() and brute.words(p) == [p])
    assert capitals
    docs = list(enumerate([*capitals, " ".join(capitals), "École ÉCOLE école Москва МОСКВА Über"]))
    got = brute.rows(tokencount.token_counts(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_words", "n_tokens", "n_unknown")
    assert got == sorted(((d, *counted(t, begin, more)) for d, t in docs), key=repr)
    assert all(n_unknown == 0 for d, _, _, n_unknown in got if d <= len(capitals))


# --- secrets


def test_random_parts_of_a_run_are_found_and_blanked(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    r = random.Random(12)
    key = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    path = "/".join(r.choice(secrets.PARTS) for _ in range(20))
    keys, docs = [], []
    for i in range(100):
        k = key((40, 40, 40, 16)[i % 4])
        keys.append(k)
        docs.append((i, ("see AKIA" + "ABCD2345EFGH6789" + f"/{k} x", "see " + "0123456789abcdef" * 2 + f"-{k} x", f"see {path}/{k} x", f"see {k} x")[i % 4]))
    plain = [path, "customer_account_identifier", "internationalization", "HttpRequestHandlerFactory", "4012888888881881", "5693240340017844"]
    docs += [(1000 + i, f"see {t} x") for i, t in enumerate(plain)]
    got = {x.doc_id: x.text for x in secrets.redact(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for kind, least in enumerate((25, 25, 24, 21)):
        assert sum(k not in got[i] and "[secret] x" in got[i] for i, k in enumerate(keys) if i % 4 == kind) >= least, kind
    assert all(got[d] == t for d, t in docs if d >= 1000)


def test_identifiers_of_another_source_and_uuids_are_left_alone(spark):
    import asyncio
    import email
    import http.client
    import logging
    import os
    import socket
    import ssl
    import unittest
    import uuid

    model = secrets.train(secrets.labelled_samples(spark))
    names = sorted({n for m in (asyncio, email, http.client, logging, os, socket, ssl, unittest, unittest.TestCase) for n in dir(m) if len(n) >= 16})
    r = random.Random(13)
    uuids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(50)]
    keys = ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(n)) for n in (24, 32, 44, 64) * 25] + ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(32)) for _ in range(50)]
    docs = list(enumerate(f"see {x} there" for x in names + uuids + keys))
    got = {x.doc_id: x.n_markov for x in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    plain = len(names) + len(uuids)
    assert len(names) > 100 and sum(got[i] > 0 for i in range(len(names))) <= 0.03 * len(names)
    assert not any(got[i] for i in range(len(names), plain))
    assert sum(got[i] > 0 for i in range(plain, len(docs))) >= 0.95 * len(keys)


# --- toxicity


def test_rows_of_one_labelled_id_are_bounded(spark):
    docs = spark.createDataFrame([(3, "vile words") for _ in range(3000)] + [(3, f"other words {i}") for i in range(500)] + [(i, f"kind words {i}") for i in range(4, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1)] + [(i, 0) for i in range(4, 40)], "doc_id long, toxic int")
    rows = []
    descend = toxicity._descend
    try:
        toxicity._descend = lambda have, *a: rows.append(len(have)) or descend(have, *a)
        toxicity.train(docs, labels, max_rows=4)
        toxicity.train(docs, labels)
    finally:
        toxicity._descend = descend
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(4, 40))
    assert rows == [4, 501 * (zlib.crc32(b"3") % 4 != 2) + 36 - held]


def test_toxicity_score_against_brute_force(spark, sf):
    import xxhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(None, None), (-1, ""), (-2, "w" * 70_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    want = {}
    for d, t in docs:
        raw = [w.encode() for w in brute.words(t)]
        have = {xxhash.xxh64_intdigest(w, 1) for w in raw} | {xxhash.xxh64_intdigest(w[:n], 100 + n) for w in raw for n in toxicity.PREFIXES if len(w) > n}
        want[d] = 1 / (1 + np.exp(-(model.bias + sum(weight.get(h, 0.0) for h in have))))
    for r in toxicity.score(df, model).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(want[r.doc_id] >= 0.3)


# --- pipeline stages


def test_one_of_repeated_rows_stays_whatever_the_join(spark, monkeypatch):
    from corvane.llm import tables

    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(40)), "x") for i in range(60)]
    rows += [rows[5]] * 7 + [(None, rows[6][1], "n"), (None, "only one of it", "n"), (None, "only one of it", "n"), (5, "another text of that id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, corvane string")
    want = sorted({(d, t) for d, t, _ in rows if d is not None} | {(None, "only one of it")}, key=repr)
    for bound in (1_000_000, 0):
        monkeypatch.setattr(tables, "BROADCAST_ROWS", bound)
        got = simhash.keep_one(docs)
        assert got.columns == docs.columns and brute.rows(got, "doc_id", "text") == want


# --- language model


def test_as_many_tokens_have_a_softmax_of_their_own(spark):
    counts = spark.range(5000).selectExpr("id as h", "10000 - id as n")
    v = lmscore.vocabulary(counts)
    assert (v.place >= 0).sum() == 48 * 64
    assert len(np.unique(v.classes)) >= 48
