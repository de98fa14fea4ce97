import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, licenses, lmscore, quality, tokencount
from corvane.llm import kernels as K
from corvane.llm.queries import ORACLE_SQL, op1_nearest, op2_token_counts, op5_lm_score, op6_quality, op8_licenses

from . import brute

CLASH = "doc_id long, text string, h string, n string, score string, rest string, words string, line string, pattern string"
ODD = [(None, "a b"), (1, None), (2, ""), (3, "x"), (3, "x"), (3, "other words"), (4, "word " * 60_000), (5, " \n\t")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, *"xyzabcd") for d, t in rows], CLASH)


# --- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, sim string")


def exact(rows, every, top):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    ids = sorted(usable)
    x = np.array([usable[i] for i in ids], np.float32).astype(float)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n]
            order = [k for k in np.lexsort((ids, -np.round(s, 9))) if k != n][:top]
            out[i] = [(ids[k], s[k]) for k in order]
    return out


def test_nearest_with_copies_and_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(8).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]
    rows += [(401, None), (402, [0.0] * 8), (403, [1.0, None] + [1.0] * 6), (404, [float("nan")] * 8), (405, [float("inf")] + [1.0] * 7), (None, rows[0][1]), (406, [1.0, 2.0]), (20, rows[20][1]), (420, rows[40][1])]
    rows += [(440 + i, (np.array(rows[i][1]) * 50).tolist()) for i in range(3)]
    got = collections.defaultdict(list)
    for x in ann.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    want = exact([x for x in rows if x[0] != 406], 20, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [n for n, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
        scores = dict(want[q])
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found if v in scores)
    assert hits >= 0.97 * 20 * len(want)


def test_nearest_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = ann.nearest(vectors(spark, rows)).orderBy("rank").collect()
    assert [(x.query_id, x.vec_id, x.score) for x in got] == [(0, 2, 1.0), (0, 1, 0.0)]
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert ann.nearest(vectors(spark, [(20, [1.0, 0.0])])).count() == 0


def test_nearest_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 20, 20)
    got = collections.defaultdict(set)
    for x in op1_nearest(spark, sf).collect():
        got[x.query_id].add(x.vec_id)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


# --- token counts


def greedy(word, begin, more):
    n, at, known = 0, 0, begin
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        at, n, known = end, n + 1, more
    return n


@pytest.mark.parametrize("seed", range(8))
def test_automaton_is_greedy_longest_match(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abc") for _ in range(r.randrange(1, n)))
    begin, more = {make(6) for _ in range(12)}, {make(6) for _ in range(12)}
    machine = tokencount.Automaton(sorted(begin), sorted(more))
    for _ in range(400):
        w = make(14)
        assert machine.count(w) == greedy(w, begin, more), w
    assert machine.count("") <= 0


def counted(text, begin, more):
    w = brute.words(text)
    n = [greedy(x, begin, more) for x in w]
    single = len(re.findall(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", text or ""))
    return len(w), sum(max(x, 1) for x in n) + single, sum(x < 0 for x in n)


def test_token_counts_against_brute_force(spark, sf):
    begin, more = map(set, tokencount.pieces())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert brute.rows(op2_token_counts(spark, sf), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(((d, *counted(t, begin, more)) for d, t in docs), key=repr)
    assert brute.rows(tokencount.token_counts(frame(spark, ODD)), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(((d, *counted(t, begin, more)) for d, t in ODD), key=repr)
    assert tokencount.token_counts(frame(spark, [])).count() == 0


# --- language model


def unigram(docs):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    count = collections.Counter(t for d, text in docs if not held(d) for t in [*brute.tokens(text), "\n"])
    n, v = sum(count.values()), len(count)
    out = []
    for d, text in docs:
        t = [*brute.tokens(text), "\n"]
        out.append((d, held(d), len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 5)))
    return sorted(out, key=repr)


def lm_rows(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect()), key=repr)


def test_lm_base_and_model(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = op5_lm_score(spark, sf).cache()
    assert lm_rows(df) == unigram(docs)
    held = df.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_without_room_for_most_tokens(spark):
    r = random.Random(6)
    docs = ODD + [(10 + i, " ".join(f"t{int(r.paretovariate(0.7)) % 900}" for _ in range(60))) for i in range(120)]
    df = lmscore.score(frame(spark, docs), listed=50)
    assert lm_rows(df) == unigram(docs)
    assert all(x.score < 0 for x in df.collect())
    assert lmscore.score(frame(spark, [])).count() == 0


def plain_model(docs, listed, rounds):
    """The model's log10 probability of each text, token by token, with dictionaries and loops."""
    import xxhash

    m64 = (1 << 64) - 1
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    key = lambda t: lmscore.END if t == "\n" else xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def mix(x):
        x = (x ^ (x >> 31)) * K.P2 & m64
        x = (x ^ (x >> 29)) * K.P3 & m64
        return x ^ (x >> 32)

    texts = [(d, [key(t) for t in [*brute.tokens(text), "\n"]]) for d, text in docs]
    train = [t for d, t in texts if not held(d)]
    count = collections.Counter(h for t in train for h in t)
    total, steps, reached = sum(count.values()), sorted(collections.Counter(count.values()).items(), reverse=True), 0
    least = 1 << 62
    for n, tokens in steps:
        reached += tokens
        if reached > listed:
            break
        least = n
    names = sorted((h for h in count if count[h] >= least), key=lambda h: (-count[h], signed(h)))
    edge = lmscore.TOP_CLASSES * lmscore.TOP_WIDTH
    width = max(1.0, math.log2(max(2, lmscore.LISTED / edge))) / lmscore.BANDS if listed == lmscore.LISTED else max(1.0, math.log2(max(2, listed / edge))) / lmscore.BANDS
    band = lambda r: min(lmscore.BANDS - 1, int(math.log2(max(r + 1, edge) / edge) / width))
    place = {h: (r // lmscore.TOP_WIDTH, r % lmscore.TOP_WIDTH) if r < edge else (lmscore.TOP_CLASSES + band(r), -1) for r, h in enumerate(names)}
    of = lambda h: place.get(h, (lmscore.CLASSES - 1, -1))
    mass = np.zeros(lmscore.CLASSES)
    for h in names:
        mass[place[h][0]] += count[h]
    rest, unseen = total - mass.sum(), max(0.5, sum(n == 1 for n in count.values()))
    mass[-1] = rest + unseen
    bias = np.log((mass + 0.5) / (mass.sum() + 0.5 * lmscore.CLASSES))
    inside = np.full((lmscore.TOP_CLASSES, lmscore.TOP_WIDTH), -30.0)
    for h in names[:edge]:
        inside[place[h]] = math.log(count[h] / mass[place[h][0]])
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    share, inside = softmax(bias), np.array([softmax(x) for x in inside])
    buckets = lmscore.Parameters(total).buckets

    def context(t, i):
        one, two = (t[i - 1] if i else 1), (t[i - 2] if i > 1 else 1 if i else 2)
        one, two = mix(one), mix((two + 77) & m64)
        both = mix((one * K.P1 + two) & m64)
        return {"previous": one % buckets["previous"], "skip": two % buckets["skip"], "pair": both % buckets["pair"]}, (one >> 20) % lmscore.INNER

    zero = lambda: {f: collections.defaultdict(lambda: np.zeros(lmscore.CLASSES)) for f in lmscore.FEATURES}
    seen, seen_in = zero(), collections.defaultdict(lambda: np.zeros(lmscore.TOP_WIDTH))
    for t in train:
        for i, h in enumerate(t):
            c, row = context(t, i)
            for f, b in c.items():
                seen[f][b][of(h)[0]] += 1
                seen[f][b][-1] += h in place and count[h] == 1
            if of(h)[1] >= 0:
                seen_in[row, of(h)[0]][of(h)[1]] += 1
    before = lmscore.BEFORE
    for x in (x for f in seen.values() for x in f.values()):
        x[-1] *= (rest + unseen) / max(0.5, rest + sum(count[h] == 1 for h in names))
    weights = {f: {b: lmscore.FIRST_RATES[f] * np.log((x + before * share) / ((x.sum() + before) * share)) for b, x in seen[f].items()} for f in lmscore.FEATURES}
    none = np.zeros(lmscore.CLASSES)
    chances = lambda c: softmax(bias + sum(weights[f].get(b, none) for f, b in c.items()))
    for _ in range(rounds):
        expects = zero()
        for t in train:
            for i in range(len(t)):
                c = context(t, i)[0]
                p = chances(c)
                for f, b in c.items():
                    expects[f][b] += p * (2 if t[i] in place and count[t[i]] == 1 else 1)
        weights = {f: {b: w + lmscore.RATE * np.log((seen[f][b] + before * share) / (expects[f][b] + before * share)) for b, w in weights[f].items()} for f in lmscore.FEATURES}
    out = []
    for d, t in texts:
        s = 0.0
        for i, h in enumerate(t):
            c, row = context(t, i)
            k, at = of(h)
            s += math.log10(chances(c)[k])
            if at >= 0:
                x = seen_in[row, k]
                s += math.log10((x[at] + before * inside[k][at]) / (x.sum() + before))
            elif h in place:
                s += math.log10(count[h] / mass[k])
            else:
                s += math.log10((count[h] or unseen) / (rest + unseen))
        out.append((d, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("listed,rounds", [(lmscore.LISTED, 1), (40, 2)])
def test_lm_score_against_brute_force(spark, listed, rounds):
    r = random.Random(7)
    odd = [(d, t) for d, t in ODD if len(t or "") < 1000]
    docs = odd + [(10 + i, " ".join(f"t{int(r.paretovariate(0.8)) % 300}" for _ in range(r.randrange(80)))) for i in range(80)]
    want = plain_model(docs, listed, rounds)
    for parts in (1, 13):
        got = sorted(((x.doc_id, x.score) for x in lmscore.score(frame(spark, docs).repartition(parts), listed, rounds).collect()), key=repr)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose(sorted(s for _, s in got), sorted(s for _, s in want), rtol=1e-4, atol=2e-3), (parts, listed)


def test_lm_gain_does_not_depend_on_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [lmscore.score(docs.repartition(n, "doc_id")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first() for n in (3, 64)]
    few, many = ((s - b) for s, b in held)
    assert few > 0 and abs(many / few - 1) < 0.01


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    n = 600
    keys = np.sort(r.integers(1, 1 << 62, n).astype(np.uint64))
    v = lmscore.Vocabulary(keys, np.ones(n, int), (np.arange(n) % 7).astype(np.int16), (np.arange(n) // 7 % lmscore.TOP_WIDTH).astype(np.int16), np.zeros(n), n, n, 0, 0.5, 1.0, np.zeros(lmscore.CLASSES, np.float32), np.zeros((lmscore.TOP_CLASSES, lmscore.TOP_WIDTH), np.float32))
    p = lmscore.Parameters(n)
    p.flat[:] = r.standard_normal(len(p.flat))
    c = lmscore.contexts(keys[:3], np.array([0, 3]), p.buckets)
    first = lmscore._softmax(lmscore._class_logits(p, v, c, slice(0, 3)))
    inner = lmscore._softmax(lmscore._inner_logits(p, v, c, np.array([2]), np.array([0, 0, 4])))
    assert np.allclose(first.sum(axis=1), 1, atol=1e-5) and np.allclose(inner.sum(), 1, atol=1e-5)
    one = lmscore.log_probabilities(p, v, keys[:3], np.array([0, 3]), np.arange(3))
    assert np.isclose(one[2], np.log(first[2, v.classes[2]]) + np.log(lmscore._softmax(lmscore._inner_logits(p, v, c, np.array([2]), v.classes[:3].astype(int)))[0, v.place[2]]), atol=1e-4)


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_lm_tables_equal_token_by_token_logits(scale):
    r = np.random.default_rng(3)
    n = 900
    keys = np.sort(r.integers(1, 1 << 62, n).astype(np.uint64))
    classes = np.where(np.arange(n) < 600, np.arange(n) % lmscore.TOP_CLASSES, lmscore.TOP_CLASSES + np.arange(n) % 5)
    place = np.where(np.arange(n) < 600, np.arange(n) // lmscore.TOP_CLASSES, -1)
    v = lmscore.Vocabulary(keys, 1 + np.arange(n) % 3, classes.astype(np.int16), place.astype(np.int16), np.full(n, -0.5), 2 * n, n, 0, 0.5, 1.0, r.standard_normal(lmscore.CLASSES).astype(np.float32), r.standard_normal((lmscore.TOP_CLASSES, lmscore.TOP_WIDTH)).astype(np.float32))
    p = lmscore.Parameters(1 << 20)
    p.flat[:] = scale * r.standard_normal(len(p.flat))
    tables = lmscore.Tables(p, v)
    assert (tables.powers is None) == (scale > 1)
    hashes = r.choice(keys, 5000, p=1 / np.arange(1, n + 1) / (1 / np.arange(1, n + 1)).sum())
    hashes[::17] = r.integers(1, 1 << 62, len(hashes[::17])).astype(np.uint64)
    first, found = np.array([0, 1, 2000, 5000]), v.find(hashes)
    c = lmscore.contexts(hashes, first, p.buckets)
    at, of = lmscore._placed(v, found)
    logits = lmscore._class_logits(p, v, c, slice(None)).astype(np.float64)
    logits -= np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + logits.max(axis=1, keepdims=True)
    want = logits[np.arange(5000), at]
    top = np.flatnonzero(of >= 0)
    inner = lmscore._inner_logits(p, v, c, top, at).astype(np.float64)
    most = inner.max(axis=1)
    want[top] += inner[np.arange(len(top)), of[top]] - most - np.log(np.exp(inner - most[:, None]).sum(axis=1))
    want[(found >= 0) & (of < 0)] -= 0.5
    assert np.allclose(lmscore.log_probabilities(p, v, hashes, first, found, tables), want, rtol=1e-5, atol=1e-4)
    out = lmscore.Parameters(1 << 20, kind=np.float64)
    lmscore.expected(out, tables, hashes, first)
    for f in lmscore.FEATURES:
        sums = np.zeros(p[f].shape)
        np.add.at(sums, c[f], np.exp(logits) * (1 + lmscore.seen_once(v, found))[:, None])
        assert np.allclose(out[f], sums, rtol=1e-4, atol=1e-4)


# --- quality


def test_quality_estimates_labellers():
    r = np.random.default_rng(2)
    n = 20_000
    good = r.random(n) < 0.85
    votes = np.ones((n, len(quality.LABELLERS)), int)
    for j in range(votes.shape[1]):
        bad = r.random(n) < np.where(good, 0.01, 0.35)
        votes[:, j] = np.where(bad, quality.BAD, np.where(r.random(n) < 0.6, quality.GOOD, quality.NONE))
    patterns, counts = np.unique((votes * 3 ** np.arange(votes.shape[1])).sum(axis=1), return_counts=True)
    post, rates = quality.estimate(patterns, counts.astype(float))
    guess = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    got = np.array([guess[p] for p in (votes * 3 ** np.arange(votes.shape[1])).sum(axis=1).tolist()]) > 0.5
    assert (got == good).mean() > 0.97
    assert abs(rates[0, 0, quality.BAD] - 0.35) < 0.05 and rates[0, 1, quality.BAD] < 0.03


def test_quality_against_labels(spark):
    s = "/root/testdata/sf0.1"
    d = op6_quality(spark, s).join(spark.read.parquet(f"{s}/labels.parquet"), "doc_id")
    x = d.agg(F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int"))).alias("kept"), F.avg(F.when(F.col("quality") == 0, F.col("keep").cast("int"))).alias("slipped")).first()
    assert x.kept > 0.98 and x.slipped < 0.15


def test_quality_odd_rows(spark):
    docs = frame(spark, ODD)
    got = quality.score(docs, quality.train(docs)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(frame(spark, []))
    assert quality.score(frame(spark, []), none).count() == 0
    assert all(r.score == 0.5 for r in quality.score(docs, none).collect())


# --- licenses


def base_license(text):
    w = brute.words(text)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXT_OF = lambda label, n=0: [t[1] for t in licenses.TEMPLATES if t[0] == label][n]
LICENSED = [
    (100, "MIT License mit license MIT-License; Apache license\nCC BY cc by-nc gnu General Public  License"),
    (101, "intro " + TEXT_OF("mit", 3) + " tail"),
    (102, "intro " + TEXT_OF("gpl", 1).replace("either version", "extra words either version") + " tail"),
    (103, "gnu general public license"),
    (104, "xmit license apache licenses cc bye"),
    (105, "é " * 30 + TEXT_OF("mpl", 1).upper()),
]
#: Notices as they are met, and the label the method alone gives.
NOTICES = [
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("cc-by-nc-sa", "<p>This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License</p>"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mit", "The MIT License. " + TEXT_OF("mit", 3)),
    ("isc,mit", TEXT_OF("isc") + " " + TEXT_OF("mit")),
    ("", "you can redistribute the news under the terms of the free press as published by the paper in any later version"),
]


def test_licenses_against_brute_force(spark):
    docs = ODD + LICENSED
    df = licenses.scan(frame(spark, docs)).cache()
    assert brute.rows(df, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((d, *base_license(t)) for d, t in docs), key=repr)
    labels = {r.doc_id: (r.labels, r.score) for r in df.collect()}
    assert labels[101] == ("mit", 1.0)
    assert labels[102][0] == "gpl" and 0.6 < labels[102][1] < 1
    assert labels[105] == ("mpl", 1.0) and labels[104] == ("", 0.0)
    assert licenses.scan(frame(spark, [])).count() == 0
    bare = {r.doc_id: r.labels for r in licenses.scan(frame(spark, docs), templates=[]).collect()}
    assert bare[100] == "apache,cc-by,gpl,mit"


def test_licenses_of_notices(spark):
    docs = [(i, f"Some words before. {t} And after.") for i, (_, t) in enumerate(NOTICES)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, docs)).collect()}
    for i, (label, text) in enumerate(NOTICES):
        base = base_license(docs[i][1])[-1].split(",")
        want = ",".join(sorted({*label.split(","), *base} - {""}))
        assert got[i].labels == want, text
        assert [x for x in got[i].labels.split(",") if x not in base] == [x for x in label.split(",") if x and x not in base]


def test_templates_hold_the_words_that_tell_them():
    for label, text, tells in licenses.TEMPLATES:
        w = brute.words(text)
        assert any(w[i : i + 3] == tells.split() for i in range(len(w))), (label, text)


def test_license_queries_equal_their_sql_on_notices(spark, tmp_path):
    docs = ODD + LICENSED + [(200 + i, t) for i, (_, t) in enumerate(NOTICES)] + [(300, " ".join(t for _, t in NOTICES) * 3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL["op8_licenses"])
    assert brute.rows(op8_licenses(spark, str(tmp_path)), *want.columns) == sorted(want.fetchall(), key=repr)


def test_licenses_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(ORACLE_SQL["op8_licenses"])
    names = want.columns
    assert brute.rows(op8_licenses(spark, sf), *names) == sorted(want.fetchall(), key=repr)


def test_licenses_plan_has_no_python(spark, sf):
    plan = op8_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
