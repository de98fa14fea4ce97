from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import bootstrap

SCHEMA = "site int, genre string, model string, doc_idx long, patient long, rr double, hit1 int"


def made(spark, patients=40, docs=3, seed=1):
    r = np.random.default_rng(seed)
    rows = [(s, g, m, p * docs + i, p, float(r.random()), int(r.integers(0, 2))) for s in (0, 1) for g in "ab" for m in "xy" for p in range(patients - 7 * s) for i in range(docs) if r.random() < 0.6]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def mix(h):
    m = 0xFFFFFFFF
    h = (h ^ h >> 16) * bootstrap.MIX_A & m
    h = (h ^ h >> 13) * bootstrap.MIX_B & m
    return h ^ h >> 16


def plain_weights(site, patients, replicate, block):
    """Draws one by one, in Python's whole numbers."""
    m = 0xFFFFFFFF

    def word(part, j):
        h = mix((mix((site + replicate * bootstrap.GOLDEN) & m) + part * bootstrap.GOLDEN) & m)
        return mix((h + j * (mix(h ^ bootstrap.TAG) | 1)) & m)

    n = len(patients)
    falls = Counter(word(0, j) % n // block for j in range(n))
    out = Counter()
    for b, c in falls.items():
        own = patients[b * block : (b + 1) * block]
        out.update(own[word(b + 1, j) % len(own)] for j in range(c))
    return out


@pytest.mark.parametrize("block", [1, 5, 1024])
@pytest.mark.parametrize("per_cell", [False, True])
def test_draws_equal_the_plain_version(spark, block, per_cell):
    import hashlib

    ranks = made(spark)
    got = {}
    for r in bootstrap.weights(ranks, 9, per_cell=per_cell, block=block).collect():
        got.setdefault((r.site, r.genre if per_cell else None, r.replicate), Counter())[r.patient] = r.w
    units = {(r.site, r.genre if per_cell else None) for r in ranks.select("site", "genre").distinct().collect()}
    rows = ranks.select("site", "genre", "patient").distinct().collect()
    for site, genre in units:
        mine = sorted({r.patient for r in rows if r.site == site and genre in (None, r.genre)}, key=lambda p: (hashlib.md5(str(p).encode()).hexdigest(), p))
        name = f"42:{site}" + (f":{genre}" if per_cell else "")
        number = int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
        for i in range(9):
            assert got[site, genre, i] == plain_weights(number, mine, i, block)


@pytest.mark.parametrize("block", [5, 1024])
def test_means_are_those_of_the_weights(spark, block):
    ranks = made(spark)
    w = bootstrap.weights(ranks, 30, block=block)
    each = w.join(ranks, ["site", "patient"]).groupBy("replicate", "site", "genre", "model")
    want = {tuple(r)[:4]: (r.rr, r.hit1) for r in each.agg((F.sum(F.col("w") * F.col("rr")) / F.sum("w")).alias("rr"), (F.sum(F.col("w") * F.col("hit1")) / F.sum("w")).alias("hit1")).collect()}
    got = {tuple(r)[:4]: (r.rr, r.hit1) for r in bootstrap.boot_means(ranks, 30, values=("rr", "hit1"), block=block).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-11) for k in want)


def test_weights_are_multinomial():
    n, reps, block = 600, 4000, 64
    parts = bootstrap.split(12345, n, np.arange(reps), block)
    assert (parts.sum(axis=1) == n).all()
    w = np.zeros((reps, n))
    for b in range(parts.shape[1]):
        size = min(block, n - b * block)
        for x, y, part in bootstrap.dealt(12345, b, size, np.arange(reps), parts[:, b]):
            w[x:y, b * block : b * block + size] = part
    assert (w.sum(axis=1) == n).all()
    assert abs(w.mean(axis=0) - 1).max() < 0.1 and abs(w.var() - (1 - 1 / n)) < 0.01
    c = np.corrcoef(w[:, :40].T)
    assert abs(c[~np.eye(40, dtype=bool)]).max() < 0.08  # patients
    c = np.corrcoef(w[:200])
    assert abs(c[~np.eye(200, dtype=bool)]).max() < 0.22  # replicates


def test_draws_are_the_same_in_any_runs(monkeypatch):
    counts = np.array([3, 0, 7, 40, 2, 0])
    whole = np.concatenate([w for *_, w in bootstrap.dealt(7, 2, 10, np.arange(6), counts)])
    monkeypatch.setattr(bootstrap, "DRAWS", 8)
    assert np.array_equal(np.concatenate([w for *_, w in bootstrap.dealt(7, 2, 10, np.arange(6), counts)]), whole)
    assert whole.sum(axis=1).tolist() == counts.tolist()


def test_rows_without_a_patient_do_not_count(spark):
    ranks = made(spark, 8)
    more = ranks.union(ranks.withColumn("patient", F.lit(None).cast("long")))
    columns = ["replicate", "site", "genre", "model", "rr"]
    assert {tuple(r) for r in bootstrap.boot_means(more, 5).select(columns).collect()} == {tuple(r) for r in bootstrap.boot_means(ranks, 5).select(columns).collect()}


def test_many_patients(spark):
    ranks = spark.range(60_000).selectExpr("cast(id % 2 as int) site", "'g' genre", "'m' model", "id doc_idx", "id patient", "(id % 10) / 10D rr", "1 hit1")
    got = bootstrap.boot_means(ranks, 40).groupBy("site").agg(F.count("*").alias("n"), F.avg("rr").alias("mean"), F.stddev("rr").alias("sd")).collect()
    exact = {0: 0.4, 1: 0.5}
    for r in got:
        assert r.n == 40 and abs(r["mean"] - exact[r.site]) < 0.002 and 0.0008 < r.sd < 0.0028
