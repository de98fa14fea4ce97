"""Centroid clustering, against a plain version in Python's whole numbers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from corvane.llm import centroids

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, m, strict=True)) for m in c]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, i) in zip(kept, at, strict=True) if i == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    each = {j: sum(d for d, i in at if i == j) for _, j in at}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, each[j], sum(each.values()), digest[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], f"vec_id long, embedding array<{kind}>, key string, w long, cluster int").repartition(3)


def made(n, seed=1, spread=1.0):
    return [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, 64)) * spread)]


def test_equals_the_plain_version(spark):
    rows = made(120)
    rows += [(500 + i, rows[i % 3][1]) for i in range(40)] + [(7, rows[3][1]), (7, rows[9][1]), (None, rows[5][1])]
    rows += [(600, None), (601, [0.5] * 63), (602, [0.5] * 63 + [None]), (603, [math.nan] * 64), (604, [math.inf] * 64), (605, []), (606, [0.0] * 64), (607, [-0.0] * 64)]
    assert found(centroids.cluster(frame(spark, rows))) == plain(rows)


def test_fewer_rows_than_centroids_and_equal_ones(spark):
    rows = [(i, [float(i // 2)] * 64) for i in range(9)]
    assert found(centroids.cluster(frame(spark, rows))) == plain(rows)


def test_no_usable_rows(spark):
    df = centroids.cluster(frame(spark, [(1, None)]))
    assert found(df) == [] and set(COLUMNS) <= set(df.columns)


def test_points_with_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(centroids, "HEAVY_ROWS", 20)
    rows = made(50, 2)
    rows += [(100 + i, rows[0][1]) for i in range(60)] + [(200 + i, rows[1][1]) for i in range(21)]
    assert found(centroids.cluster(frame(spark, rows))) == plain(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, v) for i, v in made(60, 3, 1e5)]
    assert max(abs(x) for _, v in rows for x in v) * 256 > 1 << 26
    assert found(centroids.cluster(frame(spark, rows))) == plain(rows)


def test_components_beyond_the_bound_count_as_the_bound(spark):
    top = centroids.bound(64)
    rows = made(45, 4) + [(100, [1e300] * 64), (101, [-1e300] * 64)]
    held = made(45, 4) + [(100, [top / 256] * 64), (101, [-top / 256] * 64)]
    got = found(centroids.cluster(frame(spark, rows)))
    most = (1 << 63) - 1
    assert got == [(*r[:3], min(most, r[3]), min(most, r[4]), r[5]) for r in plain(held)]


def test_sums_that_would_pass_a_long(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(centroids, "MOST", 1500)
    q = np.arange(40).reshape(20, 2)
    batch = lambda a, b: pa.record_batch([pa.array(q[a:b].tolist()), pa.array(np.full(b - a, 3))], ["q", "w"])
    rows = list(centroids._sums(np.array([[0, 0], [30, 30]]))([batch(0, 10), batch(10, 15), batch(15, 20)]))
    assert len(rows) > 1
    total = sum(np.array(r.column("sums").to_pylist()).sum() for r in rows)
    assert total == 3 * q.sum() and sum(sum(r.column("n").to_pylist()) for r in rows) == 60


@pytest.mark.parametrize("big", [False, True])
def test_nearest_is_exact_and_takes_the_first_of_equals(big):
    q = np.array([[0, 0], [5, 5], [10, 10]]) * ((1 << 27) // 10 if big else 1)
    c = np.array([q[2], q[0], q[0]])
    at, d = centroids.nearest(q, c)
    assert at.tolist() == [1, 0, 0] and d.tolist() == [0, int(((q[2] - q[1]) ** 2).sum()), 0]


def test_sql_of_the_whole_table(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = c.sql(centroids.oracle_sql())
    want = sorted((tuple(r[rel.columns.index(x)] for x in COLUMNS) for r in rel.fetchall()), key=repr)
    assert found(centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))) == want
