"""Centroid clustering over weighted distinct vectors, in whole numbers throughout.

Components become integers, ``floor(SCALE * x)``. Equal integer vectors are one point
with a multiplicity, told apart by a SHA-256 of their components, so copies cost nothing
in a round. A round sends the centroids (``k`` short vectors) to the tasks; each gives the
weighted integer sums of its points by nearest centroid, at most ``k`` rows, which add up in
Spark as decimals. Distances and sums are exact, so results don't depend on how points are
dealt over tasks. Assignments are joined back to the rows by the points' digests; those of
points with so many copies that they would swamp a task are few by their number alone, and
are sent to the rows instead.

Edge cases: vectors of another length than ``dim``, and those that are null or hold null or
non-finite components, take no part; components whose integer lies beyond plus or minus
2^27 (for 64 components) count as that bound, so that squared distances fit a long, and sums
of distances beyond a long count as the largest long; fewer rows than ``k`` are as many
centroids; rows of one id are a vector each, tie for a place among the first
centroids, and go by their components; equal centroids are kept, and the smaller number takes
their points; a null id counts as the empty text there; extra columns are ignored; no
vectors give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Points with more copies than this, and than one part in ``HEAVY_KEYS`` of all rows, are sent to the rows; fewer than ``HEAVY_KEYS`` can be.
HEAVY_ROWS, HEAVY_KEYS = 10_000, 100_000
MOST = (1 << 63) - 1


def bound(dim: int) -> int:
    """The largest component for which squared distances of ``dim`` components fit a long."""
    return 1 << (61 - math.ceil(math.log2(max(1, dim)))) // 2


def quantised(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, q, key``: the integer vector of each usable row, and its digest."""
    top = float(bound(dim))
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = v.where(f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    q = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-top)), F.lit(top))).cast("int"))
    return good.select("vec_id", q.alias("q")).withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("q", lambda x: x.cast("string")), ","), 256)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance; exact."""
    large = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * q.shape[1] * large**2 < 1 << 53:  # doubles hold all of these whole numbers
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        d = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def _sums(centroids: np.ndarray):
    """Points to a row for each cluster: rows that it stands for and sums of components; more rows where a sum would pass a long."""
    k, dim = centroids.shape

    def rows(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        cells = pa.FixedSizeListArray.from_arrays(pa.array(sums[at].reshape(-1)), dim).cast(pa.list_(pa.int64()))
        return pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at]), cells], ["cluster", "n", "sums"])

    def run(batches):
        counts, sums, reach = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            q, w = _matrix(batch.column("q")), batch.column("w").to_numpy()
            more = int(np.abs(q).max(initial=1)) * int(w.sum())
            if reach + more > MOST // 2:
                yield rows(counts, sums)
                counts, sums, reach = np.zeros_like(counts), np.zeros_like(sums), 0
            reach += more
            at, _ = nearest(q, centroids)
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            counts[found] += np.add.reduceat(w[order], first)
            sums[found] += np.add.reduceat((q * w[:, None])[order], first, axis=0)
        yield rows(counts, sums)

    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, d = nearest(_matrix(batch.column("q")), centroids)
                yield pa.record_batch([batch.column("key"), batch.column("w"), pa.array(at.astype(np.int32)), pa.array(d)], ["key", "w", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``k`` rows whose seeded SHA-256 of the id is smallest, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k rows
    return np.array([r["q"] for r in chosen], np.int64)


def lloyd(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds over ``q, w`` points; a mean is rounded down, and an empty centroid stays."""
    dim = centroids.shape[1]
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    for _ in range(rounds):
        parts = points.select("q", "w").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        totals = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), *[exact(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)])
        centroids = centroids.copy()
        for r in totals.collect():  # at most k rows
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dim)]
    return centroids


def joined(rows: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """``rows`` with what ``points`` (``key, w`` and more, a row for each key) has; no task gets all copies of a point."""
    most = max(HEAVY_ROWS, n // HEAVY_KEYS)
    heavy, light = points.where(F.col("w") > most).drop("w"), points.where(F.col("w") <= most).drop("w")
    if heavy.isEmpty():
        return rows.join(light, "key")
    heavy = F.broadcast(heavy)  # fewer than HEAVY_KEYS rows: their copies alone are n
    return rows.join(heavy, "key").unionByName(rows.join(heavy.select("key"), "key", "left_anti").join(light, "key"))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable vector."""
    rows = materialize(quantised(vectors, dim, scale), "quantised")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    points = materialize(rows.groupBy("key", "q").agg(F.count("*").alias("w")), "points")
    centroids = lloyd(points, centroids, rounds)
    assigned = materialize(points.mapInArrow(_assign(centroids), "key binary, w long, cluster int, distance long"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)"))
    of = {r["cluster"]: (r["n"], int(r["inertia"])) for r in assigned.groupBy("cluster").agg(F.sum("w").alias("n"), exact.alias("inertia")).collect()}  # at most k rows
    total = min(MOST, sum(x for _, x in of.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(c, min(MOST, x), total, digest(centroids[c])) for c, (_, x) in of.items()]
    told = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    each = joined(rows.select("vec_id", "key"), assigned, sum(n for n, _ in of.values()))
    return each.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL, without weights."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(c, (d, c)) AS c, min(d)::BIGINT AS d FROM (SELECT v.row, v.vec_id, v.q, c.c, {distance} AS d FROM v, c{i} c) GROUP BY row)"""

    steps = []
    for i in range(rounds):
        steps.append(assigned(i))
        mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
        steps.append(f"""m{i} AS (SELECT c, list({mean} ORDER BY pos) AS q FROM (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({dim})) AS pos FROM a{i}) GROUP BY ALL) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m{i}.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} ON m{i}.c = c.c)""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k})),
{", ".join(steps)}, {assigned(rounds)}
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
