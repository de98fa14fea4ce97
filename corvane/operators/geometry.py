"""Shape of an embedding space: anisotropy, null slopes, and scores after mean-centring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import TINY, mean_vector, unit
from .sampling import draw
from .scoring import KEYS, null_curve
from .tiles import SLICE, cells, matrix


def sample_windows(chunks: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` windows of each cell and model, in the order of seeded hashes."""
    order = Window.partitionBy(*KEYS).orderBy(draw(seed, *KEYS, "doc_idx", "chunk_no"), "doc_idx", "chunk_no")
    chosen = chunks.select(*KEYS, "doc_idx", "chunk_no").withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return chunks.join(chosen, [*KEYS, "doc_idx", "chunk_no"])  # only numbers were ordered


def quantile(values: Callable[[], Iterator[np.ndarray]], n: int, p: float, few: int = 1 << 21, bins: int = 4096) -> float:
    """The exact percentile, linear between neighbours, of ``n`` numbers that ``values`` gives in pieces, as often as asked; holds ``few`` at most."""

    def at(k: int) -> float:
        low, high, below, inside = -np.inf, np.inf, 0, n
        within = lambda: (x[(x >= low) & (x <= high)] for x in values())
        while inside > few:
            ends = [(x.min(), x.max()) for x in within() if len(x)]
            low, high = min(e[0] for e in ends), max(e[1] for e in ends)
            if low == high:
                return float(low)
            place = lambda x: np.minimum(bins - 1, ((x / 2 - low / 2) / (high / 2 - low / 2) * bins).astype(np.int64))  # noqa: B023, E731
            counts = sum(np.bincount(place(x), minlength=bins) for x in within())
            chosen = int(np.searchsorted(np.cumsum(counts), k - below, "right"))
            held = [(y.min(), y.max()) for y in (x[place(x) == chosen] for x in within()) if len(y)]
            below, inside = below + int(counts[:chosen].sum()), int(counts[chosen])
            low, high = min(e[0] for e in held), max(e[1] for e in held)
        return float(np.partition(np.concatenate(list(within())), k - below)[k - below])

    rank = p * (n - 1)
    low, high = math.floor(rank), math.ceil(rank)
    a = at(low)
    b = a if low == high else at(high)
    return a if a == b else (high - rank) * a + (rank - low) * b


def _cosines(u: np.ndarray, entries: int = SLICE) -> Iterator[np.ndarray]:
    """The cosines of each pair of rows of unit length once, some rows at a time."""
    step = max(1, entries // max(1, len(u)))
    for a in range(0, len(u), step):
        s = u[a : a + step] @ u.T
        yield s[np.arange(len(u)) > np.arange(a, a + len(s))[:, None]]


def _shape(sample: DataFrame, pairs: bool) -> DataFrame:
    """Statistics of each cell and model's windows, which are a sample of bounded size, so a task has them together."""
    schema, kinds = cells(sample)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        v = matrix(t["v"])
        size = np.sqrt(np.einsum("ij,ij->i", v, v))
        u = v / np.maximum(size, TINY)[:, None]
        n, total = len(u), u.sum(axis=0)
        centre = total / n
        centre = centre / max(float(np.sqrt(centre @ centre)), TINY)
        mean = (total @ total - np.einsum("ij,ij->", u, u)) / (n * (n - 1)) if n > 1 else None
        p95 = quantile(lambda: _cosines(u), n * (n - 1) // 2, 0.95) if pairs and n > 1 else None
        values = {"mean_cos": mean, "p95_cos": p95, "mean_norm": size.mean(), "centroid_cos": (u @ centre).mean()}
        return pa.table({**{c: pa.array([key[i].as_py()], kinds[c]) for i, c in enumerate(KEYS)}, **{k: pa.array([x], pa.float64()) for k, x in values.items()}})

    return sample.select(*KEYS, "v").groupBy(*KEYS).applyInArrow(run, f"{schema}, mean_cos double, p95_cos double, mean_norm double, centroid_cos double")


def offdiagonal(chunks: DataFrame, size: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and 95th percentile of the cosines of distinct windows of a bounded sample, for each cell and model that has two."""
    return anisotropy(chunks, size, seed).select(*KEYS, "mean_cos", "p95_cos")


def mean_cosine(chunks: DataFrame, size: int = 2000, seed: int = 42) -> DataFrame:
    """The mean of ``offdiagonal`` in closed form, with no pairs: (|sum u|^2 - sum |u|^2) / (n (n - 1)); null for a single window."""
    return _shape(sample_windows(chunks, size, seed), False).select(*KEYS, "mean_cos")


def anisotropy(chunks: DataFrame, size: int = 2000, seed: int = 42) -> DataFrame:
    """``offdiagonal`` with the mean norm and the mean cosine to the normalised centroid of unit vectors."""
    return _shape(sample_windows(chunks, size, seed), True).where("mean_cos is not null")


def anisotropy_label(mean: Column) -> Column:
    return F.when(mean < 0.25, "isotropic").when(mean < 0.5, "mild").otherwise("anisotropic")


def null_slope(queries: DataFrame, chunks: DataFrame, sample: int = 800, seed: int = 42, long: int = 5) -> DataFrame:
    """The null curve's floor (at the least k), its mean over documents of ``long`` windows or more, and their difference and ratio."""
    curve = null_curve(queries, chunks, sample, seed)
    far = F.col("k") >= long
    high = F.try_divide(F.sum(F.when(far, F.col("null_mean") * F.col("n"))), F.sum(F.when(far, F.col("n"))))
    out = curve.groupBy(*KEYS).agg(F.min_by("null_mean", "k").alias("floor"), high.alias("high"))
    slope = F.col("high") - F.col("floor")
    return out.select(*KEYS, "floor", "high", slope.alias("slope"), F.try_divide(slope, F.nullif(F.col("floor"), F.lit(0.0))).alias("ratio"))


def centred(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides less the mean of the cell's windows, at length one again."""
    mean = mean_vector((chunks, KEYS)).select(*KEYS, F.col("v").alias("mu"))
    less = lambda df: df.join(F.broadcast(mean), KEYS).withColumn("v", unit(F.zip_with("v", "mu", lambda x, m: x.cast("double") - m))).drop("mu")  # noqa: E731  a vector for each cell and model
    return less(queries), less(chunks)
