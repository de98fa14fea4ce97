"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length one; zero vectors stay zero."""
    size = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x.cast("double") / size)


def mean_vector(grouped, v: str = "v"):
    """The mean of each group's vectors: positions are averaged apart, so a group may have any number of rows.

    ``grouped`` is (frame, keys); returns the keys and ``v``.
    """
    frame, keys = grouped
    parts = frame.select(*keys, F.posexplode(v).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs")).select(*keys, F.transform("xs", lambda p: p["x"]).alias("v"))
