"""Deduplication, attrition counts and exact-size seeded samples within cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key

CELL = ["site", "genre"]
MIN_CHARS = 400
SEED = 42


def scan_notes(notes: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows whose text is there and has at least ``min_chars`` characters."""
    return notes.where(F.col("text").isNotNull() & (F.length("text") >= min_chars))


def dedup_keep_first(notes: DataFrame, keys: list[str] = CELL, order: str = "src_order") -> DataFrame:
    """Of the rows of a cell that share a normalised text, the first in input order.

    A minimum per key, not a window over whole texts: only keys and order numbers
    are shuffled with partial aggregation, and the rows are then semi-joined.
    """
    keyed = notes.withColumn("key", F.sha2(norm_key(F.col("text")), 256))
    first = keyed.groupBy(*keys, "key").agg(F.min(order).alias(order))
    return keyed.join(first, [*keys, "key", order], "left_semi").drop("key")


def first_ids(notes: DataFrame, keys: list[str] = CELL, order: str = "src_order") -> DataFrame:
    """``keys, order`` of the rows that ``dedup_keep_first`` keeps, where ``order`` tells the rows of a cell apart."""
    return notes.groupBy(*keys, F.sha2(norm_key(F.col("text")), 256).alias("key")).agg(F.min(order).alias(order)).select(*keys, order)


def attrition(notes: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Rows before and after deduplication, and the difference, for each cell."""
    counts = notes.groupBy(*keys).agg(F.count("*").alias("n_before"), F.countDistinct(F.sha2(norm_key(F.col("text")), 256)).alias("n_after"))
    return counts.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def draw(seed: int, *parts: str | Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def equal_samples(rows: DataFrame, keys: list[str] = CELL, by: str = "src_order", seed: int = SEED, size: int | None = None, index: str | None = None) -> DataFrame:
    """Exactly as many rows of every cell as the smallest cell has (or ``size``), in a seeded order.

    The order is of hashes, so the sample is the same however the rows are
    partitioned. ``by`` tells the rows of a cell apart. ``index`` names a column for the
    place in the sample, from 0. Places are found among ids and hashes alone: rows are
    counted by ranges of hashes, ranges beyond the cut are left out, and the others are
    ordered each for itself; the chosen ids are then joined to their rows.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string")))
    ids = rows.select(*keys, by, h.alias("h")).withColumn("range", F.substring("h", 1, 3))
    counts = ids.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4,096 ranges at most
    counts = counts.withColumn("before", before)
    if size is None:
        smallest = rows.groupBy(*keys).count().agg(F.min("count").alias("least"))
        counts = counts.crossJoin(F.broadcast(smallest))  # one number
    else:
        counts = counts.withColumn("least", F.lit(size))
    near = ids.join(counts.where("before < least").select(*keys, "range", "before", "least"), [*keys, "range"])
    place = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "range").orderBy("h", by))
    chosen = near.withColumn("place", place).where(F.col("place") <= F.col("least"))
    chosen = chosen.select(*keys, by, *([(F.col("place") - 1).cast("bigint").alias(index)] if index else []))
    return rows.join(chosen, [*keys, by])
