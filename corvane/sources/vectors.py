"""Stored vectors of queries and of document windows, bucketed and sorted by what they are joined on.

Both are stages: a table is told by what it is made of (versions of the texts, the model, its
prefixes and pooling), so one of other inputs is never taken, and the encoder runs only where there
is none. Queries and windows of one number of buckets meet without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stages

KEYS = ("site", "genre", "model", "doc_idx")
QUERY, CHUNK = (*KEYS, "v"), (*KEYS, "chunk_no", "v")
ROWS_A_BUCKET = 1_000_000


def buckets_for(rows: int) -> int:
    """A power of two, so that stores of different sizes still fit each other."""
    return 1 << (max(1, -(-rows // ROWS_A_BUCKET)) - 1).bit_length()


def _checked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns that aren't there: {', '.join(missing)}")
    return df.select(*columns)


def stored_queries(stages: Stages, made_of: Sequence[str], make: Callable[[], DataFrame], buckets: int = 1) -> DataFrame:
    """The query vectors: one for each of ``KEYS``."""
    return stages.bucketed("query_vectors", made_of, lambda: _checked(make(), QUERY), KEYS, buckets)


def stored_chunks(stages: Stages, made_of: Sequence[str], make: Callable[[], DataFrame], buckets: int = 1) -> DataFrame:
    """The window vectors: any number for each of ``KEYS``, told apart by ``chunk_no``."""
    return stages.bucketed("chunk_vectors", made_of, lambda: _checked(make(), CHUNK), KEYS, buckets)


def by_position(chunks: DataFrame) -> DataFrame:
    """The window vectors of one cell and model as ``v, ids``: in order of documents and windows, with each one's document."""
    return chunks.orderBy("doc_idx", "chunk_no").select("v", F.col("doc_idx").alias("ids"))
