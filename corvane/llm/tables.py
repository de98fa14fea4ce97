"""Reading inputs, cutting lineage, and other small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the warehouse, which all executors share as well: a folder of
    one machine would lose tables on a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/corvane-work"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table survives lost executors and has no lineage, so nothing upstream is
    computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it, such that no column of ``df`` is called so in any capitals."""
    taken, n = {c.lower() for c in df.columns}, 0
    while f"{name}{n or ''}".lower() in taken:
        n += 1
    return f"{name}{n or ''}"


def mapped_rows(df: DataFrame, run, known: tuple[str, ...] = ("doc_id", "text", "n_chars")) -> DataFrame:
    """``df`` after ``run`` of its Arrow batches, which have its columns; those but for ``known`` go by other names there, as Spark can't pass on every name."""
    plain = df.toDF(*[c if c in known else f"column_{i}" for i, c in enumerate(df.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def held_out_bucket(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Lists of up to so many rows that go are sent to every task; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, gone: DataFrame, on) -> DataFrame:
    """The rows that match none of ``gone``, which is a written table; rows aren't shuffled where that is short."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")
