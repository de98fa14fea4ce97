"""Tables that several steps share: made once, stored with a commit marker, and taken again while what they are made of is the same.

A stage is told by its name and by what it is made of: versions of its sources, parameters,
and the library's own code. Each attempt writes to a folder of its own; a
marker, written after that, names the folder of a whole attempt. So a table that a
lost driver left unfinished, that came from other inputs, or that something else put there is never taken,
and two jobs that make one stage at a time do no harm.

Bucketed stages are sorted tables of the catalog whose rows are dealt by a hash of their
keys, so that stages with the same keys and buckets are joined and grouped without a
shuffle. A session that doesn't know such a table yet attaches it by its marker.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "path string, schema string, made_of string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or else the warehouse, which must be shared too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/corvane-work"


@functools.cache
def code_version() -> str:
    """A digest of the library's own code, part of every fingerprint: a table that older code made isn't taken."""
    digest = hashlib.sha256()
    for folder in ("functions", "operators", "plans", "sources"):
        for at in sorted(resources.files("corvane").joinpath(folder).iterdir(), key=lambda x: x.name):
            if at.name.endswith(".py"):
                digest.update(f"{folder}/{at.name}\n".encode() + at.read_bytes())
    return digest.hexdigest()


def fingerprint(*made_of: str) -> str:
    return hashlib.sha256(json.dumps([code_version(), *made_of]).encode()).hexdigest()[:32]


def source_version(table: DataFrame) -> str:
    """A digest of the files that a table is read from, of their paths, sizes and times.

    ``table`` is what a reader gives. Files are told apart and added up by tasks; one row comes back.
    """
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), "file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))
    return fingerprint(*map(str, files.agg(F.count("*"), h("a"), h("b")).first()))


class Stages:
    """Stored stages of one folder. ``made`` lists the names of those that this object had to make."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.made = spark, f"{folder or shared_folder(spark)}/corvane-stages", []

    def _marker(self, name: str, key: str) -> str:
        return f"{self.folder}/{name}-{key}.commit"

    def _committed(self, name: str, key: str, made_of: Sequence[str]):
        """The marker's path and schema, if there is one and its table is there."""
        try:
            row = self.spark.read.json(self._marker(name, key), schema=MARKER).first()
            if row is None or row["made_of"] != json.dumps(list(made_of)):
                return None
            schema = T.StructType.fromJson(json.loads(row["schema"]))
            self.spark.read.schema(schema).parquet(row["path"])  # lists the folder, and fails where it is gone
        except AnalysisException:
            return None
        return row["path"], schema

    def _commit(self, name: str, key: str, made_of: Sequence[str], path: str, schema: T.StructType) -> None:
        row = (path, schema.json(), json.dumps(list(made_of)))
        self.spark.createDataFrame([row], MARKER).coalesce(1).write.mode("overwrite").json(self._marker(name, key))
        self.made.append(name)

    def table(self, name: str, made_of: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
        """The stage as stored; made and stored first if it isn't there."""
        key = fingerprint(name, *made_of)
        found = self._committed(name, key, made_of)
        if found is None:
            df, path = make(), f"{self.folder}/{name}-{key}/{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(path)
            found = path, df.schema
            self._commit(name, key, made_of, *found)
        path, schema = found
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, name: str, made_of: Sequence[str], make: Callable[[], DataFrame], keys: Sequence[str], buckets: int) -> DataFrame:
        """The stage as a table of ``buckets`` buckets by ``keys``, one sorted file each."""
        made_of = [*made_of, f"{buckets} buckets by {', '.join(keys)}"]
        key = fingerprint(name, *made_of)
        table = f"corvane_{name}_{key}"
        found = self._committed(name, key, made_of)
        known = self.spark.catalog.tableExists(table)
        if found is None:
            if known:
                self.spark.sql(f"DROP TABLE `{table}`")
            df, path = make(), f"{self.folder}/{name}-{key}/{uuid.uuid4().hex}"
            dealt = df.repartition(buckets, *keys)  # as the buckets are, so that each is one file
            dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
            self._commit(name, key, made_of, path, df.schema)
        elif not known:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found[1].fields)
            by = ", ".join(f"`{k}`" for k in keys)
            self.spark.sql(f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{found[0]}'")
        return self.spark.table(table)
