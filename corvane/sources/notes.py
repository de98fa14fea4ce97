"""Note tables from CSV files, and cells, ranks and results to and from storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import scan_notes

LONG_NOTES = T.StructType([T.StructField(c, T.StringType()) for c in ("note_id", "subject_id", "text", "charttime")])
#: Of the wide encounter table: genre, its text, its year and its key.
WIDE_GENRES = (("discharge", "Discharge_Summary_Text", "Discharge_Summary_Year", "Discharge_Summary_Note_Key"), ("imaging", "Imaging_Text", "Imaging_Year", "Imaging_Key"))
CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def _patient(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def read_long_notes(spark: SparkSession, path: str, site: str, genre: str, min_chars: int = 400) -> DataFrame:
    """Notes of one genre from a (gzipped) CSV of a note a row; a time that can't be read gives no year."""
    raw = spark.read.csv(path, schema=LONG_NOTES, **CSV)
    notes = scan_notes(raw, min_chars)
    return notes.select(F.lit(site).alias("site"), F.lit(genre).alias("genre"), F.col("note_id").alias("doc_key"), "text", _patient("subject_id").alias("patient"), F.year(F.try_to_timestamp("charttime")).alias("year"), F.monotonically_increasing_id().alias("src_order"))


def read_wide_notes(spark: SparkSession, path: str, site: str, patient: str = "patientdurablekey", genres=WIDE_GENRES, min_chars: int = 400) -> DataFrame:
    """Notes of every genre from one scan of a wide encounter CSV; missing key columns give null keys."""
    raw = spark.read.csv(path, inferSchema=False, **CSV).withColumn("src_order", F.monotonically_increasing_id())
    missing = [c for _, text, year, _ in genres for c in (text, year) if c not in raw.columns] + [patient] * (patient not in raw.columns)
    if missing:
        raise ValueError(f"columns that aren't there: {', '.join(missing)}")
    key = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(g).alias("genre"), key(k).alias("doc_key"), F.col(t).alias("text"), F.expr(f"try_cast(`{y}` AS DOUBLE)").cast("int").alias("year")) for g, t, y, k in genres])
    rows = raw.select(_patient(patient).alias("patient"), "src_order", F.explode(each).alias("n"))
    return scan_notes(rows.select(F.lit(site).alias("site"), "n.genre", "n.doc_key", "n.text", "patient", "n.year", "src_order"), min_chars)


def write_cells(items: DataFrame, path: str) -> None:
    """Matched items, partitioned so that a cell is read alone."""
    items.write.mode("overwrite").partitionBy("site", "genre").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_cell_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of the one-document layout: ``{"N": ..., "cells": {"site|genre": [{query, target, patient, year}]}}``; the place in a list is the index."""
    item = "struct<query: string, target: string, patient: string, year: int>"
    raw = spark.read.json(path, multiLine=True, schema=f"N int, cells map<string, array<{item}>>")
    lists = raw.select(F.explode("cells").alias("cell", "items")).select("cell", F.posexplode("items").alias("doc_idx", "i"))
    parts = F.split("cell", "\\|")
    return lists.select(parts[0].alias("site"), parts[1].alias("genre"), F.col("doc_idx").cast("bigint").alias("doc_idx"), "i.query", "i.target", "i.patient", "i.year")


def write_ranks(ranks: DataFrame, path: str) -> None:
    ranks.write.mode("overwrite").partitionBy("model").parquet(path)


def read_ranks(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """Ranks of all models, or of some: only their partitions are read."""
    ranks = spark.read.parquet(path)
    return ranks.where(F.col("model").isin(models)) if models else ranks


def write_mrr_json(cells: DataFrame, path: str) -> None:
    """A line for each cell and model: its name, mean reciprocal rank and interval, and the number of objects ranked where there is one."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in ("site", "genre", "model")])
    obj = ["obj"] if "obj" in cells.columns else []
    cells.select(name.alias("cell"), "mrr", "lo", "hi", *obj).write.mode("overwrite").json(path)


def read_mrr_json(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_mrr_json`` has written, with the name taken apart."""
    raw = spark.read.json(path, schema="cell string, mrr double, lo double, hi double, obj bigint")
    parts = F.split("cell", "\\|")
    return raw.select(*[parts[i].alias(c) for i, c in enumerate(("site", "genre", "model"))], "mrr", "lo", "hi", "obj")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files that the readers above take, texts unchanged."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The model manifest; blanks are empty strings, so that prefixes can be put before texts."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).na.fill("")


def resolved_manifest(manifest: DataFrame, revisions: DataFrame) -> DataFrame:
    """The manifest with ``revision`` and ``revision_secondary`` of its repositories, from ``repo, revision`` rows; blank where there is none. ``write_csv`` stores it."""
    of = lambda repo, out: F.broadcast(revisions.groupBy(F.col("repo").alias(repo)).agg(F.max("revision").alias(out)))  # noqa: E731  a row for each repository of the panel
    rows = manifest.drop("revision", "revision_secondary")
    return rows.join(of("hf_repo", "revision"), "hf_repo", "left").join(of("hf_repo_secondary", "revision_secondary"), "hf_repo_secondary", "left").select(*rows.columns, "revision", "revision_secondary").na.fill("")


def stored_vectors(spark: SparkSession, path: str, make) -> DataFrame:
    """The table of vectors at ``path``; made and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)
