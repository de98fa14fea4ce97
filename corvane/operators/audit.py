"""Structural audits of note tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bucket_label, holds_prefix, norm_key
from .sampling import CELL


def distinct_counts(notes: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Rows, and exact distinct note keys, texts, normalised texts and patients, for each cell.

    A row gives a digest for each of these, and equal ones of a cell meet in one pass: tasks
    merge their own first, so copies are shuffled once a task. Nulls don't count, as in ``count(DISTINCT)``.
    """
    what = {"n_keys": F.col("src_order").cast("string"), "n_texts": F.sha2("text", 256), "n_normalised": F.sha2(norm_key(F.col("text")), 256), "n_patients": F.col("patient").cast("string")}
    each = F.array(F.struct(F.lit("n_rows").alias("what"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in what.items()])
    met = notes.select(*keys, F.inline(each)).groupBy(*keys, "what", "value").agg(F.count("*").alias("n"))
    counts = [F.sum(F.when(F.col("what") == "n_rows", F.col("n"))).alias("n_rows")]
    counts += [F.count_if((F.col("what") == k) & F.col("value").isNotNull()).alias(k) for k in what]
    return met.groupBy(*keys).agg(*counts)


def docs_per_patient(notes: DataFrame, keys: list[str] = CELL, warn: float = 0.05) -> DataFrame:
    """Median and largest number of documents of a patient, the share with several, and whether that is over ``warn``."""
    each = notes.groupBy(*keys, "patient").agg(F.count("*").alias("n"))
    share = F.avg((F.col("n") > 1).cast("int"))
    return each.groupBy(*keys).agg(F.percentile("n", F.lit(0.5)).alias("median_docs"), F.max("n").alias("max_docs"), share.alias("share_several"), (share > warn).alias("clustered"))


def year_histogram(notes: DataFrame, width: int = 5) -> DataFrame:
    return notes.where("year is not null").groupBy(bucket_label(F.col("year"), width).alias("bucket")).agg(F.count("*").alias("n"))


def era(notes: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Years of each cell that are there and not 0: range, median, shares of the studied era, and whether dates look shifted."""
    y = F.col("year")
    return notes.where("year is not null and year <> 0").groupBy(*keys).agg(
        F.min(y).alias("min_year"),
        F.max(y).alias("max_year"),
        F.percentile(y, F.lit(0.5)).alias("median_year"),
        F.avg(y.between(2008, 2019).cast("int")).alias("share_era"),
        F.avg((y < 2020).cast("int")).alias("share_before_2020"),
        (F.min(y) > 2090).alias("shifted"),
        F.count("*").alias("n"),
    )


def roll_up(notes: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Raw and unique rows of each cell, what deduplication drops, and the least unique count as the bound of a matched size."""
    counts = distinct_counts(notes, keys).select(*keys, "n_rows", "n_normalised", (F.col("n_rows") - F.col("n_normalised")).alias("n_dropped"))
    return counts.crossJoin(F.broadcast(counts.agg(F.min("n_normalised").alias("matched_bound"))))  # one number


def leaks(pairs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """How many targets still hold the head of their query, for each cell."""
    return pairs.groupBy(*keys).agg(F.count_if(holds_prefix(F.col("query"), F.col("target"))).alias("n_leaks"), F.count("*").alias("n"))


def truncation(texts: DataFrame, keys: list[str], limit: int = 512) -> DataFrame:
    """The share of texts whose tokens, with two marks added, reach the encoder's limit."""
    return texts.groupBy(*keys).agg(F.avg((F.col("n_tokens") + 2 >= limit).cast("int")).alias("share_truncated"), F.count("*").alias("n"))


def observed_truncation(texts: DataFrame, observation: Observation, cells: list[tuple], keys: list[str] = CELL, limit: int = 512) -> DataFrame:
    """``texts``, whose ``n_tokens`` are counted as they pass by: ``truncation`` without a scan of its own.

    ``cells`` are the values of ``keys`` to count apart; ``truncation_seen`` has the counts once an action has run.
    """
    counts = []
    for i, cell in enumerate(cells):
        here = F.lit(True)
        for k, v in zip(keys, cell, strict=True):
            here = here & (F.col(k) == F.lit(v))
        counts += [F.count_if(here).alias(f"n_{i}"), F.count_if(here & (F.col("n_tokens") + 2 >= limit)).alias(f"cut_{i}")]
    return texts.observe(observation, *counts)


def truncation_seen(like: DataFrame, observation: Observation, cells: list[tuple], keys: list[str] = CELL) -> DataFrame:
    """``keys, share_truncated, n`` of the observed cells that have texts; ``like`` has the keys' types."""
    seen = observation.get  # waits for the action
    rows = [(*cell, seen[f"cut_{i}"] / seen[f"n_{i}"], seen[f"n_{i}"]) for i, cell in enumerate(cells) if seen[f"n_{i}"]]
    return like.sparkSession.createDataFrame(rows, T.StructType([*[like.schema[k] for k in keys], T.StructField("share_truncated", T.DoubleType()), T.StructField("n", T.LongType())]))


def encounters(rows: DataFrame, keys: list[str], patient: str = "patient") -> DataFrame:
    """Encounters (rows) and patients, and encounters a patient: median, most, and the share of patients with several."""
    each = rows.where(F.col(patient).isNotNull()).groupBy(*keys, patient).agg(F.count("*").alias("n"))
    per = each.groupBy(*keys).agg(F.count("*").alias("n_patients"), F.percentile("n", F.lit(0.5)).alias("median_encounters"), F.max("n").alias("max_encounters"), F.avg((F.col("n") > 1).cast("int")).alias("share_several"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_encounters")).join(per, keys, "left")
