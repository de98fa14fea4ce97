"""The corpus pipeline: filters, redaction and packing of ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. Toxic documents, all but one
document of each near-duplicate group, and contaminated documents go; secrets are
blanked out of the texts; what is left is packed into sequences.

Edge cases: null and empty texts aren't toxic and hold no secret or benchmark words;
they are near-duplicates of each other, so one of them stays and is packed as the end
token alone; texts of any length are processed whole; of a near-duplicate group the row
of the smallest id stays, of equal ids the first, and a null id stays only where no other
is in the group, so of repeated rows one stays; rows of one id and different texts are
judged each; extra columns, whatever their names, are kept up to packing; empty
documents give no rows; without labels nothing is toxic, and without benchmark items
nothing is contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, packing, secrets, simhash, toxicity
from corvane.llm.tables import read, shared_dir


#: Documents that Spark hands to Python at once: a few MB of text, of which both sides hold several copies.
ROWS_A_BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's batches for this program: a stage's rows are made when they are written, so it can't be set back here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return secrets.redact(docs, secrets.train(secrets.labelled_samples(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer are no SQL; the tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = read(spark, sf_dir, "documents")
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
