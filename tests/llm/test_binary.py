"""Packing by powers of two."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvane.llm import binary, packing

ROWS = [
    (1, "one two three"),
    (2, None),
    (3, ""),
    (None, "no id here"),
    (1, "one two three"),
    (4, "word and more. " * 3000),
    (5, "<|endoftext|> is a special token"),
    (6, "é ü 漢字 \U0001f600\x00\n"),
]
SCHEMA = "doc_id long, text string, length string, part string, n long"


def plain(rows, capacity=2048, end=1):
    """Each piece's document, start, length, checksum and tokens."""
    own = Tokenizer.from_file(packing.VOCABULARY)
    out = []
    for doc_id, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [end]
        at = 0
        while at < len(ids):
            size = min(capacity, 1 << (len(ids) - at).bit_length() - 1)
            out.append((doc_id, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)))
            at += size
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA).repartition(3)


def test_equals_the_plain_version(spark):
    assert found(binary.pack(frame(spark, ROWS))) == plain(ROWS)


@pytest.mark.parametrize("capacity", [1, 2, 64])
def test_other_capacities(spark, capacity):
    assert found(binary.pack(frame(spark, ROWS[:4]), capacity, 9)) == plain(ROWS[:4], capacity, 9)


def test_a_capacity_that_is_no_power_of_two(spark):
    with pytest.raises(ValueError):
        binary.pack(frame(spark, ROWS), 1000)


def test_sequences_are_buckets_of_one_length_without_a_gap(spark):
    rows = binary.batches(binary.pack(frame(spark, ROWS * 5)), 4096).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert [r.length for r in rows] == sorted((r.length for r in rows), reverse=True)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    for size in {r.length for r in rows}:
        of = [r for r in rows if r.length == size]
        assert [r.number for r in of] == list(range(len(of)))
        assert [r.batch for r in of] == [i // (4096 // size) for i in range(len(of))]


def test_ids_make_up_the_documents(spark):
    rows = binary.pack(spark.createDataFrame(ROWS[4:], "doc_id long, text string"), with_ids=True).orderBy("doc_id", "start").collect()
    for doc_id, text in ROWS[4:]:
        ids = [i for r in rows if r.doc_id == doc_id for i in r.ids]
        assert ids == Tokenizer.from_file(packing.VOCABULARY).encode(text, add_special_tokens=False).ids + [1]


def test_no_documents(spark):
    assert binary.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(binary.pack(docs)) == plain(rows)
