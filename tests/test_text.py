import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import exclusion


def plain_key(s):
    s = "".join(c for c in s.lower() if unicodedata.category(c) != "Nd")
    return re.sub(" +", " ", re.sub("[^a-z ]", " ", s)).strip(" ")


@pytest.mark.parametrize("raw,want", [("A1b", "ab"), ("x-y", "x y"), ("é\n2", ""), ("  Q  ", "q"), ("٣a", "a"), ("", ""), (None, None)])
def test_norm_key_cases(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(T.norm_key(F.col("t"))).first()[0] == want


def test_norm_key_of_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.norm_key(F.col("text")).alias("k")).collect()
    assert all(r.k == plain_key(r.text) for r in rows)


def test_window_counts(spark):
    want = {0: 0, 1: 1, 510: 1, 511: 2, 894: 2, 895: 3}
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in want], "n int").select("n", T.window_count(F.col("n")).alias("c")).collect()}
    assert got == want


def test_windows_cover_and_stop(spark):
    w = spark.range(1).select(T.windows(F.expr("transform(sequence(1, 25), x -> cast(x as string))"), 10, 7)).first()[0]
    assert [(x[0], x[-1]) for x in w] == [("1", "10"), ("8", "17"), ("15", "24"), ("22", "25")]
    assert spark.range(1).select(T.windows(F.expr("cast(array() as array<string>)"))).first()[0] == []


def test_leak_guard(spark):
    rows = [("abcdef ghi", "xx abcdef ghi yy", True), ("12", "anything", False), ("abc", "abd", False), ("a%c", "a c", True)]
    df = spark.createDataFrame([(q, t) for q, t, _ in rows], "q string, t string")
    assert [r[0] for r in df.select(T.holds_prefix(F.col("q"), F.col("t"))).collect()] == [x for *_, x in rows]


Q = "alpha beta gamma delta omega"
CASES = [
    ("a  bb\ncc dd", "bb cc", "a bb cc dd"),  # a short query removes nothing
    (f"start {Q} end", Q, "start end"),
    ("alpha beta gamma xx yy omega " + "pad " * 30 + Q, Q, "pad " * 30 + Q),  # the first place wins even if a later one is better
    ("alpha beta gamma delta omega omega tail", Q, "omega tail"),  # of equals the earliest end
    ("alpha beta gamma beta delta omega x omega tail", Q, "x omega tail"),
    ("x alpha beta gamma delta sigma other words follow here now and then some more of it", "alpha beta gamma delta sigma omega", "x and then some more of it"),  # twice the words that agree
    ("alpha beta gamma delta sigma alpha beta gamma delta sigma tau one two", "alpha beta gamma delta sigma tau omega", "alpha beta gamma delta sigma"),  # the longer agreement
    ("ALPHA, Beta 12 gamma. (delta) omega! rest", Q, "rest"),
    ("nothing of it here", Q, "nothing of it here"),
    ("", Q, ""),
    ("alpha", Q, "alpha"),
    (" \n\t", Q, ""),
    (f"{Q} " * 3, "", f"{Q} {Q} {Q}"),
]


def test_exclusion_cases(spark):
    df = spark.createDataFrame([(i, d, q) for i, (d, q, _) in enumerate(CASES)], "i int, text string, query string")
    got = {r.i: r.target for r in exclusion.without_queries(df, ["i"]).collect()}
    assert [got[i] for i in range(len(CASES))] == [w.strip() for *_, w in CASES]


def test_exclusion_only_ever_removes_one_run(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["ab", "cd", "ef", "gh", "1", "ij."]) for _ in range(r.randrange(40))), " ".join(r.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(r.randrange(9)))) for i in range(300)]
    removed = 0
    for x in exclusion.without_queries(spark.createDataFrame(rows, "i int, text string, query string"), ["i"]).collect():
        doc, kept = x.text.split(), x.target.split()
        removed += len(doc) > len(kept)
        assert any(kept == doc[:i] + doc[i + len(doc) - len(kept) :] for i in range(len(kept) + 1))
    assert removed > 20


def test_exclusion_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", "b")], "i int, text string, query string").where("i > 0")
    assert "ArrowEvalPython" not in exclusion.without_queries(df, ["i"])._jdf.queryExecution().executedPlan().toString()


def test_exclusion_of_a_document_of_one_word(spark):
    df = spark.createDataFrame([(1, "ab " * 20_000, "ab ab ab ab ab ab ab")], "i int, text string, query string")
    assert len(exclusion.without_queries(df, ["i"]).first().target.split()) < 20_000
