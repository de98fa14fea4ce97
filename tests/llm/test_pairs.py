import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, kernels, simhash
from corvane.llm.queries import ORACLE_SQL, op9_decontaminate, op10_simhash

from . import brute

CLASH = "doc_id long, text string, lang string, n int, fp string, item string, rid string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, "x", "y", "z", "w") for d, t in rows], CLASH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)] + ["Élan", "a-b", "ПРИВЕТ"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, make(r.choice([2, 3, 4, 5, 12, 13, 14, 40]))) for i in range(30)] + [(99, None), (98, ""), (None, make(20)), (3, make(15)), (97, "one"), (96, "a a a a a a a a a a a a a a a")]
    docs = []
    for d in range(150):
        parts = make(r.choice([0, 1, 20, 200]))
        if d % 3 == 0:
            w = brute.words(r.choice(items)[1])
            cut = r.randrange(0, 6)
            parts += "\n " + "  ".join(w[cut:]).upper() + ", " + make(5)
        docs.append((d, parts))
    docs += [(7, docs[7][1]), (7, "other"), (None, docs[3][1]), (200, None), (201, ""), (202, " \n\t"), (203, "x " * 30000 + items[7][1]), (204, "a " * 40)]
    return docs, items


def test_decontaminate_against_brute_force(spark, texts):
    docs, items = texts
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rid string")
    got = decontaminate.decisions(frame(spark, docs), bench)
    assert brute.rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination(docs, items), key=repr)


def test_decontaminate_empty(spark, texts):
    docs, items = texts
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decisions(frame(spark, docs), none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.decisions(frame(spark, docs), none).count() == len(docs)
    assert decontaminate.decisions(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontaminate_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op9_decontaminate(spark, sf)
    assert brute.rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination(docs, items), key=repr)


def test_decontaminate_sql(spark, sf, texts, tmp_path):
    import duckdb

    docs, items = [(d, t) for d, t in texts[0] if len(t or "") < 5000], texts[1]  # the SQL takes the square of a text's length
    for name, rows, kind in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for folder, files in ((sf, "parquet"), (str(tmp_path), "parquet/*.parquet")):
        c = duckdb.connect()
        for name in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.{files}'")
        want = c.sql(ORACLE_SQL["op9_decontaminate"])
        assert brute.rows(op9_decontaminate(spark, folder), *want.columns) == sorted(want.fetchall(), key=repr)


def test_simhash_against_brute_force(spark, texts):
    r = random.Random(2)
    docs = texts[0][:80]
    for d, t in docs[:40]:
        w = t.split()
        for k in range(3):
            if w:
                w[r.randrange(len(w))] = "new"
            docs = [*docs, (1000 + d * 3 + k, " ".join(w))]
    docs += [(None, docs[5][1]), (5, docs[5][1]), (300, None), (301, ""), (302, "one"), (303, "one two"), (304, "é" * 5000 + " b c d")]
    fps = [(d, brute.simhash(t)) for d, t in docs]
    want = sorted(((d, format(f, "016x"), c) for (d, f), c in zip(fps, brute.components(fps), strict=True)), key=repr)
    got = simhash.near_duplicates(frame(spark, docs)).withColumn("fingerprint", simhash.hex16())
    assert brute.rows(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [(d, brute.simhash(t)) for d, t in docs]
    want = sorted(((d, format(f, "016x"), c) for (d, f), c in zip(fps, brute.components(fps), strict=True)), key=repr)
    assert brute.rows(op10_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == want


def test_links_of_a_dense_group_are_few_and_whole(spark):
    r = random.Random(3)
    fps = list({sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(400)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=32)
    found = {r.v: r.root for r in simhash.components(edges).collect()}
    want = brute.components(list(zip(signed, fps, strict=True)))
    assert [found.get(f, f) for f in signed] == want
    assert edges.count() <= 20 * len(fps) * 20


def test_long_chain_is_one_component(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges)
    assert got.agg(F.min("root"), F.max("root"), F.count("*")).first() == (0, 0, 500)


def test_hashes_are_those_of_spark(spark):
    import numpy as np

    texts = ["", "a", "abcdefgh", "é" * 40, "x" * 31, "y" * 32, "z" * 333]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    lens = np.array([len(t.encode()) for t in texts])
    got = kernels.xxh64(data, np.concatenate([[0], np.cumsum(lens)[:-1]]), lens).view(np.int64).tolist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert got == [r.h for r in df.select(F.xxhash64("t").alias("h")).collect()]
