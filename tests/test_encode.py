import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import encode
from corvane.plans import flows
from corvane.sources import vectors
from corvane.sources.stages import Stages


class Recording(encode.LinearEncoder):
    """Tells how many places were padded."""

    def __init__(self):
        self.places = self.texts = 0

    def states(self, ids, mask):
        assert (ids[~mask] == self.pad).all() and mask[:, 0].all() and (ids[:, 0] == self.first).all()
        assert (np.diff(mask.astype(int), axis=1) <= 0).all()
        self.places += mask.size
        self.texts += len(ids)
        return super().states(ids, mask)


def plain(words, pooling):
    model = encode.LinearEncoder()
    ids = np.array([model.first, *model.ids(words), model.last])
    codes = np.stack([ids % d for d in model.DIVISORS], axis=1).astype(float)
    states = codes + codes.mean(axis=0)
    v = states[0] if pooling == "cls" else states.mean(axis=0)
    return v / np.linalg.norm(v)


def test_padding_changes_nothing(spark):
    r = np.random.default_rng(1)
    rows = [(i, ["abcdefgh"[r.integers(8)] * int(r.integers(1, 9)) for _ in range(int(r.integers(0, 60)))], ["cls", "mean"][i % 2]) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None, "mean")], "i int, words array<string>, pooling string").repartition(3)
    got = {x.i: x.v for x in encode.encode_states(df, "words", encode.LinearEncoder).collect()}
    assert len(got) == 301
    for i, words, pooling in rows:
        assert got[i] == pytest.approx(plain(words, pooling).tolist(), abs=1e-6)
    assert got[300] == pytest.approx(plain([], "mean").tolist(), abs=1e-6)


def test_runs_are_of_about_one_length():
    sizes = np.random.default_rng(2).integers(1, 500, 3000)
    runs = list(encode.padded_runs(sizes, 4000, 64))
    assert sorted(np.concatenate(runs).tolist()) == list(range(3000))
    assert all(len(r) <= 64 and (len(r) == 1 or len(r) * sizes[r].max() <= 4000) for r in runs)
    assert sum(len(r) * sizes[r].max() for r in runs) < 1.05 * sizes.sum()
    assert [len(r) for r in encode.padded_runs(np.array([9000, 2]), 4000)] == [1, 1]


def test_the_mask_covers_marks_and_words(spark):
    model = Recording()
    df = spark.createDataFrame([(1, ["a", "bb"], "mean"), (2, ["ccc"] * 9, "mean")], "i int, words array<string>, pooling string")
    import pyarrow as pa

    out = []

    class Frame:
        columns, schema = df.columns, df.schema

        @staticmethod
        def mapInArrow(run, _):
            out.extend(run([pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()], pa.schema([("i", pa.int32()), ("words", pa.list_(pa.string())), ("pooling", pa.string())]))]))

    encode.encode_states(Frame, "words", lambda: model)
    assert out[0].num_rows == 2 and model.texts == 2 and model.places == 2 * 11


def test_prefix_and_empty_rules(spark):
    items = spark.createDataFrame([(0, "g", 0, "a b", "c d"), (0, "g", 1, "", " ")], "site int, genre string, doc_idx long, query string, target string")
    models = spark.createDataFrame([("p", "q: ", "d: ", "mean"), ("n", "", "", "cls")], "model string, q_prefix string, d_prefix string, pooling string")
    q, d = encode.embed(items, models, encode.LinearEncoder, token_states=True)
    windows = {(r.model, r.doc_idx): r.v for r in d.collect()}
    assert set(windows) == {("p", 0), ("p", 1), ("n", 0)}  # no tokens, even of a prefix, no windows
    assert windows["p", 1] == pytest.approx(plain(["d:"], "mean").tolist(), abs=1e-6)
    asked = {(r.model, r.doc_idx): r.v for r in q.collect()}
    assert asked["n", 0] == pytest.approx(plain(["a", "b"], "cls").tolist(), abs=1e-6)
    assert len(asked) == 4


def test_truncation_is_observed_and_stored(spark, tmp_path):
    texts = spark.createDataFrame([(0, "a", "w " * n, "mean") for n in (3, 8, 20)] + [(1, "a", "w", "mean")], "site int, genre string, text string, pooling string")
    cells = [(0, "a"), (0, "b"), (1, "a")]
    for made in (["text_vectors", "truncation"], []):
        stages = Stages(spark, str(tmp_path))
        v, share = flows.encoded_texts(texts, cells, encode.LinearEncoder, stages, ("1",), limit=8)
        assert {(r.site, r.genre): (round(r.share_truncated, 6), r.n) for r in share.collect()} == {(0, "a"): (0.666667, 3), (1, "a"): (0.0, 1)}
        assert stages.made == made and v.count() == 4
    assert "text" not in v.columns


def test_vector_stores(spark, tmp_path):
    q = spark.createDataFrame([(0, "g", "m", i, [1.0, float(i)]) for i in range(50)], "site int, genre string, model string, doc_idx long, v array<float>")
    d = q.selectExpr("*", "explode(sequence(0, doc_idx % 3)) as chunk_no")
    stages = Stages(spark, str(tmp_path))
    asked, windows = vectors.stored_queries(stages, ("1",), lambda: q, 4), vectors.stored_chunks(stages, ("1",), lambda: d, 4)
    both = asked.withColumnRenamed("v", "qv").hint("merge").join(windows, list(vectors.KEYS)).groupBy(*vectors.KEYS).count()
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.agg(F.sum("count")).first()[0] == d.count()
    assert vectors.stored_queries(stages, ("2",), lambda: q.limit(1), 4).count() == 1  # other inputs, another table
    with pytest.raises(ValueError):
        vectors.stored_chunks(stages, ("3",), lambda: q)
    rows = vectors.by_position(windows).collect()
    assert [r.ids for r in rows] == [i for i in range(50) for _ in range(i % 3 + 1)]
    assert [vectors.buckets_for(n) for n in (0, 1_000_000, 1_000_001, 9_000_000)] == [1, 1, 2, 16]


def test_few_words_are_python_objects_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encode, "WORDS", 1000)
    lengths = np.random.default_rng(4).integers(0, 120, 400)
    batch = pa.record_batch([pa.array(range(401)), pa.array([["w"] * int(n) for n in lengths] + [None])], ["i", "words"])
    parts = list(encode.slices(batch, "words"))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert len(parts) > 20 and max(sum(len(w or []) for w in p.column("words").to_pylist()) for p in parts) <= 1000 + 120
    assert [p.num_rows for p in encode.slices(batch.slice(0, 0), "words")] == [0]
