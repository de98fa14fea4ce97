import pytest
from pyspark.sql import functions as F

from corvane.operators import encode, exclusion, scoring, tiles
from corvane.plans import flows, views
from corvane.plans.catalogue import QUERIES
from corvane.sources import notes
from corvane.sources.stages import Stages


def test_notes_to_statistics(spark, sf):
    items = flows.matched_items(views.notes(spark, sf)).cache()
    sizes = {r["count"] for r in items.groupBy("site", "genre").count().collect()}
    assert len(sizes) == 1 and sizes.pop() > 3
    assert items.groupBy("site", "genre").agg(F.max("doc_idx") + 1 == F.count("*")).where("NOT `((max(doc_idx) + 1) = count(1))`").count() == 0
    items = spark.createDataFrame(items.where("doc_idx < 8").collect(), items.schema)
    models = flows.panel(spark).where("panel_ord < 3")
    encoders = {m: ((lambda d=d: encode.hashed_encoder(d)), (lambda d=d: encode.hashed_encoder(d))) for m, d in (("bge", 16), ("gte", 32), ("e5", 64))}
    ranks = flows.evaluate(items, models, encoders)
    ranks = spark.createDataFrame(ranks.collect(), ranks.schema)
    assert ranks.where("rr < 0 or rr > 1 or hit1 > hit10").count() == 0
    tables = flows.statistics(ranks, models, replicates=5)
    assert tables["means"].count() == 12
    assert all(-1 <= r.tau <= 1 for r in tables["tau"].collect() if r.tau is not None)
    assert tables["regret"].where("regret < -1e-12").count() == 0
    assert tables["variance_intervals"].where("lo > hi").count() == 0
    for name in ("intervals", "overlap", "variance"):
        assert tables[name].count() > 0


def test_policies(spark, sf):
    q, d = views.varied(spark, sf)
    policies = ("length-norm", "centred")
    assert flows.sensitivity(q, d, views.item_scopes(spark), policies).count() == 2 * len(policies)


def test_vectors_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert notes.stored_vectors(spark, f"{tmp_path}/v", make).count() == 3
    assert made == [1]


def test_documents_without_windows_have_a_mean_vector_of_zeros(spark):
    from corvane.operators import scoring

    q = spark.createDataFrame([(0, 0, 0, i, [1.0, 0.0]) for i in range(3)], "site int, genre int, model int, doc_idx long, v array<double>")
    d = spark.createDataFrame([(0, 0, 0, 0, 1, [2.0, 0.0]), (0, 0, 0, 0, 2, [0.0, 2.0]), (0, 0, 0, 1, 1, [-1.0, 0.0])], "site int, genre int, model int, doc_idx long, chunk_no int, v array<double>")
    got = {r.doc_idx: r.v for r in scoring.mean_windows(d, q).collect()}
    assert got[2] == [0.0, 0.0] and got[1] == [-1.0, 0.0] and abs(got[0][0] - 0.5**0.5) < 1e-12
    ranks = {r.doc_idx: r["rank"] for r in scoring.reciprocal_ranks(flows.scores(q, d, "mean"), q).collect()}
    assert ranks == {0: 1, 1: None, 2: 2}


@pytest.mark.parametrize("policy", flows.POLICIES)
def test_ranks_equal_those_of_all_pairs(spark, sf, policy):
    q, d = (x.where("model < 2") for x in views.varied(spark, sf))
    columns = ["site", "genre", "model", "doc_idx", "rank", "rr", "hit1", "hit10"]
    want = {tuple(r) for r in scoring.reciprocal_ranks(flows.scores(q, d, policy), q).select(columns).collect()}
    assert want and {tuple(r) for r in flows.ranks(q, d, policy).select(columns).collect()} == want


@pytest.mark.parametrize("name", ["rr_maxsim", "rr_single_vector", "hit_at_k", "panel_mean_hit", "di_gap", "score_mean_pool", "score_single_random", "score_length_norm", "mean_center_mrr", "kendall_tau", "boot_mrr_ci", "genre_drop"])
def test_no_row_for_a_pair_of_a_query_and_a_document(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "query_idx" not in plan


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_target_is_made_once(spark, sf):
    chosen = spark.createDataFrame([(0, "en", 1, 2)], "site int, genre string, src_order long, at int")
    plan = optimized(exclusion.query_target_pairs(views.notes(spark, sf), chosen=chosen))
    assert plan.count("array_join") == 1


def test_narrative_queries_read_stored_texts(spark, sf, tmp_path):
    stages = Stages(spark, str(tmp_path))
    plan = optimized(flows.narrative_queries(views.notes(spark, sf), stages))
    assert stages.made == ["unique_notes", "unique_sentences", "unique_frequency"]
    assert "sha2" not in plan and "documents.parquet" not in plan


@pytest.mark.parametrize("policy", ["mean", "single-random", "length-norm", "centred"])
def test_blocks_are_counted_from_the_given_rows(spark, sf, monkeypatch, policy):
    q, d = (x.where("model = 0") for x in views.varied(spark, sf))
    counted = []

    def count(queries, chunks):
        counted.append(" ".join(x._jdf.queryExecution().optimizedPlan().toString() for x in (queries, chunks)))
        return 2, 1

    monkeypatch.setattr(tiles, "block_counts", count)
    flows.ranks(q, d, policy)
    assert len(counted) == 1 and not any(x in counted[0] for x in ("Join", "Window", "Aggregate"))
