import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import bootstrap, scoring, stats
from corvane.plans import views


def published(spark):
    return stats.with_scope(views.point(spark), views.point_scopes(spark))


def test_published_tau(spark):
    for tau in (stats.kendall_tau, stats.kendall_tau_runs):
        got = {(r.scope, r.genre): round(r.tau, 3) for r in tau(published(spark), ["scope"]).collect()}
        assert got == {("contrastive", "discharge"): 0.857, ("contrastive", "imaging"): 0.714, ("full", "discharge"): 0.923, ("full", "imaging"): 0.846}


def test_published_regret(spark):
    p = views.point(spark)
    m = stats.with_scope(p.drop("panel_ord"), views.point_scopes(spark)).where("scope = 'contrastive'")
    got = {(r.genre, r.source): (r.picked, r.best, round(r.regret, 3)) for r in stats.selection_regret(m, ["scope"], p.select("model", "panel_ord").distinct()).collect()}
    assert got == {("discharge", 0): ("nomic", "gte", 0.009), ("discharge", 1): ("gte", "nomic", 0.041), ("imaging", 0): ("gte", "gte", 0.0), ("imaging", 1): ("gte", "gte", 0.0)}


def test_published_overlap_and_decomposition(spark):
    top = {(r.scope, r.genre): r.top5 for r in stats.topk_overlap(published(spark), ["scope"]).collect()}
    assert (top["contrastive", "discharge"], top["contrastive", "imaging"]) == (1.0, 0.8)
    shares = {r.scope: r for r in stats.decompose(published(spark), ["scope"]).withColumn("verdict", stats.genre_verdict(F.col("genre"), F.col("model"))).collect()}
    full = shares["full"]
    assert [round(full[t], 3) for t in stats.TERMS] == [0.873, 0.0, 0.057, 0.002, 0.062, 0.002, 0.004]
    assert math.isclose(sum(full[t] for t in stats.TERMS), 1, abs_tol=1e-5)
    assert (full.verdict, shares["contrastive"].verdict) == ("collapses", "survives")


def test_some_models_and_window_counts(spark):
    assert views.point(spark).where(F.col("model").isin("e5", "gte")).count() == 8
    count = {r.id: r.n for r in spark.range(3000).select("id", text.window_count(F.col("id")).alias("n")).collect()}
    assert all(n == (0 if i == 0 else 1 if i <= 510 else math.ceil((i - 510) / 384) + 1) for i, n in count.items())


def mrr(spark, rows):
    return spark.createDataFrame(rows, "site int, genre string, model string, mrr double")


def test_tau_with_ties_and_all_tied(spark):
    rows = [(0, "g", m, a) for m, a in zip("xyz", (1.0, 1.0, 2.0), strict=True)] + [(1, "g", m, b) for m, b in zip("xyz", (1.0, 2.0, 3.0), strict=True)]
    assert stats.kendall_tau(mrr(spark, rows), []).first().tau == pytest.approx(2 / math.sqrt(6))
    tied = [(s, "g", m, 1.0 if s else float(i)) for s in (0, 1) for i, m in enumerate("xyz")]
    assert stats.kendall_tau(mrr(spark, tied), []).first().tau is None


def test_regret_takes_the_first_of_the_panel_on_ties(spark):
    rows = [(0, "g", "b", 0.5), (0, "g", "a", 0.5), (0, "g", "c", 0.1), (1, "g", "b", 0.2), (1, "g", "a", 0.9), (1, "g", "c", 0.1)]
    panel = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "model string, panel_ord int")
    r = stats.selection_regret(mrr(spark, rows), [], panel).where("source = 0").first()
    assert (r.picked, r.best, round(r.regret, 6)) == ("b", "a", 0.7)


def test_all_equal_has_no_shares(spark):
    rows = [(s, g, m, 0.5) for s in (0, 1) for g in "ab" for m in "xyz"]
    assert stats.decompose(mrr(spark, rows), []).first().model is None


def items(spark, rows):
    return spark.createDataFrame(rows, "site int, genre int, model long, doc_idx long, chunk_no long, v array<double>")


def test_depth_leaves_out_the_worst_of_few(spark):
    d = items(spark, [(0, 0, 0, i, 1, [1.0 - i / 10]) for i in range(5)])
    q = items(spark, [(0, 0, 0, 4, 0, [1.0]), (0, 0, 0, 0, 0, [1.0])]).drop("chunk_no")
    s = scoring.best_window(scoring.window_scores(q, d))
    got = {r.doc_idx: (r["rank"], r.rr) for r in scoring.reciprocal_ranks(s, q).collect()}
    assert got == {4: (None, 0.0), 0: (1, 1.0)}


def test_document_without_windows_is_never_found(spark):
    d = items(spark, [(0, 0, 0, 1, 1, [-1.0]), (0, 0, 0, 2, 1, [-0.5])])
    q = items(spark, [(0, 0, 0, 9, 0, [1.0])]).drop("chunk_no")
    s = scoring.best_window(scoring.window_scores(q, d))
    assert scoring.reciprocal_ranks(s, q).first().rr == 0.0
    assert scoring.block_ranks(q, d).first().rr == 0.0


def test_interpolation(spark):
    curve = spark.createDataFrame([(0, 0, 0, 1, 0.2), (0, 0, 0, 3, 0.4)], "site int, genre int, model int, k long, null_mean double")
    wanted = spark.createDataFrame([(0, 0, 0, k) for k in (0, 1, 2, 3, 9)], "site int, genre int, model int, k long")
    got = {r.k: round(r.null_value, 9) for r in scoring.null_at(wanted, curve).collect()}
    assert got == {0: 0.2, 1: 0.2, 2: 0.3, 3: 0.4, 9: 0.4}


def test_adding_a_constant_leaves_ranks(spark, sf):
    q, d = views.items(spark, sf)
    s = scoring.best_window(scoring.window_scores(q, d))
    a = scoring.reciprocal_ranks(s, q)
    b = scoring.reciprocal_ranks(s.withColumn("score", F.col("score") + 7), q)
    assert a.exceptAll(b).count() == 0


def test_weights_of_a_replicate_sum_to_the_clusters(spark, sf):
    r = scoring.reciprocal_ranks(*(lambda q, d: (scoring.best_window(scoring.window_scores(q, d)), q))(*views.items(spark, sf))).withColumn("patient", F.col("doc_idx") % 14)
    w = bootstrap.weights(r, 20)
    assert [x[0] for x in w.groupBy("replicate", "site").agg(F.sum("w")).select("sum(w)").distinct().collect()] == [7]


def paired(spark, pairs, genre="g"):
    return spark.createDataFrame([(s, genre, m, float(p[s])) for m, p in enumerate(pairs) for s in (0, 1)], "site int, genre string, model long, mrr double")


@pytest.mark.parametrize("run", [2, 7, 65_536])
@pytest.mark.parametrize("high", [3, 1000])
def test_tau_by_runs_equals_tau_by_pairs(spark, run, high):
    import numpy as np

    r = np.random.default_rng(high)
    df = paired(spark, r.integers(0, high, (90, 2))).union(paired(spark, r.integers(0, high, (20, 2)), "h")).union(paired(spark, [(1, 2), (2, 2), (3, 2)], "tied")).union(paired(spark, [(1, 2), (2, 3)], "few"))
    want = {x.genre: x.tau for x in stats.kendall_tau(df, []).collect()}
    got = {x.genre: x.tau for x in stats.kendall_tau_runs(df, [], run).collect()}
    assert got.keys() == want.keys() == {"g", "h", "tied"} and got["tied"] is None is want["tied"]
    assert got["g"] == pytest.approx(want["g"], abs=1e-12) and got["h"] == pytest.approx(want["h"], abs=1e-12)


def test_signs_of_pairs():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 65):
        x, y = r.integers(0, 9, n).astype(float), r.integers(0, 7, n).astype(float)
        assert stats._signs(x, y) == sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))


def test_tau_of_many_items(spark):
    n = 100_000
    rows = spark.range(2 * n).selectExpr("cast(id % 2 as int) site", "'g' genre", "id div 2 model", "case when id % 2 = 0 then cast(id div 2 as double) else cast((id div 2) div 10 * 10 + 9 - (id div 2) % 10 as double) end mrr")
    backwards = 45 * n // 10  # the ten of each run are turned around
    assert stats.kendall_tau_runs(rows, [], 10_000).first().tau == pytest.approx(1 - 2 * backwards / (n * (n - 1) / 2), abs=1e-12)


def test_interpolation_takes_many_points(spark):
    curve = spark.range(100_000).selectExpr("0 site", "0 genre", "0 model", "id * 2 k", "cast(id as double) null_mean")
    wanted = spark.range(200_010).selectExpr("0 site", "0 genre", "0 model", "id k", "id other")
    got = scoring.null_at(wanted, curve)
    assert got.count() == 200_010 and got.where("abs(null_value - least(k / 2D, 99999D)) > 1e-9 or other <> k").count() == 0


def test_distinct_counts_leave_out_nulls_and_need_no_expand(spark):
    from corvane.operators import audit

    rows = [(0, "a", 1, "Text 1", "p"), (0, "a", 2, "text 2", "p"), (0, "a", None, None, None), (0, "a", 2, "text 2", "q"), (1, "b", 1, None, "p")]
    got = audit.distinct_counts(spark.createDataFrame(rows, "site int, genre string, src_order long, text string, patient string"))
    assert {tuple(r) for r in got.collect()} == {(0, "a", 4, 2, 2, 1, 2), (1, "b", 1, 1, 0, 0, 1)}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
