"""Every query by name: operators applied to the views of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import dot, norm, unit
from ..operators import audit, bootstrap, encode, exclusion, geometry, sampling, scoring, selection, stats, tiles
from ..sources import notes as sources
from ..sources import vectors
from ..sources.stages import Stages, shared_folder, source_version
from . import flows, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = scoring.KEYS
#: Patients to a block of the bootstrap.
PATIENTS = 16


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def ranks(spark, sf, view=views.items):
    return scoring.ranked(*view(spark, sf)).withColumn("patient", F.expr("doc_idx div 3"))


def means(spark, sf, view=views.items):
    return scoring.cell_means(ranks(spark, sf, view))


def booted(ranks, **more):
    """Bootstrap means with blocks of few patients, so that draws are split over several."""
    return bootstrap.boot_means(ranks, block=PATIENTS, **more)


def scoped_means(spark, sf):
    return stats.with_scope(means(spark, sf), views.item_scopes(spark))


# --- scans, filters and text


@query
def note_scan_min_chars(spark, sf):
    return sampling.scan_notes(views.table(spark, sf, "documents")).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query
def note_era_share(spark, sf):
    return rounded(audit.era(views.notes(spark, sf)), "share_era", "share_before_2020")


@query
def norm_key(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", T.norm_key(F.col("text")).alias("key"))


@query
def canon_tokens(spark, sf):
    w = views.table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")).withColumn("c", T.canon(F.col("w")))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.filter("c", lambda x: x != "")).cast("bigint").alias("n_canon"), F.array_join("c", " ").alias("canon"))


@query
def token_windows(spark, sf):
    w = T.computed(views.table(spark, sf, "documents").select("doc_id", "text"), tokens=T.tokens(F.col("text")))
    w = w.select("doc_id", F.posexplode(T.windows(F.col("tokens"), 51, 38)).alias("window_no", "w"))
    return w.select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.size("w").cast("bigint").alias("n"), F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"))


@query
def leak_guard(spark, sf):
    d = views.notes(spark, sf).withColumn("query", F.substring("text", 1, 90)).withColumn("target", F.when(F.col("src_order") % 3 == 0, F.col("text")).otherwise(F.expr("substr(text, 91)")))
    return audit.leaks(d)


@query
def doc_frequency(spark, sf):
    return exclusion.document_frequency(views.notes(spark, sf))


@query
def narrative_query(spark, sf):
    return flows.narrative_queries(views.notes(spark, sf), Stages(spark), _notes_now(spark, sf))


def _notes_now(spark, sf):
    """What stages of the documents as they are now are made of."""
    return source_version(views.table(spark, sf, "documents")), "notes"


def _excluded(spark, sf):
    """The stored pairs of the documents as they are now."""
    return flows.excluded_pairs(views.notes(spark, sf), Stages(spark), _notes_now(spark, sf))[0]


@query
def query_exclusion(spark, sf):
    return _excluded(spark, sf).select("site", "genre", "src_order", "query", "target")


@query
def leak_proof(spark, sf):
    return audit.leaks(_excluded(spark, sf))


# --- deduplication, sampling and audits


@query
def dedup_keep_first(spark, sf):
    return sampling.dedup_keep_first(sampling.scan_notes(views.notes(spark, sf))).select("site", "genre", "src_order", "patient", "year")


@query
def attrition(spark, sf):
    return sampling.attrition(sampling.scan_notes(views.notes(spark, sf)))


@query
def equalized_pool(spark, sf):
    return sampling.equal_samples(sampling.dedup_keep_first(sampling.scan_notes(views.notes(spark, sf)))).select("site", "genre", "src_order")


@query
def matched_n(spark, sf):
    return sampling.equal_samples(sampling.scan_notes(views.notes(spark, sf)), seed=43, index="doc_idx").select("site", "genre", "src_order", "doc_idx")


@query
def audit_distinct_counts(spark, sf):
    return audit.distinct_counts(sampling.scan_notes(views.notes(spark, sf)))


@query
def docs_per_patient(spark, sf):
    return rounded(audit.docs_per_patient(views.notes(spark, sf)), "share_several")


@query
def year_bucket_hist(spark, sf):
    return audit.year_histogram(views.notes(spark, sf))


@query
def audit_roll_up(spark, sf):
    return audit.roll_up(sampling.scan_notes(views.notes(spark, sf)))


@query
def truncation_share(spark, sf):
    w = views.notes(spark, sf).select("site", "genre", F.size(T.tokens(F.col("text"))).alias("n_tokens"))
    return rounded(audit.truncation(w, ["site", "genre"]), "share_truncated")


# --- scoring


@query
def sim_top10(spark, sf):
    q, d = views.items(spark, sf)
    return rounded(tiles.top_documents(q, d, scoring.TOP_K).withColumn("rank", F.col("rank").cast("bigint")), "score")


@query
def rr_maxsim(spark, sf):
    return rounded(ranks(spark, sf).drop("patient"), "rr")


@query
def rr_blocks(spark, sf):
    q, d = views.items(spark, sf)
    return rounded(scoring.block_ranks(q, d), "rr")


@query
def rr_pruned(spark, sf):
    q, d = views.items(spark, sf)
    return rounded(scoring.pruned_ranks(q, d).select(*KEYS, "doc_idx", "rank", "rr"), "rr")


@query
def rr_single_vector(spark, sf):
    q, d = views.items(spark, sf)
    return rounded(scoring.ranked(q, d.where("chunk_no = 1")), "rr")


@query
def mrr_by_cell(spark, sf):
    return rounded(means(spark, sf).select(*KEYS, "mrr", "n"), "mrr")


@query
def hit_at_k(spark, sf):
    return rounded(means(spark, sf).select(*KEYS, "hit1", "hit10"), "hit1", "hit10")


@query
def panel_mean_hit(spark, sf):
    return rounded(means(spark, sf).groupBy("site", "genre").agg(F.avg("hit1").alias("hit1"), F.avg("hit10").alias("hit10")), "hit1", "hit10")


@query
def score_mean_pool(spark, sf):
    q, d = views.items(spark, sf)
    return rounded(scoring.cell_means(flows.ranks(q, d, "mean")).select(*KEYS, "mrr"), "mrr")


@query
def score_single_random(spark, sf):
    q, d = views.varied(spark, sf)
    return rounded(scoring.cell_means(flows.ranks(q, d, "single-random")).select(*KEYS, "mrr"), "mrr")


@query
def null_curve(spark, sf):
    return rounded(scoring.null_curve(*views.varied(spark, sf)), "null_mean")


@query
def null_interp(spark, sf):
    curve = scoring.null_curve(*views.varied(spark, sf)).where("k <> 2")
    wanted = curve.select(*KEYS).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))))
    return rounded(scoring.null_at(wanted, curve), "null_value")


@query
def score_length_norm(spark, sf):
    q, d = views.varied(spark, sf)
    return rounded(scoring.cell_means(flows.ranks(q, d, "length-norm")).select(*KEYS, "mrr"), "mrr")


@query
def null_bands(spark, sf):
    c = scoring.null_curve(*views.long(spark, sf)).withColumn("band", scoring.band(F.col("k"))).where("band is not null")
    return rounded(c.groupBy(*KEYS, "band").agg(F.avg("null_mean").alias("null_mean")), "null_mean")


@query
def di_gap(spark, sf):
    m = means(spark, sf).groupBy("site", "model").agg(F.max(F.when(F.col("genre") == 0, F.col("mrr"))).alias("d"), F.max(F.when(F.col("genre") == 1, F.col("mrr"))).alias("i"))
    return rounded(m.agg(F.avg(F.col("d") - F.col("i")).alias("gap")), "gap")


@query
def median_chunks(spark, sf):
    d = views.varied(spark, sf)[1].where("model = 0").groupBy("site", "genre", "doc_idx").count()
    return d.groupBy("site", "genre").agg(F.percentile("count", F.lit(0.5)).alias("median_chunks"))


def _encoding_panel(spark):
    return spark.createDataFrame([("plain", "", "", "mean"), ("first", "", "", "cls"), ("prefixed", "query: ", "passage: ", "mean")], "model string, q_prefix string, d_prefix string, pooling string")


def _encoded(spark, sf):
    docs = views.notes(spark, sf).select("site", "genre", F.col("src_order").alias("doc_idx"), F.col("text").alias("query"), F.col("text").alias("target"))
    return encode.embed(docs, _encoding_panel(spark), encode.LinearEncoder, token_states=True)


def _components(df):
    return df.select("model", "doc_idx", *[c for c in df.columns if c == "chunk_no"], *[F.round(F.col("v")[i].cast("double"), 4).alias(f"v{i}") for i in range(4)])


@query
def encoded_windows(spark, sf):
    return _components(_encoded(spark, sf)[1].withColumn("chunk_no", F.col("chunk_no").cast("bigint")))


@query
def encoded_queries(spark, sf):
    return _components(_encoded(spark, sf)[0])


@query
def truncation_observed(spark, sf):
    cells = [(site, genre) for site in (0, 1) for genre in ("en", "other")]
    texts = views.notes(spark, sf).select("site", "genre", "src_order", "text", F.lit("mean").alias("pooling"))
    return rounded(flows.encoded_texts(texts, cells, encode.LinearEncoder)[1], "share_truncated")


@query
def vectors_stored(spark, sf):
    q, d = views.items(spark, sf)
    stages, made_of = Stages(spark), (source_version(views.table(spark, sf, "embeddings")), "items")
    asked, windows = vectors.stored_queries(stages, made_of, lambda: q, 8), vectors.stored_chunks(stages, made_of, lambda: d, 8)
    both = asked.withColumnRenamed("v", "qv").hint("merge").join(windows, list(vectors.KEYS))
    return rounded(both.groupBy(*vectors.KEYS).agg(F.max(dot(F.col("qv"), F.col("v"))).alias("own"), F.count("*").alias("n_windows")), "own")


# --- geometry


@query
def l2_normalize(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return e.select("vec_id", F.round(norm(F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query
def anisotropy(spark, sf):
    return rounded(geometry.anisotropy(views.items(spark, sf)[1]), "mean_cos", "p95_cos", "mean_norm", "centroid_cos")


@query
def component_percentiles(spark, sf):
    e = views.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    p = selection.percentiles(e.select((F.col("pos") % 4).cast("bigint").alias("part"), F.abs(F.col("x").cast("double")).alias("x")), ["part"], "x", (0.025, 0.5, 0.95), bins=64, few=100)
    return rounded(p.select("part", *[F.col("p")[i].alias(c) for i, c in enumerate(("low", "middle", "high"))]), "low", "middle", "high")


@query
def anisotropy_closed_form(spark, sf):
    return rounded(geometry.mean_cosine(views.items(spark, sf)[1]), "mean_cos")


@query
def anisotropy_label(spark, sf):
    m = geometry.mean_cosine(views.items(spark, sf)[1]).groupBy("model").agg(F.avg("mean_cos").alias("mean_cos"))
    return rounded(m.withColumn("label", geometry.anisotropy_label(F.col("mean_cos"))), "mean_cos")


@query
def null_slope(spark, sf):
    return rounded(geometry.null_slope(*views.long(spark, sf)), "floor", "high", "slope", "ratio")


@query
def mean_center_mrr(spark, sf):
    q, d = views.items(spark, sf)
    return rounded(scoring.cell_means(flows.ranks(q, d, "centred")).select(*KEYS, "mrr"), "mrr")


@query
def offdiag_after_centering(spark, sf):
    _, d = geometry.centred(*views.items(spark, sf))
    return rounded(geometry.mean_cosine(d.where("model = 1"), 1500).groupBy("model").agg(F.avg("mean_cos").alias("mean_cos")), "mean_cos")


# --- statistics of rankings


def _panel(spark):
    return spark.range(8).select(F.col("id").alias("model"), F.col("id").alias("panel_ord"))


@query
def kendall_tau(spark, sf):
    return rounded(stats.kendall_tau(scoped_means(spark, sf), ["scope"]), "tau")


@query
def kendall_tau_runs(spark, sf):
    return rounded(stats.kendall_tau_runs(scoped_means(spark, sf), ["scope"], run=3), "tau")


@query
def vector_tau(spark, sf):
    """How a vector's first component goes with each other one, over all vectors."""
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("model"), F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "x"))
    first = e.where("pos = 0").select("model", F.col("x").cast("double").alias("mrr"), F.lit(0).alias("site"))
    others = e.where("pos > 0").select("model", F.col("x").cast("double").alias("mrr"), F.lit(1).alias("site"), F.col("pos").cast("bigint").alias("genre"))
    both = first.crossJoin(F.broadcast(others.select("genre").distinct())).unionByName(others)  # seven positions
    return rounded(stats.kendall_tau_runs(both, [], run=64), "tau")


@query
def topk_overlap(spark, sf):
    return rounded(stats.topk_overlap(scoped_means(spark, sf), ["scope"]), "top3", "top5")


@query
def selection_regret(spark, sf):
    return rounded(stats.selection_regret(scoped_means(spark, sf), ["scope"], _panel(spark)), "regret")


@query
def variance_decomp(spark, sf):
    return rounded(stats.decompose(stats.complete(scoped_means(spark, sf), ["scope"]), ["scope"]), *stats.TERMS)


@query
def interaction_contrast(spark, sf):
    b = booted(ranks(spark, sf)).withColumnRenamed("rr", "mrr")
    d = stats.decompose(stats.complete(b, ["replicate"]), ["replicate"]).select("replicate", (F.col("model_x_site") - F.col("model_x_genre")).alias("value"))
    out = bootstrap.interval(d.withColumn("term", F.lit("contrast")), ["term"], "value")
    return rounded(out.withColumn("verdict", stats.contrast_verdict(F.col("lo"), F.col("hi"))), "boot_mean", "lo", "hi")


@query
def scoring_sensitivity(spark, sf):
    q, d = views.varied(spark, sf)
    return rounded(flows.sensitivity(q, d, views.item_scopes(spark)), *stats.TERMS)


# --- bootstrap


@query
def boot_mrr_ci(spark, sf):
    r = Stages(spark).table("ranks", (uuid.uuid4().hex,), lambda: ranks(spark, sf))  # taken twice
    ci = bootstrap.interval(booted(r, per_cell=True), KEYS, "rr")
    return rounded(scoring.cell_means(r).select(*KEYS, "mrr").join(ci, KEYS), "mrr", "boot_mean", "lo", "hi")


@query
def boot_joint_mrr(spark, sf):
    return rounded(booted(ranks(spark, sf)).withColumn("replicate", F.col("replicate").cast("bigint")), "rr", places=9)  # shares of few documents end in 5 at the seventh place


@query
def boot_hit_ci(spark, sf):
    b = booted(ranks(spark, sf), values=("hit1", "hit10")).groupBy("replicate", "site", "genre").agg(F.avg("hit1").alias("hit1"), F.avg("hit10").alias("hit10"))
    return rounded(bootstrap.interval(bootstrap.unpivoted(b, ["replicate", "site", "genre"], ("hit1", "hit10")), ["site", "genre", "term"], "value"), "boot_mean", "lo", "hi")


def _scoped_boot(spark, sf, replicates=bootstrap.REPLICATES):
    return stats.with_scope(booted(ranks(spark, sf), replicates=replicates).withColumnRenamed("rr", "mrr"), views.item_scopes(spark))


@query
def boot_tau_ci(spark, sf):
    tau = stats.kendall_tau(_scoped_boot(spark, sf), ["scope", "replicate"])
    return rounded(bootstrap.interval(tau, ["scope", "genre"], "tau"), "boot_mean", "lo", "hi")


@query
def boot_regret_ci(spark, sf):
    r = stats.selection_regret(_scoped_boot(spark, sf), ["scope", "replicate"], _panel(spark))
    return rounded(bootstrap.interval(r, ["scope", "genre", "source", "destination"], "regret"), "boot_mean", "lo", "hi")


@query
def boot_overlap_ci(spark, sf):
    o = stats.topk_overlap(_scoped_boot(spark, sf), ["scope", "replicate"])
    return rounded(bootstrap.interval(bootstrap.unpivoted(o, ["scope", "replicate", "genre"], ("top3", "top5")), ["scope", "genre", "term"], "value"), "boot_mean", "lo", "hi")


@query
def boot_decomp_ci(spark, sf):
    by = ["scope", "replicate"]
    d = stats.decompose(stats.complete(_scoped_boot(spark, sf), by), by)
    return rounded(bootstrap.interval(bootstrap.unpivoted(d, by, stats.TERMS), ["scope", "term"], "value"), "boot_mean", "lo", "hi")


@query
def boot_cell_decomp_ci(spark, sf):
    by = ["scope", "replicate"]
    boot = stats.with_scope(booted(ranks(spark, sf), per_cell=True).withColumnRenamed("rr", "mrr"), views.item_scopes(spark))
    d = stats.decompose(stats.complete(boot, by), by)
    return rounded(bootstrap.interval(bootstrap.unpivoted(d, by, stats.TERMS), ["scope", "term"], "value"), "boot_mean", "lo", "hi")


@query
def genre_drop(spark, sf):
    q, d = views.varied(spark, sf)
    return rounded(flows.genre_drop(flows.sensitivity(q, d, views.item_scopes(spark), ("maxsim", "length-norm"))), "before", "after", "drop_ratio")


@query
def encounters_per_patient(spark, sf):
    return rounded(audit.encounters(views.notes(spark, sf), ["site"]), "share_several")


# --- tables written and read again


def _folder(spark):
    """A folder that all executors share."""
    return f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"


@query
def long_notes_read(spark, sf):
    at = _folder(spark)
    time = F.concat(F.lit(""), F.col("year").cast("string"), F.lit("-02-03 04:05:06"))
    sources.write_csv(views.notes(spark, sf).select(F.col("src_order").alias("note_id"), F.col("patient").alias("subject_id"), "text", time.alias("charttime")), at)
    return sources.read_long_notes(spark, at, "a", "discharge").select("site", "genre", "doc_key", "patient", "year", F.sha2("text", 256).alias("digest"))


@query
def wide_notes_read(spark, sf):
    at = _folder(spark)
    n = views.notes(spark, sf)
    english = F.col("genre") == "en"
    side = lambda c, mine: F.when(mine, F.col(c))
    wide = n.select(F.col("patient").alias("patientdurablekey"), side("text", english).alias("Discharge_Summary_Text"), side("year", english).alias("Discharge_Summary_Year"), F.col("src_order").alias("Discharge_Summary_Note_Key"), side("text", ~english).alias("Imaging_Text"), side("year", ~english).alias("Imaging_Year"), F.col("src_order").alias("Imaging_Key"))
    sources.write_csv(wide, at)
    return sources.read_wide_notes(spark, at, "b").select("site", "genre", "doc_key", "patient", "year", F.sha2("text", 256).alias("digest"))


@query
def ranks_stored(spark, sf):
    at = _folder(spark)
    sources.write_ranks(ranks(spark, sf), at)
    return rounded(sources.read_ranks(spark, at, [1, 5]).select(F.col("site"), F.col("genre"), F.col("model").cast("bigint").alias("model"), "doc_idx", "rr"), "rr")


@query
def cells_stored(spark, sf):
    at = _folder(spark)
    sources.write_cells(sampling.equal_samples(sampling.scan_notes(views.notes(spark, sf)), seed=43, index="doc_idx"), at)
    return sources.read_cells(spark, at).select("site", "genre", "src_order", "doc_idx", F.sha2("text", 256).alias("digest"))


@query
def mrr_json_stored(spark, sf):
    at = _folder(spark)
    m = means(spark, sf)
    sources.write_mrr_json(m.select(*KEYS, F.round("mrr", 6).alias("mrr"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.col("n").alias("obj")), at)
    return sources.read_mrr_json(spark, at)
