"""Whole evaluations: from notes to matched items, to ranks, to statistics and sensitivity tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import computed, tokens
from ..operators import audit, bootstrap, encode, exclusion, geometry, sampling, scoring, stats, tiles
from ..sources.stages import Stages

# The panel's models in order: family, pooling, query prefix, document prefix.
PANEL = [
    ("bge", "contrastive", "cls", "Represent this sentence for searching relevant passages: ", ""),
    ("gte", "contrastive", "mean", "", ""),
    ("e5", "contrastive", "mean", "query: ", "passage: "),
    ("nomic", "contrastive", "mean", "search_query: ", "search_document: "),
    ("mpnet", "contrastive", "mean", "", ""),
    ("minilm", "contrastive", "mean", "", ""),
    ("medcpt", "contrastive", "cls", "", ""),
    ("biolord", "contrastive", "mean", "", ""),
    ("bert-base", "mlm", "cls", "", ""),
    ("biobert", "mlm", "cls", "", ""),
    ("clinicalbert", "mlm", "cls", "", ""),
    ("pubmedbert", "mlm", "cls", "", ""),
    ("scibert", "mlm", "cls", "", ""),
]
POLICIES = ("maxsim", "mean", "single-random", "length-norm", "centred")


def panel(spark) -> DataFrame:
    rows = [(m, i, *rest) for i, (m, *rest) in enumerate(PANEL)]
    return spark.createDataFrame(rows, "model string, panel_ord int, family string, pooling string, q_prefix string, d_prefix string")


def scopes_of(models: DataFrame) -> DataFrame:
    """``scope, model``: every model in the full scope, and each in that of its family."""
    return models.select(F.explode(F.array(F.lit("full"), F.col("family"))).alias("scope"), "model")


def excluded_pairs(notes: DataFrame, stages: Stages | None = None, made_of: tuple[str, ...] | None = None, seed: int = sampling.SEED) -> tuple[DataFrame, tuple[str, ...]]:
    """Notes to documents with query and target, and what they are made of: deduplicated, pools equalised, queries taken and excluded.

    The ids of the pool, the pool itself, its sentences' words, word frequencies, chosen sentences and pairs (less the texts) are
    stages, each stored once; notes are read for the ids and for the pool's texts.
    ``made_of`` tells the notes' version; without it nothing stored before is taken.
    """
    stages = stages or Stages(notes.sparkSession)
    made_of = (*(made_of or (uuid.uuid4().hex,)), f"seed {seed}")
    kept = sampling.scan_notes(notes)
    ids = stages.table("unique", made_of, lambda: sampling.first_ids(kept))
    chosen = stages.table("chosen", made_of, lambda: sampling.equal_samples(ids, seed=seed))
    pool = stages.table("pool", made_of, lambda: kept.join(chosen, [*sampling.CELL, "src_order"], "left_semi").repartition("src_order"))  # even, however the notes' files are
    split = stages.table("sentences", made_of, lambda: exclusion.sentence_words(pool))
    frequency = stages.table("frequency", made_of, lambda: exclusion.sentence_frequency(split))
    queries = stages.table("queries", made_of, lambda: exclusion.chosen_sentences(pool, frequency=frequency, split=split))
    return stages.table("pairs", made_of, lambda: exclusion.query_target_pairs(pool, chosen=queries).drop("text")), made_of


def narrative_queries(notes: DataFrame, stages: Stages | None = None, made_of: tuple[str, ...] | None = None) -> DataFrame:
    """``site, genre, src_order, query`` of the deduplicated notes, whose texts, sentences' words and word frequencies are stages, as in ``excluded_pairs``."""
    stages, made_of = stages or Stages(notes.sparkSession), made_of or (uuid.uuid4().hex,)
    unique = stages.table("unique_notes", made_of, lambda: sampling.dedup_keep_first(sampling.scan_notes(notes)).select(*sampling.CELL, "src_order", "text"))
    split = stages.table("unique_sentences", made_of, lambda: exclusion.sentence_words(unique))
    frequency = stages.table("unique_frequency", made_of, lambda: exclusion.sentence_frequency(split))
    return exclusion.narrative_queries(unique, frequency=frequency, split=split)


def matched_items(notes: DataFrame, seed: int = sampling.SEED, stages: Stages | None = None, made_of: tuple[str, ...] | None = None) -> DataFrame:
    """Notes to items: ``excluded_pairs``, cells matched in size and numbered."""
    stages = stages or Stages(notes.sparkSession)
    pairs, made_of = excluded_pairs(notes, stages, made_of, seed)
    numbers = stages.table("matched", made_of, lambda: sampling.equal_samples(pairs.select(*sampling.CELL, "src_order"), seed=seed + 1, index="doc_idx"))
    return pairs.join(numbers, [*sampling.CELL, "src_order"]).select("site", "genre", "doc_idx", "query", "target", "patient", "year")


def encoded_texts(texts: DataFrame, cells: list[tuple], factory: Callable, stages: Stages | None = None, made_of: tuple[str, ...] | None = None, limit: int = encode.LIMIT) -> tuple[DataFrame, DataFrame]:
    """Stored vectors of whole ``text``s cut at ``limit`` tokens (other columns, and ``pooling``, as they are), and the share of cut ones in each cell.

    The shares are observed while the vectors are made. Only where an earlier run stored vectors
    and not the shares are they counted from the stored lengths.
    """
    stages, made_of = stages or Stages(texts.sparkSession), made_of or (uuid.uuid4().hex,)
    seen = Observation()

    def make() -> DataFrame:
        cut = computed(texts, words=tokens(F.col("text"))).drop("text").withColumn("n_tokens", F.size("words"))
        cut = audit.observed_truncation(cut, seen, cells, limit=limit + 2).withColumn("words", F.slice("words", 1, limit))
        return encode.encode_states(cut, "words", factory)

    vectors = stages.table("text_vectors", made_of, make)
    told = (lambda: audit.truncation_seen(texts, seen, cells)) if "text_vectors" in stages.made else (lambda: audit.truncation(vectors, sampling.CELL, limit + 2))
    return vectors, stages.table("truncation", made_of, told)


def scores(queries: DataFrame, chunks: DataFrame, policy: str = "maxsim", seed: int = 42) -> DataFrame:
    """Document scores under one of ``POLICIES``; without windows a document has a mean vector of zeros, and no score otherwise."""
    best = lambda q, d: scoring.best_window(scoring.window_scores(q, d))
    if policy == "maxsim":
        return best(queries, chunks)
    if policy == "mean":
        return best(queries, scoring.mean_windows(chunks, queries))
    if policy == "single-random":
        return best(queries, scoring.random_window(chunks, seed))
    if policy == "length-norm":
        return scoring.length_normalised(best(queries, chunks), chunks, scoring.null_curve(queries, chunks, seed=seed))
    if policy == "centred":
        return best(*geometry.centred(queries, chunks))
    raise ValueError(f"{policy} is none of {', '.join(POLICIES)}")


def blocks_for(queries: DataFrame, chunks: DataFrame) -> tuple[int, int]:
    """Blocks that do for any policy, from the given rows alone: none has more documents' rows than queries and windows together."""
    every = queries.select(*scoring.KEYS, "v").unionByName(chunks.select(*scoring.KEYS, "v"))
    return tiles.block_counts(queries, every)


def ranks(queries: DataFrame, chunks: DataFrame, policy: str = "maxsim", seed: int = 42, k: int = scoring.TOP_K, blocks: tuple[int, int] | None = None) -> DataFrame:
    """``scoring.reciprocal_ranks`` of ``scores``, by tiles: no row is made for a pair of a query and a document.

    Without ``blocks`` they follow from the given rows, so that what a policy makes of these isn't made once more to be counted.
    """
    if policy not in POLICIES:
        raise ValueError(f"{policy} is none of {', '.join(POLICIES)}")
    blocks = blocks or (tiles.block_counts(queries, chunks) if policy == "maxsim" else blocks_for(queries, chunks))
    if policy == "mean":
        chunks = scoring.mean_windows(chunks, queries)
    elif policy == "single-random":
        chunks = scoring.random_window(chunks, seed)
    elif policy == "length-norm":
        curve = Stages(queries.sparkSession).table("null_curve", (uuid.uuid4().hex,), lambda: scoring.null_curve(queries, chunks, seed=seed))  # a few rows a cell, read by both sides alike
        return scoring.ranked(queries, scoring.with_null(chunks, curve), k, blocks)
    elif policy == "centred":
        queries, chunks = geometry.centred(queries, chunks)
    return scoring.ranked(queries, chunks, k, blocks)


def evaluate(items: DataFrame, models: DataFrame, encoders: dict[str, tuple[Callable, Callable]], policy: str = "maxsim", token_states: bool = False) -> DataFrame:
    """Items to ranks with patients. ``encoders`` has a factory for queries and one for documents of each model (the same, unless it has two)."""
    parts = []
    for model, (of_query, of_document) in encoders.items():
        one = models.where(F.col("model") == model)
        parts.append((encode.embed(items, one, of_query, token_states=token_states)[0], encode.embed(items, one, of_document, token_states=token_states)[1]))
    q, d = parts[0]
    for more_q, more_d in parts[1:]:
        q, d = q.unionByName(more_q), d.unionByName(more_d)
    return ranks(q, d, policy).join(items.select("site", "genre", "doc_idx", "patient"), ["site", "genre", "doc_idx"])


def statistics(ranks: DataFrame, models: DataFrame, replicates: int = bootstrap.REPLICATES, seed: int = bootstrap.SEED) -> dict[str, DataFrame]:
    """Ranks, which should be a stored table, to tables: means and hits, and point values with joint bootstrap intervals of correlation, overlap, regret and variance shares."""
    scopes, by = scopes_of(models), ["scope", "replicate"]
    point = stats.with_scope(scoring.cell_means(ranks), scopes)
    boot = stats.with_scope(bootstrap.boot_means(ranks, replicates, seed).withColumnRenamed("rr", "mrr"), scopes)
    order = models.select("model", "panel_ord")
    shares = stats.decompose(stats.complete(boot, by), by)
    return {
        "means": scoring.cell_means(ranks),
        "intervals": bootstrap.interval(bootstrap.boot_means(ranks, replicates, seed, per_cell=True), scoring.KEYS, "rr"),
        "tau": stats.kendall_tau(point, ["scope"]).join(bootstrap.interval(stats.kendall_tau(boot, by), ["scope", "genre"], "tau"), ["scope", "genre"], "left"),
        "overlap": stats.topk_overlap(point, ["scope"]),
        "regret": stats.selection_regret(point, ["scope"], order).join(
            bootstrap.interval(stats.selection_regret(boot, by, order), ["scope", "genre", "source", "destination"], "regret"), ["scope", "genre", "source", "destination"], "left"
        ),
        "variance": stats.decompose(stats.complete(point, ["scope"]), ["scope"]),
        "variance_intervals": bootstrap.interval(bootstrap.unpivoted(shares, by, stats.TERMS), ["scope", "term"], "value"),
    }


def sensitivity(queries: DataFrame, chunks: DataFrame, scopes: DataFrame, policies: tuple[str, ...] = POLICIES) -> DataFrame:
    """Variance shares and the verdict on genre for each scoring policy and scope."""
    rows, blocks = None, blocks_for(queries, chunks)
    for policy in policies:
        means = scoring.cell_means(ranks(queries, chunks, policy, blocks=blocks)).withColumn("policy", F.lit(policy))
        rows = means if rows is None else rows.unionByName(means)
    by = ["policy", "scope"]
    shares = stats.decompose(stats.complete(stats.with_scope(rows, scopes), by), by)
    return shares.withColumn("verdict", stats.genre_verdict(F.col("genre"), F.col("model")))


def genre_drop(shares: DataFrame, before: str = "maxsim", after: str = "length-norm") -> DataFrame:
    """By how much of itself the genre's share of variance drops from one policy to another, for each scope; 0 where there is none."""
    at = lambda policy: F.max(F.when(F.col("policy") == policy, F.col("genre")))
    wide = shares.groupBy("scope").agg(at(before).alias("before"), at(after).alias("after"))
    return wide.withColumn("drop_ratio", F.when(F.col("before") == 0, 0.0).otherwise((F.col("before") - F.col("after")) / F.col("before")))
