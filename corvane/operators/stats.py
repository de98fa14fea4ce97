"""How model rankings agree between sites, and what a ranking's choice costs.

All take ``site, genre, model, mrr`` rows, with any number of further grouping
columns ``by`` (a scope, a bootstrap replicate), and a panel of ``model, panel_ord``
where order decides ties. Sites are two.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stages import Stages

LEAST_MODELS = 3


def with_scope(mrr: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows once for each scope that the model is in; ``scopes`` has ``scope, model``."""
    return mrr.join(F.broadcast(scopes), "model")  # a row for each scope and model of the panel


def complete(mrr: DataFrame, by: list[str], cells: int = 4) -> DataFrame:
    """Only the groups in which every model that occurs has all of its cells."""
    counts = mrr.groupBy(*by, "model").agg(F.count("*").alias("n")).groupBy(*by).agg(F.min("n").alias("least")) if by else None
    if counts is None:
        return mrr
    return mrr.join(counts.where(F.col("least") >= cells).select(*by), by, "left_semi")


def both_sites(mrr: DataFrame, by: list[str]) -> DataFrame:
    """``by, genre, model, a, b``: each model's values at the two sites, in order of site."""
    sites = mrr.groupBy(*by, "genre", "model").agg(F.min_by("mrr", "site").alias("a"), F.max_by("mrr", "site").alias("b"), F.countDistinct("site").alias("n"))
    return sites.where("n = 2").drop("n")


def kendall_tau(mrr: DataFrame, by: list[str]) -> DataFrame:
    """Tau-b between the sites' rankings of their common models, for each genre; null if a side is all ties."""
    x = both_sites(mrr, by)
    y = x.select(*by, "genre", F.col("model").alias("model2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    pairs = x.join(y, [*by, "genre"]).where("model < model2").select(*by, "genre", F.signum(F.col("a") - F.col("a2")).alias("da"), F.signum(F.col("b") - F.col("b2")).alias("db"))
    sums = pairs.groupBy(*by, "genre").agg(F.sum(F.col("da") * F.col("db")).alias("s"), F.sum(F.abs("da")).alias("na"), F.sum(F.abs("db")).alias("nb"), F.count("*").alias("n_pairs"))
    enough = F.col("n_pairs") >= LEAST_MODELS * (LEAST_MODELS - 1) // 2
    return sums.where(enough).select(*by, "genre", F.try_divide(F.col("s"), F.nullif(F.sqrt(F.col("na") * F.col("nb")), F.lit(0.0))).alias("tau"))


RUN, MOST_RUNS = 65_536, 1024


def _signs(x: np.ndarray, y: np.ndarray) -> int:
    """The sum over pairs of the product of the signs of their differences in ``x`` and in ``y``, by merging runs."""
    n = len(x)
    if n < 2:
        return 0
    order = np.lexsort((y, x))
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    x = x[order]
    total, width, top, at = 0, 1, n + 1, np.arange(n)
    while width < n:
        pair, right = at // (2 * width), at // width % 2 > 0
        key = pair * top + y
        left = np.sort(key[~right])
        begin = np.searchsorted(left, pair[right] * top)
        total += int((np.searchsorted(left, key[right]) - begin).sum()) - int((np.searchsorted(left, (pair[right] + 1) * top) - np.searchsorted(left, key[right], "right")).sum())
        width *= 2
    new = np.concatenate([[True], x[1:] != x[:-1]])
    tied = np.diff(np.append(np.flatnonzero(new), n))  # equal in x: in order of y, so those that differ there were counted up
    both = np.diff(np.append(np.flatnonzero(new | np.concatenate([[True], y[1:] != y[:-1]])), n))
    return total - int((tied * (tied - 1) // 2).sum()) + int((both * (both - 1) // 2).sum())


def kendall_tau_runs(mrr: DataFrame, by: list[str], run: int = RUN) -> DataFrame:
    """``kendall_tau`` for any number of models, in n log n and without a row for each pair.

    Both sides are cut into ranges of about ``run`` values (``MOST_RUNS`` at most). Pairs of one range of the first
    side are counted by merging sorted runs there, pairs of one range of the second side and
    different ones of the first likewise, and all others by the counts of models in each
    combination of ranges. So no task holds more than a range, or a group's table of
    combinations. A range that is one value has no order on its side, and is left out, however many share it.
    """
    group = F.struct(*[F.col(c) for c in (*by, "genre")])
    x = Stages(mrr.sparkSession).table("tau", (uuid.uuid4().hex,), lambda: both_sites(mrr, by).select(group.alias("g"), "a", "b"))
    n = F.col("n").cast("decimal(38,0)")
    pairs_of = lambda c: x.groupBy("g", c).agg(F.count("*").alias("n")).groupBy("g").agg(F.sum(n * (n - 1) / 2).alias(f"ties_{c}"))
    sizes = x.groupBy("g").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    runs = min(MOST_RUNS, -(-most // run))
    if runs > 1:
        cuts = [i / runs for i in range(1, runs)]
        below = lambda c: F.size(F.filter(f"cuts_{c}", lambda cut: cut <= F.col(c)))
        splits = x.groupBy("g").agg(*[F.percentile_approx(c, cuts, 10 * runs).alias(f"cuts_{c}") for c in "ab"])
        placed = x.join(splits, "g").select("g", "a", "b", *[below(c).alias(f"{c}_run") for c in "ab"])
    else:
        placed = x.select("g", "a", "b", F.lit(0).alias("a_run"), F.lit(0).alias("b_run"))

    def inside(side: str, first: str, second: str) -> DataFrame:
        """Sums over the pairs of one range of a side; ranges of one value of that side, or of one range of the other, give nothing."""
        spread = placed.groupBy("g", side).agg(F.min(first).alias("l"), F.max(first).alias("m"), F.min(second).alias("p"), F.max(second).alias("q")).where("l < m and p < q").select("g", side)

        def work(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"g": pa.array([key[0].as_py()], kind), "s": pa.array([_signs(t[first].to_numpy(), t[second].to_numpy())])})

        rows = placed.join(spread, ["g", side])
        return rows.groupBy("g", side).applyInArrow(work, f"g {x.schema['g'].dataType.simpleString()}, s long")

    def across(key: tuple, t: pa.Table) -> pa.Table:
        h = np.zeros((t["a_run"].to_numpy().max() + 1, t["b_run"].to_numpy().max() + 1), np.int64)
        h[t["a_run"].to_numpy(), t["b_run"].to_numpy()] = t["n"].to_numpy()
        later = h[::-1].cumsum(axis=0)[::-1] - h  # in later ranges of the first side, by range of the second
        above = later[:, ::-1].cumsum(axis=1)[:, ::-1] - later
        below = later.cumsum(axis=1) - later
        return pa.table({"g": pa.array([key[0].as_py()], kind), "s": pa.array([int((h * (above - below)).sum())])})

    kind = to_arrow_type(x.schema["g"].dataType)
    shape = f"g {x.schema['g'].dataType.simpleString()}, s long"
    parts = inside("a_run", "a", "b")
    if runs > 1:
        parts = parts.unionByName(inside("b_run", "a_run", "b"))
        parts = parts.unionByName(placed.groupBy("g", "a_run", "b_run").agg(F.count("*").alias("n")).groupBy("g").applyInArrow(across, shape))  # at most MOST_RUNS squared
    signs = parts.groupBy("g").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    every = n * (n - 1) / 2
    out = sizes.where(F.col("n") >= LEAST_MODELS).join(pairs_of("a"), "g").join(pairs_of("b"), "g").join(signs, "g", "left")
    scale = F.sqrt((every - F.col("ties_a")).cast("double") * (every - F.col("ties_b")).cast("double"))
    return out.select("g.*", F.try_divide(F.coalesce("s", F.lit(0)).cast("double"), F.nullif(scale, F.lit(0.0))).alias("tau"))


def topk_overlap(mrr: DataFrame, by: list[str], ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """The share of the best ``k`` models, of both sites' common ones, that the sites agree on, for each ``k``."""
    x = both_sites(mrr, by)
    rank = lambda c: F.row_number().over(Window.partitionBy(*by, "genre").orderBy(F.desc(c), "model"))
    ranked = x.withColumn("ra", rank("a")).withColumn("rb", rank("b"))
    return ranked.groupBy(*by, "genre").agg(*[(F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)) / F.least(F.lit(k), F.count("*"))).alias(f"top{k}") for k in ks])


def selection_regret(mrr: DataFrame, by: list[str], panel: DataFrame) -> DataFrame:
    """What choosing the source site's best model costs at the destination, both ways; a model missing there counts as its worst."""
    ranked = mrr.join(F.broadcast(panel), "model")
    best = F.row_number().over(Window.partitionBy(*by, "genre", "site").orderBy(F.desc("mrr"), "panel_ord"))
    chosen = ranked.withColumn("place", best).withColumn("n", F.count("*").over(Window.partitionBy(*by, "genre", "site"))).where((F.col("place") == 1) & (F.col("n") >= LEAST_MODELS))
    src = chosen.select(*by, "genre", F.col("site").alias("source"), F.col("model").alias("picked"))
    dst = chosen.select(*by, "genre", F.col("site").alias("destination"), F.col("model").alias("best"), F.col("mrr").alias("best_mrr"))
    worst = mrr.groupBy(*by, "genre", F.col("site").alias("destination")).agg(F.min("mrr").alias("worst_mrr"))
    got = mrr.select(*by, "genre", F.col("site").alias("destination"), F.col("model").alias("picked"), F.col("mrr").alias("got"))
    pairs = src.join(dst, [*by, "genre"]).where("source <> destination").join(worst, [*by, "genre", "destination"]).join(got, [*by, "genre", "destination", "picked"], "left")
    return pairs.select(*by, "genre", "source", "destination", "picked", "best", (F.col("best_mrr") - F.coalesce("got", "worst_mrr")).alias("regret"))


TERMS = ("model", "site", "genre", "model_x_site", "model_x_genre", "site_x_genre", "model_x_site_x_genre")


def decompose(mrr: DataFrame, by: list[str]) -> DataFrame:
    """Shares of variance of a balanced three-way design, by one CUBE over model, site and genre."""
    level = F.grouping("model") * 4 + F.grouping("site") * 2 + F.grouping("genre")
    tag = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("one"))
    rows = mrr.select(tag.alias("group"), "model", "site", "genre", "mrr")
    grand = rows.groupBy("group").agg(F.avg("mrr").alias("grand"))
    cube = rows.groupingSets([[c for c in ("group", m, s, g) if c] for m in ("model", None) for s in ("site", None) for g in ("genre", None)], "group", "model", "site", "genre")
    means = cube.agg(level.cast("int").alias("level"), F.count("*").alias("n"), F.avg("mrr").alias("mean"))
    d = F.col("mean") - F.col("grand")
    ss = means.join(grand, "group").groupBy("group").agg(*[F.sum(F.when(F.col("level") == i, F.col("n") * d * d)).alias(f"s{i}") for i in range(7)])
    total = F.nullif(F.col("s0"), F.lit(0.0))
    share = {
        "model": F.col("s3"),
        "site": F.col("s5"),
        "genre": F.col("s6"),
        "model_x_site": F.col("s1") - F.col("s3") - F.col("s5"),
        "model_x_genre": F.col("s2") - F.col("s3") - F.col("s6"),
        "site_x_genre": F.col("s4") - F.col("s5") - F.col("s6"),
        "model_x_site_x_genre": F.col("s0") - F.col("s1") - F.col("s2") - F.col("s4") + F.col("s3") + F.col("s5") + F.col("s6"),
    }
    return ss.select(*[F.col("group")[c].alias(c) for c in by], *[F.try_divide(share[t], total).alias(t) for t in TERMS])


def contrast_verdict(low: Column, high: Column) -> Column:
    """Which of model-by-site and model-by-genre is the larger, by an interval of their difference."""
    return F.when(low > 0, "site larger").when(high < 0, "genre larger").otherwise("undecided")


def genre_verdict(genre: Column, model: Column) -> Column:
    return F.when((genre >= 0.30) & (genre >= model), "survives").when(genre >= 0.25, "comparable").otherwise("collapses")
