"""Patient-clustered bootstrap over pre-aggregated ranks.

Ranks are summed by cell, model and patient once. A replicate draws as many patients as its
site has (or its cell, for the flavour that draws cells apart). Patients are numbered and cut
into blocks; a replicate's draws are first split over the blocks, by one number each, and then
each block deals those that fell to it over its own patients. Numbers are counter-based: a
draw's depends on the seed, the site, the replicate, the block and its place alone, so any task can make the
draws of its own block and no other. What is stored and shuffled are draws by replicate and
block; patients' weights exist only inside the task that has their sums, as a matrix that is
multiplied with them. No row is ever made for a replicate and a patient.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stages import Stages
from .sampling import draw
from .scoring import KEYS

REPLICATES, SEED = 2000, 42
#: Patients of a block, blocks that a task takes at once, replicates of a row of draws, and draws that are held at once.
BLOCK, BLOCKS_AT_ONCE, RUN, DRAWS = 1024, 16, 50, 1 << 20
# The increment of the golden ratio, and the multipliers and a tag of a 32-bit mix.
GOLDEN, MIX_A, MIX_B, TAG = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x5BF03635


def patient_sums(ranks: DataFrame, values: tuple[str, ...] = ("rr",)) -> DataFrame:
    """Sums and counts for each cell, model and patient."""
    return ranks.groupBy(*KEYS, "patient").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("n"))


# --- draws


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 32-bit numbers."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX_A)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX_B)
    return h ^ (h >> np.uint32(16))


class Draws:
    """The counter-based draws of some replicates of a site (told by its number) in one block; ``part`` 0 is the split over blocks."""

    def __init__(self, site: int, replicates: np.ndarray, part: int):
        with np.errstate(over="ignore"):
            h = mix(np.uint32(site) + replicates.astype(np.uint32) * np.uint32(GOLDEN))
            self.h = mix(h + np.uint32(part * GOLDEN & 0xFFFFFFFF))
            self.step = mix(self.h ^ np.uint32(TAG)) | np.uint32(1)

    def __call__(self, replicate: np.ndarray, place: np.ndarray, below: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(self.h[replicate] + place.astype(np.uint32) * self.step[replicate]) % np.uint32(below)).astype(np.int64)


def split(site: int, n: int, replicates: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How many of the ``n`` draws of each replicate fall to each block."""
    blocks, draws = -(-n // block), Draws(site, replicates, 0)
    out = np.zeros((len(replicates), blocks), np.int64)
    for i in range(len(replicates)):
        for a in range(0, n, DRAWS):
            place = np.arange(a, min(n, a + DRAWS))
            out[i] += np.bincount(draws(np.full(len(place), i), place, n) // block, minlength=blocks)
    return out


def dealt(site: int, block_no: int, size: int, replicates: np.ndarray, counts: np.ndarray):
    """Runs of replicates and the weights that the ``counts`` draws of each give the ``size`` patients of a block."""
    draws, ends = Draws(site, replicates, block_no + 1), np.cumsum(counts)
    a = 0
    while a < len(replicates):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + DRAWS, "right")))
        replicate = np.repeat(np.arange(a, b), counts[a:b])
        place = np.arange(len(replicate)) - np.repeat(ends[a:b] - counts[a:b] - (ends[a - 1] if a else 0), counts[a:b])
        at = (replicate - a) * size + draws(replicate, place, size)
        yield a, b, np.bincount(at, minlength=(b - a) * size).reshape(b - a, size)
        a = b


def _unit(per_cell: bool) -> list[str]:
    return ["site", "genre"] if per_cell else ["site"]


def numbered(sums: DataFrame, unit: list[str], block: int) -> DataFrame:
    """``unit, patient, block, place, size``: patients in the order of their hashes, which are counted by ranges and ordered within."""
    ids = sums.select(*unit, "patient").where("patient is not null").distinct().withColumn("h", F.md5(F.col("patient").cast("string")))
    ids = ids.withColumn("range", F.substring("h", 1, 3))
    counts = ids.groupBy(*unit, "range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*unit)  # 4,096 ranges at most
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ids.join(counts.select(*unit, "range", before.alias("before"), F.sum("n").over(whole).alias("all")), [*unit, "range"])
    ix = F.col("before") + F.row_number().over(Window.partitionBy(*unit, "range").orderBy("h", "patient")) - 1
    placed = placed.select(*unit, "patient", "all", ix.alias("ix"))
    first = F.expr(f"ix div {block}")
    return placed.select(*unit, "patient", first.alias("block"), (F.col("ix") - first * block).cast("int").alias("place"), F.least(F.lit(block), F.col("all") - first * block).cast("int").alias("size"))


def block_draws(sums: DataFrame, replicates: int, seed: int, unit: list[str], block: int) -> DataFrame:
    """``unit, at, block, first, counts``: the draws that fall to a block, for a run of replicates from ``first`` on."""
    sizes = sums.where("patient is not null").groupBy(*unit).agg(F.count_distinct("patient").alias("n")).withColumn("number", draw(seed, *unit)).collect()  # a row for each site, or cell
    runs = []
    for r in sizes:
        step = max(1, min(RUN, 50 * DRAWS // r["n"]))
        runs += [(*[r[c] for c in unit], r["number"], r["n"], first, min(step, replicates - first)) for first in range(0, replicates, step)]
    fields = [sums.schema[c] for c in unit]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("number", "n", "first", "runs")]])

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, n, first, count = (batch.column(c)[i].as_py() for c in ("number", "n", "first", "runs"))
                parts = split(number, n, np.arange(first, first + count), block)
                blocks = parts.shape[1]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, count, dtype=np.int32)), pa.array(parts.T.reshape(-1).astype(np.int32)))
                same = [batch.column(c).take(pa.array(np.full(blocks, i))) for c in (*unit, "number", "first")]
                yield pa.record_batch([*same[:-1], pa.array(np.arange(blocks)), same[-1], cells], [*unit, "number", "block", "first", "counts"])

    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    tasks = sums.sparkSession.createDataFrame(runs, schema).repartition(max(1, min(len(runs), 1024)))
    return tasks.mapInArrow(work, f"{told}, number long, block long, first long, counts array<int>").withColumn("at", F.expr(f"block div {BLOCKS_AT_ONCE}"))


def _by_block(members: pa.Table, draws: pa.Table):
    """For each block that has members: their rows, its number, its size, the site's number, and its draws by replicate."""
    of, drawn = members["block"].to_numpy(), draws["block"].to_numpy()
    order = np.lexsort((draws["first"].to_numpy(), drawn))
    for block in np.unique(of):
        mine = order[drawn[order] == block]
        if len(mine):
            counts = draws["counts"].combine_chunks().take(pa.array(mine)).flatten().to_numpy()
            rows = np.flatnonzero(of == block)
            yield rows, int(block), members["size"][int(rows[0])].as_py(), draws["number"][int(mine[0])].as_py(), counts.astype(np.int64)


def _names(rows: DataFrame, prefix: str = "d_") -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def _plain_names(t: pa.Table) -> pa.Table:
    return t.rename_columns([c.removeprefix("d_") for c in t.column_names])


def weights(ranks: DataFrame, replicates: int = REPLICATES, seed: int = SEED, per_cell: bool = False, block: int = BLOCK) -> DataFrame:
    """``replicate, site[, genre], patient, w``: how often each is drawn, as rows. To look at draws with; the means don't make them."""
    unit = _unit(per_cell)
    members = numbered(ranks, unit, block).withColumn("at", F.expr(f"block div {BLOCKS_AT_ONCE}"))
    keys = [*unit, "at"]

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        for rows, no, size, number, counts in _by_block(left, _plain_names(right)):
            row_of = np.zeros(size, np.int64)
            row_of[left["place"].to_numpy()[rows]] = rows
            for a, _, w in dealt(number, no, size, np.arange(len(counts)), counts):
                r, p = np.nonzero(w)
                out.append((a + r, row_of[p], w[r, p]))
        r, p, w = (np.concatenate(x) for x in zip(*out, strict=True))
        picked = left.take(pa.array(p))
        return pa.table({"replicate": pa.array(r.astype(np.int32)), **{c: picked[c] for c in (*unit, "patient")}, "w": pa.array(w)})

    told = ", ".join(f"{c} {ranks.schema[c].dataType.simpleString()}" for c in (*unit, "patient"))
    drawn = _names(block_draws(ranks, replicates, seed, unit, block))
    return members.groupBy(*keys).cogroup(drawn.groupBy(*[f"d_{c}" for c in keys])).applyInArrow(work, f"replicate int, {told}, w long")


def boot_means(ranks: DataFrame, replicates: int = REPLICATES, seed: int = SEED, per_cell: bool = False, values: tuple[str, ...] = ("rr",), block: int = BLOCK) -> DataFrame:
    """``replicate, site, genre, model`` and the weighted mean of each value; cells that a replicate leaves empty are absent.

    Means are rounded to 12 places, so that equal ones tie in whatever order they were summed. Rows without a patient don't count.
    """
    unit, totals = _unit(per_cell), [*values, "n"]
    rest = [c for c in KEYS if c not in unit]
    sums = Stages(ranks.sparkSession).table("sums", (uuid.uuid4().hex,), lambda: patient_sums(ranks, values))
    members = sums.join(numbered(sums, unit, block), [*unit, "patient"]).withColumn("at", F.expr(f"block div {BLOCKS_AT_ONCE}")).drop("patient")
    kinds = {c: to_arrow_type(sums.schema[c].dataType) for c in KEYS}
    keys = [*unit, "at"]

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        codes = np.zeros(left.num_rows, np.int64)
        for c in rest:
            column = left[c].combine_chunks().dictionary_encode()
            codes = codes * (len(column.dictionary) + 1) + column.indices.fill_null(len(column.dictionary)).to_numpy()
        _, first, group = np.unique(codes, return_index=True, return_inverse=True)
        place, x = left["place"].to_numpy(), np.stack([left[v].to_numpy().astype(np.float64) for v in totals])
        out = np.zeros((len(totals), len(first), replicates))
        for rows, no, size, number, counts in _by_block(left, _plain_names(right)):
            own = np.zeros((len(totals), len(first), size))
            own[:, group[rows], place[rows]] = x[:, rows]
            for a, b, w in dealt(number, no, size, np.arange(replicates), counts):
                out[:, :, a:b] += own @ w.T
        offsets = pa.array(np.arange(len(first) + 1, dtype=np.int32) * replicates)
        named = left.take(pa.array(first))
        cells = {c: pa.array([key[unit.index(c)].as_py()] * len(first), kinds[c]) if c in unit else named[c] for c in KEYS}
        return pa.table({**cells, **{v: pa.ListArray.from_arrays(offsets, pa.array(out[i].reshape(-1))) for i, v in enumerate(totals)}})

    told = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in KEYS)
    drawn = _names(block_draws(sums, replicates, seed, unit, block))
    parts = members.groupBy(*keys).cogroup(drawn.groupBy(*[f"d_{c}" for c in keys])).applyInArrow(work, f"{told}, " + ", ".join(f"{v} array<double>" for v in totals))
    each = parts.select(*KEYS, F.posexplode(F.arrays_zip(*totals)).alias("replicate", "t")).groupBy("replicate", *KEYS).agg(*[F.sum(f"t.{v}").alias(v) for v in totals])
    return each.where("n > 0").select("replicate", *KEYS, *[F.round(F.col(v) / F.col("n"), 12).alias(v) for v in values])


def interval(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and exact 2.5 and 97.5 percentiles of a value over replicates; nulls don't count."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = values.groupBy(*by).agg(F.avg(value).alias("boot_mean"), p.alias("p"))
    return out.select(*by, "boot_mean", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def unpivoted(wide: DataFrame, by: list[str], terms: tuple[str, ...]) -> DataFrame:
    """A row for each term: ``by, term, value``."""
    pairs: list[Column] = [F.struct(F.lit(t).alias("term"), F.col(t).alias("value")) for t in terms]
    return wide.select(*by, F.explode(F.array(*pairs)).alias("t")).select(*by, "t.term", "t.value")
