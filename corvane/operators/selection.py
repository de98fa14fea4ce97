"""Exact percentiles of groups of any size, by histograms that are refined around the ranks wanted.

Every round counts the values of an interval in bins and goes on with the one bin that holds the
rank, between the least and the greatest value found in it, so intervals shrink
to one value or to few, which are then put in order. A round shuffles at most ``BINS`` rows for each interval
and task, and no buffer ever holds more than ``FEW`` values of an interval. Bins are a
monotone function of the value, so ranks are exact whatever rounding does.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import Stages

BINS, FEW = 1024, 4096


def percentiles(rows: DataFrame, by: list[str], value: str, ps: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by, p``: an array of the percentiles ``ps``, linear between neighbours as ``percentile`` has them.

    ``rows`` are read once a round, so they should be a stored table where they take work.
    Nulls and values that aren't finite don't count; groups without others are absent.
    Integers beyond 2^53 count as the doubles they become.
    """
    stages, tag = Stages(rows.sparkSession), uuid.uuid4().hex
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("one"))
    x = rows.select(group.alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('inf')")
    keep = lambda name, df: stages.table(f"selection-{name}", (tag,), lambda: df)
    ends = x.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.ceil(F.lit(float(p)) * (F.col("n") - 1))) for p in ps])))
    state = keep("0", ends.select("g", "n", F.explode(wanted).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    wide = f"lo < hi and inside > {few}"
    half = F.col("hi") / 2 - F.col("lo") / 2  # halves, since a difference may be too large for a double
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / F.nullif(half, F.lit(0.0)) * bins))
    place = F.coalesce(place, (F.col("x") > F.col("lo")).cast("long"))
    for i in range(1, 5000):
        if state.where(wide).isEmpty():
            break
        spans = state.where(wide).select("g", "lo", "hi").distinct()
        binned = x.join(spans, "g").where("x between lo and hi").groupBy("g", "lo", place.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.sum("c").over(Window.partitionBy("g", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # at most ``bins`` rows
        counted = binned.withColumn("before", F.coalesce(before, F.lit(0)))
        found = state.where(wide).join(counted, ["g", "lo"]).where("k - below >= before and k - below < before + c")
        narrowed = found.select("g", "n", "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside"))
        state = keep(str(i), state.where(f"not ({wide})").unionByName(narrowed))
    spans = state.where("lo < hi").select("g", "lo", "hi").distinct()
    sorted_values = x.join(spans, "g").where("x between lo and hi").groupBy("g", "lo").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # ``few`` at most
    picked = state.join(sorted_values, ["g", "lo"], "left").select("g", "n", "k", F.coalesce(F.get("xs", (F.col("k") - F.col("below")).cast("int")), "lo").alias("v"))
    at = picked.groupBy("g").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))  # two for each percentile
    out = []
    for p in ps:
        rank = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        a, b = F.element_at("at", low), F.element_at("at", high)
        out.append(F.when((low == high) | (a == b), a).otherwise((high - rank) * a + (rank - low) * b))
    return at.select(*[F.col(f"g.{c}").alias(c) for c in by], F.array(*out).alias("p"))
