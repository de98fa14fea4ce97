import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators.selection import percentiles

PS = (0.0, 0.025, 0.5, 0.95, 0.975, 1.0)


def both(spark, rows, **more):
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(4)
    want = df.where("not isnan(x) and abs(x) < double('inf')").groupBy("g", "h").agg(F.percentile("x", F.array(*[F.lit(p) for p in PS])).alias("p"))
    got = {(r.g, r.h): r.p for r in percentiles(df, ["g", "h"], "x", PS, **more).collect()}
    assert got == {(r.g, r.h): r.p for r in want.collect()}
    return got


@pytest.mark.parametrize("more", [{}, {"bins": 32, "few": 20}])
def test_equals_percentile(spark, more):
    r = np.random.default_rng(1)
    rows = [("a", 1, float(x)) for x in r.standard_normal(300)]
    rows += [("b", 1, float(x)) for x in r.integers(0, 4, 200)]  # ties
    rows += [(None, 2, float(10.0**x)) for x in r.uniform(-4, 4, 60)]
    rows += [("one", 0, 5.0), ("two", 0, 1.0), ("two", 0, 2.0), ("same", 0, 3.0), ("same", 0, 3.0)]
    rows += [("odd", 0, None), ("odd", 0, float("nan")), ("odd", 0, float("inf")), ("odd", 0, 1.5), ("none", 0, None)]
    rows += [("far", 0, x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 1.0)]
    got = both(spark, rows, **more)
    assert ("none", 0) not in got and got["odd", 0] == [1.5] * len(PS)


def test_without_groups(spark):
    df = spark.range(1001).selectExpr("cast(id as double) x")
    assert percentiles(df, [], "x", (0.5, 0.9), few=10).collect()[0].p == [500.0, 900.0]


def test_no_rows(spark):
    assert percentiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", (0.5,)).collect() == []
