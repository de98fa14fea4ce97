import os

import pytest

from corvane.plans import flows, views
from corvane.sources.stages import Stages, shared_folder, source_version


def test_a_stage_is_made_once(spark, tmp_path):
    for _ in range(2):
        s = Stages(spark, str(tmp_path))
        assert s.table("a", ("v1",), lambda: spark.range(3)).count() == 3
    assert s.made == []
    assert s.table("a", ("v2",), lambda: spark.range(4)).count() == 4 and s.made == ["a"]
    assert s.table("b", ("v1",), lambda: spark.range(5)).count() == 5 and s.made == ["a", "b"]


def test_what_is_not_committed_is_not_taken(spark, tmp_path):
    s = Stages(spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        s.table("a", ("v",), lambda: 1 / 0)
    assert s.table("a", ("v",), lambda: spark.range(2)).count() == 2
    (key,) = [x.removesuffix(".commit") for x in os.listdir(s.folder) if x.endswith(".commit")]
    os.rename(f"{s.folder}/{key}.commit", f"{tmp_path}/moved")  # a writer that was lost before its marker
    spark.range(99).write.parquet(f"{s.folder}/{key}/other")
    assert s.table("a", ("v",), lambda: spark.range(7)).count() == 7


def test_a_marker_without_its_table_is_made_again(spark, tmp_path):
    s = Stages(spark, str(tmp_path))
    s.table("a", ("v",), lambda: spark.range(2))
    (key,) = [x.removesuffix(".commit") for x in os.listdir(s.folder) if x.endswith(".commit")]
    os.rename(f"{s.folder}/{key}", f"{tmp_path}/gone")
    assert s.table("a", ("v",), lambda: spark.range(8)).count() == 8


def test_an_empty_stage(spark, tmp_path):
    for _ in range(2):
        s = Stages(spark, str(tmp_path))
        assert s.table("a", ("v",), lambda: spark.range(0)).collect() == []
    assert s.made == []


def test_versions_follow_the_files(spark, tmp_path):
    at = f"{tmp_path}/t"
    spark.range(10).write.parquet(at)
    first = source_version(spark.read.parquet(at))
    assert source_version(spark.read.parquet(at)) == first
    spark.range(1).write.mode("append").parquet(at)
    assert source_version(spark.read.parquet(at)) != first


def test_bucketed_stages_join_without_a_shuffle(spark, tmp_path):
    pairs = lambda n: spark.range(n).selectExpr("id % 7 as a", "id as b", "id * 2 as x")
    for n in range(2):
        s = Stages(spark, str(tmp_path))
        left = s.bucketed("left", ("v",), lambda: pairs(300), ("a", "b"), 4)
        right = s.bucketed("right", ("v",), lambda: pairs(200).withColumnRenamed("x", "y"), ("a", "b"), 4)
        both = left.hint("merge").join(right, ["a", "b"])
        plan = both.groupBy("a", "b").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and both.where("x = y").count() == 200
        if n == 0:  # another session knows no such table
            for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("corvane_")]:
                spark.sql(f"DROP TABLE `{name}`")
    assert s.made == []


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda k, *d: {"spark.sql.warehouse.dir": "file:/home/x/warehouse"}.get(k, *d))

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_folder(Session).endswith("/corvane-work")


def test_pairs_are_stored_and_documents_read_twice(spark, sf, tmp_path):
    version = (source_version(views.table(spark, sf, "documents")),)
    s = Stages(spark, str(tmp_path))
    pairs, _ = flows.excluded_pairs(views.notes(spark, sf), s, version)
    assert s.made == ["unique", "chosen", "pool", "sentences", "frequency", "queries", "pairs"]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "documents.parquet" not in plan
    again = Stages(spark, str(tmp_path))
    assert flows.excluded_pairs(views.notes(spark, sf), again, version)[0].count() == pairs.count() and again.made == []
    other = Stages(spark, str(tmp_path))
    flows.excluded_pairs(views.notes(spark, sf), other, version, seed=7)
    assert len(other.made) == 7
    items = flows.matched_items(views.notes(spark, sf), stages=again, made_of=version)
    assert again.made == ["matched"] and items.groupBy("site", "genre").count().select("count").distinct().count() == 1
