import gzip
import json

import numpy as np
import pytest

from corvane.operators import encode
from corvane.sources import notes


def test_long_notes(spark, tmp_path):
    big = "x" * 400
    rows = ['note_id,subject_id,text,charttime', f'1,7,"{big}\nsaid ""yes""",2015-02-03 04:05:06', f'2,,{big},never', f'3,8,{"y" * 399},2015-01-01', '4,9,,2015-01-01']
    path = tmp_path / "n.csv.gz"
    path.write_bytes(gzip.compress("\n".join(rows).encode()))
    got = notes.read_long_notes(spark, str(path), "a", "discharge").orderBy("doc_key").collect()
    assert [(r.doc_key, r.patient, r.year) for r in got] == [("1", "7", 2015), ("2", "nan", None)]
    assert got[0].text.endswith('\nsaid "yes"')


def test_wide_notes(spark, tmp_path):
    big = "z" * 400
    head = "patientdurablekey,Discharge_Summary_Text,Discharge_Summary_Year,Discharge_Summary_Note_Key,Imaging_Text,Imaging_Year"
    path = tmp_path / "w.csv"
    path.write_text("\n".join([head, f"p1,{big},2011,k1,short,2012", f"p2,,x,k2,{big},unknown"]))
    got = notes.read_wide_notes(spark, str(path), "b").orderBy("genre").collect()
    assert [(r.genre, r.patient, r.year, r.doc_key) for r in got] == [("discharge", "p1", 2011, "k1"), ("imaging", "p2", None, None)]


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("patientdurablekey,Imaging_Text\np,t")
    with pytest.raises(ValueError, match="Discharge_Summary_Text"):
        notes.read_wide_notes(spark, str(path), "b")


def test_cells_and_ranks_round_trip(spark, tmp_path):
    doc = {"N": 2, "cells": {"A|d": [{"query": "q0", "target": "t0", "patient": "p", "year": 2010}, {"query": "q1", "target": "t1", "patient": "p", "year": None}]}}
    path = tmp_path / "cells.json"
    path.write_text(json.dumps(doc))
    cells = notes.read_cell_json(spark, str(path))
    assert [(r.site, r.genre, r.doc_idx, r.query, r.year) for r in cells.orderBy("doc_idx").collect()] == [("A", "d", 0, "q0", 2010), ("A", "d", 1, "q1", None)]
    notes.write_cells(cells, f"{tmp_path}/cells")
    assert notes.read_cells(spark, f"{tmp_path}/cells").where("site = 'A'").count() == 2
    ranks = spark.createDataFrame([("A", "d", "m1", 0, 0.5), ("A", "d", "m2", 0, 1.0)], "site string, genre string, model string, doc_idx long, rr double")
    notes.write_ranks(ranks, f"{tmp_path}/ranks")
    assert notes.read_ranks(spark, f"{tmp_path}/ranks", ["m2"]).first().rr == 1.0
    notes.write_mrr_json(spark.createDataFrame([("A", "d", "m1", 0.5, 0.4, 0.6)], "site string, genre string, model string, mrr double, lo double, hi double"), f"{tmp_path}/mrr")
    assert spark.read.json(f"{tmp_path}/mrr").first().cell == "A|d|m1"


def test_manifest_keeps_prefix_blanks(spark, tmp_path):
    path = tmp_path / "models.csv"
    path.write_text('key,query_prefix,doc_prefix\na,"query: ",\n')
    r = notes.read_manifest(spark, str(path)).first()
    assert (r.query_prefix, r.doc_prefix) == ("query: ", "")


def test_pooling():
    h = np.arange(12.0).reshape(1, 3, 4)
    assert encode.pooled(h, np.array([[1, 1, 0]]), "cls").tolist() == [[0, 1, 2, 3]]
    assert encode.pooled(h, np.array([[1, 1, 0]]), "mean").tolist() == [[2, 3, 4, 5]]
    assert encode.pooled(h, np.zeros((1, 3)), "mean").tolist() == [[0, 0, 0, 0]]


def test_embedding_of_items(spark):
    items = spark.createDataFrame([(0, "g", 0, "a b", "a b " * 600), (0, "g", 1, "c", "")], "site int, genre string, doc_idx long, query string, target string")
    models = spark.createDataFrame([("m", "query: ", ""), ("n", "", "passage: ")], "model string, q_prefix string, d_prefix string")
    q, d = encode.embed(items, models, encode.hashed_encoder)
    assert q.count() == 4
    assert {(r.model, r.doc_idx): r["count"] for r in d.groupBy("model", "doc_idx").count().collect()} == {("m", 0): 3, ("n", 0): 3, ("n", 1): 1}
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-5 for r in d.collect())


def test_manifest_is_resolved_and_written(spark, tmp_path):
    rows = [("e5", "intfloat/e5", "", "query: ", "old"), ("medcpt", "ncbi/q", "ncbi/d", "", ""), ("x", "none/x", "", "", "")]
    manifest = spark.createDataFrame(rows, "key string, hf_repo string, hf_repo_secondary string, query_prefix string, revision string")
    revisions = spark.createDataFrame([("intfloat/e5", "aa"), ("ncbi/q", "bb"), ("ncbi/d", "cc"), ("other", "dd")], "repo string, revision string")
    notes.write_csv(notes.resolved_manifest(manifest, revisions), f"{tmp_path}/m")
    got = {r.key: (r.query_prefix, r.revision, r.revision_secondary) for r in notes.read_manifest(spark, f"{tmp_path}/m").collect()}
    assert got == {"e5": ("query: ", "aa", ""), "medcpt": ("", "bb", "cc"), "x": ("", "", "")}
