"""The vector index: recall against brute force, probed lists only, odd vectors, hot lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import retrieve, vector_index
from siftline.operators.vector_index import VectorIndex
from siftline.plans.queries import ANN_PROBE, QUERIES

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def exact(rows, q, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    return [i for _, i in sorted((-round(float(unit[i] @ unit[q]), 9), i) for i in unit if i != q)[:k]]


def test_recall_over_the_table(spark, tmp_path):
    """Recall at 50 of one query and of the registered query; the table's vectors are spread evenly, the worst case for lists."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: list(r.embedding) for r in table.collect()}
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(table)
    assert index.rows().count() == len(rows)
    want = {r.vec_id for r in retrieve.knn_search(table, rows[7], 50).collect()}
    got = {r.key for r in index.search(rows[7], 50, round(ANN_PROBE * len(index.model().centroids))).collect()}
    assert len(want & got) >= 45
    found = {}
    for r in QUERIES["ann_topk"](spark, SF).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == {i for i in rows if i % 50 == 0}
    hits = [len(set(found[q]) & set(exact(rows.items(), q, 50))) / 50 for q in found]
    assert np.mean(hits) >= 0.9


def clustered(n=3000, dim=10, clusters=30, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    return [(i, (centres[i % clusters] + rng.normal(size=dim)).tolist()) for i in range(n)]


def test_few_lists_suffice_where_vectors_cluster(spark, tmp_path):
    rows = clustered()
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(frame(spark, rows), lists=60, sample=1000)
    asked = rows[:300:20]
    got = {}
    for r in index.search_all(frame(spark, asked), 10, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.key
    assert np.mean([len(set(got[q].values()) & set(exact(rows, q, 10))) / 10 for q, _ in asked]) >= 0.9
    one = index.search(rows[40][1], 10, 6)
    assert "In(list, [" in one._jdf.queryExecution().toString()
    assert one.first().key == 40 and round(one.first().cosine, 5) == 1


def test_every_list_and_enough_refinement_is_exact(spark, tmp_path, monkeypatch):
    """A third of the rows are one vector, groups are split, and still each query has its exact neighbours."""
    monkeypatch.setattr(vector_index, "ROWS", 50)
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    rows = clustered(300, 6, 5)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(frame(spark, rows), lists=8)
    asked = [r for r in rows if r[0] % 50 == 0]
    got = {}
    for r in index.search_all(frame(spark, asked), 7, 8, refine=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.key)
    assert got == {q: exact(rows, q, 7) for q, _ in asked}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]])
def test_odd_vectors_take_no_part(spark, tmp_path, rows):
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(frame(spark, rows))
    assert index.rows().count() == 0 and index.search([1.0, 2.0], 3, 1).collect() == []
    good = [(10, [1.0, 0.0]), (11, [0.0, 2.0]), (12, [1.0, 2.0, 3.0]), (13, [5.0, 5.0])]
    index = VectorIndex(spark, f"{tmp_path}/w")
    index.build(frame(spark, rows + good))
    assert [(r.key, round(r.cosine, 6)) for r in index.search([3.0, 0.0], 9, 9).collect()] == [(10, 1.0), (13, 0.707107), (11, 0.0)]
    assert index.search([1.0], 3, 9).collect() == [] and index.search([0.0, 0.0], 3, 9).collect() == []
    assert index.search_all(frame(spark, rows + good), 2, 9).where(F.col("query_id") == 12).count() == 0
