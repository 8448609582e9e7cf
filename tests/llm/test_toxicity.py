import random

from pyspark.sql import functions as F

from siftline.llm._labels import bucket
from siftline.llm.toxicity import drop_toxic, fit_toxicity, op8_toxicity, score_toxicity


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = op8_toxicity(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in got.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.8


def test_disguise_edges_and_clashing_columns(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(5))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = [word() for _ in range(30)] + (["you", "blorg!!"] * 3 if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (999_999, 1)]
    rows += [(1000, None, None), (1001, "", "b"), (None, "you blorg", "c"), (1002, "you bl0rg you bl0rg! blorg", "d"), (1003, " ".join(word() for _ in range(40_000)), "e"), (1001, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, lab, bucket("doc_id", 4) != 2)
    got = score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[1002].predicted == 1 and by[None].predicted == 1 and by[1001].predicted == 0 and by[1000].predicted == 0
    right = sum(by[i].predicted == y for i, y in labels if i in by and i is not None and y is not None)
    assert right >= 290


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, F.lit(True))
    assert score_toxicity(docs, model).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score_toxicity(one, model).first().score == 0.5


def test_dropped_rows_keep_their_columns(spark):
    toxic = [(i, f"you blorg number {i} " * 3, 1) for i in range(40)]
    clean = [(100 + i, f"quiet words number {i} " * 3, 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t, _ in toxic + clean] + [(None, None, "s", 9)], "doc_id long, text string, score string, predicted int")
    model = fit_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in toxic + clean], "doc_id long, toxic int"), F.lit(True))
    got = drop_toxic(docs, model)
    assert got.schema == docs.schema
    rows = got.collect()
    assert {r.score for r in rows} == {"s"} and {r.predicted for r in rows} == {9} and all(r.doc_id is None or r.doc_id >= 100 for r in rows) and len(rows) >= 60
