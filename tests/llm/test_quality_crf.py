import itertools

import numpy as np
import pyarrow as pa

from siftline.llm import quality_crf as m
from siftline.llm._labels import bucket


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 4, 2, 6]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    score, moves = rng.normal(size=offsets[-1]), rng.normal(size=(2, 2))
    good, expected, norm = m.forward_backward(score, offsets, moves)
    want, moved, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for a, b in zip(offsets, offsets[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([np.exp(sum(s * v for s, v in zip(score[a:b], p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        total += np.log(w.sum())
        w /= w.sum()
        for p, q in zip(paths, w):
            want[a:b] += q * np.array(p)
            for x, y in zip(p, p[1:]):
                moved[x, y] += q
    assert np.allclose(good, want) and np.allclose(expected, moved) and np.isclose(norm, total)


def test_lines_of_texts():
    texts = pa.array(["a\n\nb", "", "x", "\n", "", "last\n"], pa.large_string())
    data, starts, ends, offsets = m.line_bounds(texts)
    lines = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert lines == [x for t in texts.to_pylist() for x in t.split("\n")]
    assert list(np.diff(offsets)) == [3, 1, 1, 2, 1, 2]
    x, size, _ = m.line_features(texts)
    assert x.shape == (10, m.FEATURES) and np.isfinite(x).all() and list(size) == [len(v) for v in lines]
    alone = np.concatenate([m.line_features(pa.array([t], pa.large_string()))[0] for t in texts.to_pylist()])
    assert np.allclose(alone, x)


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = m.op6_quality_classifier(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in got.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(i, "Good line here.\nAnother fine line." if i % 2 else "$$ %% $$\n%% $$ ##", "z") for i in range(200)] + [(900, None, None), (901, "", ""), (None, "$$ %%", ""), (902, "word\n" * 5000, "")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (5555, 0)], "doc_id long, quality int")
    by = {r.doc_id: r for r in m.score_quality(docs, m.fit_quality(docs, labels, bucket("doc_id", 5) != 0)).collect()}
    assert all(by[i].predicted == i % 2 for i in range(200)) and by[None].predicted == 0
    assert all(0 <= r.score <= 1 for r in by.values()) and len(by) == 204
    none = spark.createDataFrame([], "doc_id long, text string")
    empty = m.fit_quality(none, labels, bucket("doc_id", 5) != 0)
    assert m.score_quality(none, empty).collect() == [] and m.score_quality(docs, empty).first().score == 0.5


def test_blocks_of_lines_and_of_chains_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    lines = ["", "Some plain words here.", "§§ 12 ## !!", "CAPS", "again again again", "\t"]
    texts = pa.array(["\n".join(rng.choice(lines, n)) for n in (1, 2, 700, 1, 3000)] + ["", "no end"], pa.large_string())
    whole = m.line_features(texts)
    monkeypatch.setattr(m, "BLOCK", 7)
    for a, b in zip(whole, m.line_features(texts), strict=True):
        assert np.array_equal(a, b)
    score, moves = rng.normal(size=len(whole[0])) * 3, rng.normal(size=(2, 2))
    want = m.forward_backward(score, whole[2], moves)
    monkeypatch.setattr(m, "LONG", 600)
    for a, b in zip(want, m.forward_backward(score, whole[2], moves), strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_a_text_of_many_lines_is_scored_in_bounded_memory():
    import resource
    import time

    chain = m.LineChain(np.linspace(-1, 1, m.FEATURES), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(m.FEATURES), np.ones(m.FEATURES))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    share = m.QualityModel(chain, m.Isotonic()).share(pa.array(["\n" * 1_000_000], pa.large_string()))
    assert 0 <= share[0] <= 1 and time.time() - began < 60
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


def test_columns_of_any_name(spark):
    from siftline.llm import toxicity
    from siftline.llm.boosting import BoostedTrees

    docs = spark.createDataFrame([(1, "a text", 2, "z"), (2, None, 3, "y")], "`a.b` int, text string, `c0` int, `x``y` string")
    found = m.score_quality(docs, m.QualityModel(None, m.Isotonic()))
    assert found.columns == ["a.b", "text", "c0", "x`y", "score", "predicted"] and [tuple(r)[:4] for r in found.collect()] == [tuple(r) for r in docs.collect()]
    model = toxicity.ToxicityModel({}, BoostedTrees(), m.Isotonic().fit(np.zeros(0), np.zeros(0)))
    assert toxicity.score_toxicity(docs, model).columns == found.columns
    assert toxicity.drop_toxic(docs, model, 2.0).collect() == docs.collect()
