import math

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import topk_search as m


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 50)
    monkeypatch.setattr(m, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(60)]
    rows += [(400, None), (401, []), (402, [None] * 20), (403, [float("nan")] * 20), (404, [float("inf")] * 20), (420, [1.0, 2.0]), (421, [2.0, 1.0]), rows[20], rows[20], (40, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in m.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, 20)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert m.top_k(df, F.col("vec_id") % 20 == 0).collect() == []
