import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import _graph as m


def roots_of(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    want = roots_of({v for e in edges if e[0] != e[1] for v in e}, edges)
    got = {r.id: r.root for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert m.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("jaccard", [False, True])
def test_wide_buckets_lose_no_link(spark, jaccard):
    """One bucket of dissimilar sets that share a passage, with similar sets hidden in it."""
    rng = random.Random(2)
    sets = {}
    for i in range(120):
        own = 40 + i % 9
        sets[i] = frozenset(range(60)) | {1000 * (i + 1) + j for j in range(own)}
    for i in range(120, 150):
        base = rng.randrange(120)
        sets[i] = frozenset(list(sets[base])[:-3]) | {10**6 * (i + 1) + j for j in range(3)}
    largest = lambda a, b: len(sets[a] | sets[b]) if jaccard else max(len(sets[a]), len(sets[b]))
    overlap = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * largest(a, b)
    truth = [(a, b) for a in sets for b in sets if a < b and overlap(a, b)]
    buckets = spark.createDataFrame([(7, i, len(s), len(sets)) for i, s in sets.items()], "key long, id long, size int, n long")
    order = lambda s: sorted(s, key=lambda t: (t < 60, t * 7919 % 10007))
    first = [(i, t, k + 1, len(s)) for i, s in sets.items() for k, t in enumerate(order(s)[: int(0.2 * len(s) + 1e-9) + 1])]
    prefixes = spark.createDataFrame(first, "id long, token long, place int, all int")
    ok = F.udf(overlap, "boolean")
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.where(ok("a", "b"))

    got = {r.id: r.root for r in m.linked_components(buckets, verify, lambda members: prefixes.join(members, "id"), "test", 0.8, None if jaccard else lambda n, k: 0.8 * F.greatest(n, k)).collect()}
    want = {i: r for i, r in roots_of(sets, truth).items() if any(i in p for p in truth)}
    assert got == want and len(truth) >= 30
    assert sum(compared) < 150 * 149 / 2 / 3


def test_size_classes_keep_similar_sizes_together_and_repeat_few_rows(spark):
    sizes = list(range(1, 400))
    keys = {}
    for row in m.by_size(spark.createDataFrame([(7, s, s, len(sizes)) for s in sizes], "key long, id long, size int, n long"), 1.25).collect():
        keys.setdefault(row.id, set()).add(row.key)
    assert all(keys[a] & keys[b] for a in sizes for b in sizes if a <= b <= 1.25 * a)
    assert not keys[10] & keys[100]
    assert sum(map(len, keys.values())) < 1.5 * len(sizes)
