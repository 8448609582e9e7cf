import random
from collections import Counter

from pyspark.sql import functions as F

import regex

from siftline.llm import decontaminate as m


def words(t):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", t.lower())


def grams(w, k):
    c = Counter()
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        c[g] += sum(map(len, g))
    return c


def brute(docs, items):
    out = set()
    for i, t in docs:
        w = words(t or "")
        for item, x in items:
            v = words(x or "")
            if not v:
                continue
            k, n = min(5, len(v)), len(v)
            want = grams(v, k)
            for s in range(len(w) - n + 1):
                got = grams(w[s : s + n], k)
                low = sum((want & got).values())
                if low >= 0.8 * sum((want | got).values()) - 1e-9:
                    out.add((i, item))
                    break
    return out


def table():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioubcdrstlmn") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([15, 25, 40, 55])))) for i in range(30)] + [(30, "Tiny item here"), (31, None), (32, " ... "), (33, "the the the the the the the the")]
    docs = []
    for i in range(120):
        body = text(rng.randrange(0, 120))
        if i % 3 == 0:
            x = rng.choice(items[:31])[1].split()
            if i % 2 and len(x) > 20:
                x[rng.randrange(3)] = word()
            if i % 5 == 0 and len(x) > 20:
                del x[-2:]
            at = rng.randrange(len(body) + 1)
            body[at:at] = x
        docs.append((i, " ".join(body).upper() if i % 7 == 0 else ", ".join(body)))
    return docs + [(500, None), (501, ""), (502, items[3][1] + " " + " ".join(text(20_000))), (503, "tiny, ITEM: here!"), (504, "the " * 60), (503, "tiny, ITEM: here!")], items


def test_against_brute_force(spark):
    docs, items = table()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    small = [(i, t) for i, t in docs if i != 502]
    got = m.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id != 502} == brute(small, items)
    assert (502, 3) in {(r.doc_id, r.item_id) for r in got}
    left = m.drop_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {r.doc_id for r in got}


def test_index_finds_all_within_radius():
    rng = random.Random(1)
    items = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(20)) for _ in range(300)]
    index = m.ItemIndex(list(range(300)), items)
    import numpy as np

    for row in range(0, 300, 17):
        mark = index.marks[20][row].copy()
        for b in rng.sample(range(64), m.RADIUS):
            mark[b // 8] ^= 1 << (b % 8)
        want = np.flatnonzero(np.bitwise_count(index.marks[20] ^ mark).sum(axis=1) <= m.RADIUS)
        assert list(index.within(20, mark)) == list(want) and row in want


def test_empty(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert m.contaminated(docs, items).collect() == [] and m.contaminated(one, items).collect() == [] and m.drop_contaminated(one, items).count() == 1


def test_rows_are_decided_by_their_own_text(spark):
    item = "these are the words of a benchmark item that nobody should learn from at all"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"before {item} after", 1), (None, "clean words without any of it", 2), (5, item, 3), (5, "clean words of the same id", 4), (6, item[:30], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id int").withColumn("row_key", F.lit("x"))
    got = m.drop_contaminated(docs, items)
    assert got.columns == docs.columns and sorted(r.bad_id for r in got.collect()) == [2, 4, 5]
    # windows equally similar: the first is reported, each item once
    twice = m.contaminated(spark.createDataFrame([(1, f"{item} and again {item}")], "doc_id long, text string"), items).collect()
    assert [(r.first_word, r.similarity) for r in twice] == [(0, 1.0)]
