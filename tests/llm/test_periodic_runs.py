import hashlib
import re
import zlib

import numpy as np
import pytest

from siftline.llm import periodic_runs as m


def brute_runs(w):
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and (s, length) not in seen:
                seen.add((s, length))
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    """The contract's row, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_texts(seed, count=400):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        w = rng.integers(0, rng.integers(1, 7), rng.integers(0, 150))
        if len(w) > 10 and rng.random() < 0.6:
            a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 12))
            w = np.concatenate([w[:a], np.resize(w[a : a + p], len(w) - a), rng.integers(0, 3, rng.integers(0, 4))])
        yield w


@pytest.mark.parametrize("pairs", [10, 2_000_000])
def test_runs_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(m, "PAIRS", pairs)
    docs = [np.asarray(w, np.int64) for w in random_texts(pairs)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = m.find_runs(np.concatenate(docs), offsets)
    assert [tuple(map(int, r)) for r in got] == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(list(d))]


def test_match_counts_by_both_ways():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, n) % 500 for n in (0, 5, 6, 900, 4000)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    counts, base, most = m.count_matches(np.concatenate(docs), offsets)
    assert list(most) == [0, 0, 1, 225, 1000]
    for i, d in enumerate(docs):
        assert counts[base[i] : base[i + 1]].tolist() == [int((d[:-q] == d[q:]).sum()) for q in range(1, most[i] + 1)]


def test_one_word_many_times():
    codes = np.zeros(200_000, np.int64)
    assert m.find_runs(codes, np.array([0, 200_000])).tolist() == [[0, 0, 200_000, 1]]


HARD = [None, "", "  \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é é é é é é é", "a\x1ca a a a a a", "b " * 3000 + "c", "ab ab\nab\tab\x0bab\x0cab\rab", "a a a a a a b b b b b b"]


def test_query_rows_against_brute_force(spark, tmp_path):
    rows = [(i, t, "x", "y") for i, t in enumerate(HARD * 12)] + [(None, "p q p q p q p q", "x", "y"), (3, HARD[9], "x", "y"), (3, HARD[9], "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in m.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t, *_ in rows), key=str)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in m.op11_periodic_runs(spark, sf).collect()}
    assert got == {r.doc_id: brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert any(r[1] for r in got.values())


def test_general_form(spark):
    docs = spark.createDataFrame([("k", "so so so so so so it goes")], "name string, body string")
    (row,) = m.periodic_runs(docs, text="body", key="name").collect()
    assert (row.name, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 8, [(0, 6, 1)], "so it goes")


def test_empty(spark):
    assert m.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
