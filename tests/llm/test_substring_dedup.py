import random

import numpy as np

from siftline.llm import substring_dedup as m


def test_window_minima_and_runs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 30, 31, 32, 200):
        v = rng.integers(0, 50, n).astype(np.uint64)
        w = min(31, n)
        want = sorted({max(range(i, i + w), key=lambda p: (-int(v[p]), p)) for i in range(n - w + 1)} if n else set())
        assert list(m.window_minima(v)) == want
    words = rng.integers(0, 9, 400).astype(np.uint64)
    words[300:330] = words[10:40]
    h = m.run_hashes(words)
    assert len(h) == 381 and (h[300:311] == h[10:21]).all()
    seen = {}
    for i in range(381):
        assert seen.setdefault(h[i], tuple(words[i : i + 20])) == tuple(words[i : i + 20])


def shingle_set(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_planted_passages_and_paragraph_classes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdrstlmn") for _ in range(rng.randrange(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.randrange(51, 90)) for _ in range(6)]
    rows, holders = [], {p: [] for p in range(6)}
    for i in range(150):
        lines = [text(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 5))]
        if i % 4 == 0:
            p = rng.randrange(6)
            holders[p].append(i)
            line = rng.choice(lines)
            at = rng.randrange(len(line) + 1)
            line[at:at] = passages[p][:20] + ["\n"] * (i % 8 == 0) + passages[p][20:]
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    near = text(120)
    for i in range(150, 156):
        w = list(near)
        w[rng.randrange(120)] = word()
        rows.append((i, "Intro " + str(i) + "\n" + " ".join(w)))
    rows += [(200, "short line here"), (201, "short line here"), (202, None), (203, ""), (None, " ".join(passages[0])), (204, " ".join(text(30) * 40)), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = m.repeated_passages(docs).collect()
    carriers = {i for h in holders.values() if len(h) > 1 for i in h} | set(range(150, 156))
    assert {r.doc_id for r in got} == carriers
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append(r)
    for h in holders.values():
        if len(h) > 1:
            assert all(any(not r.kept and r.class_doc_id == h[0] for r in spans[i]) for i in h[1:])
    assert all(any(not r.kept and r.n_words >= 120 and r.class_doc_id == 150 for r in spans[i]) for i in range(151, 156))


def test_paragraph_links_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubcdrst") for _ in range(4))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randrange(20, 100))]
        for c in range(4):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    sets = [shingle_set(t.split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {(i, find(i)) for i in range(len(rows)) if find(i) != i}
    got = {(r.doc_id, r.class_doc_id) for r in m.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.kept and r.n_words == len(rows[r.doc_id][1].split())}
    assert len(want - got) <= 0.02 * len(want) + 1 and len(want) > 20


def test_whole_passages_are_covered(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeioubcdrstlmn") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    rows, planted = [], []
    for n in (50, 51, 60, 100, 200) * 6:
        passage = text(n)
        # a third document, the least, holds only words from the middle
        part = passage[n // 3 : n // 3 + 22]
        for words in (part, passage, passage):
            before = text(150)
            planted.append((len(rows), len(before), len(words), words is passage and len(rows) % 3 == 2))
            rows.append((len(rows), " ".join(before + words + text(150))))
    gone = {}
    for r in m.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if not r.kept:
            gone.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    for i, at, n, copy in planted:
        assert gone.get(i, set()) <= set(range(at, at + n))
        assert not copy or gone[i] == set(range(at, at + n))


def test_empty(spark):
    assert m.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_repeat_a_doc_id_with_another_text(spark):
    """The paragraph is taken from the row that holds it, whatever the order of the rows."""
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:39], "other"])
    other = " ".join(f"x{i}" for i in range(45))
    for rows in ([(1, other), (1, " ".join(words)), (2, near)], [(1, " ".join(words)), (1, other), (2, near)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        found = {(r.doc_id, r.first_word, r.n_words, r.kept) for r in m.repeated_passages(docs).collect()}
        assert (2, 0, 40, False) in found and (1, 0, 40, True) in found


def test_runs_looked_up_in_parts_give_the_same_spans(spark, monkeypatch):
    words = [f"w{i}" for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join([*(f"own{i}x{k}" for k in range(25)), *words[i : 60 + 2 * i]])) for i in range(6)], "doc_id long, text string")
    hits = spark.createDataFrame([(i, 40) for i in range(6)], "at_doc long, first_word int")
    once = sorted(map(tuple, m.repeated_runs(docs, hits).collect()))
    monkeypatch.setattr(m, "RUNS_AT_ONCE", 50)
    named = []
    monkeypatch.setattr(m, "write_out", lambda df, name, f=m.write_out: named.append(name) or f(df, name))
    assert sorted(map(tuple, m.repeated_runs(docs, hits).collect())) == once and once
    assert named.count("shared-runs") > 3
