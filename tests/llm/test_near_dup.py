import random

import numpy as np

from siftline.llm import near_dup as m


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(30))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        d, most = plain_distance(a, b), rng.randrange(12)
        assert m.edit_distance(list(a), list(b), most) == d if d <= most else m.edit_distance(list(a), list(b), most) > most
        longest = max(len(a), len(b), 1)
        assert m.similar(a, b, 0.8) == (d <= int(0.2 * longest + 1e-9))


def brute(rows, least=0.8):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(t or "", i)
            texts[t or ""] = min(texts[t or ""], i)
    ids, words = list(texts.values()), [t.lower().split() for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(ids)):
        for q in range(p):
            longest = max(len(words[p]), len(words[q]))
            if words[p] and words[q] and longest - min(len(words[p]), len(words[q])) <= 0.2 * longest and len(set(words[p]) & set(words[q])) > 0 and plain_distance(words[p], words[q]) <= 0.2 * longest + 1e-9:
                x, y = sorted((find(ids[p]), find(ids[q])))
                root[y] = x
    return sorted((str(i), None if i is None else find(texts[t or ""])) for i, t in rows)


def test_classes_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("rstlmn")
    rows, n = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice([12, 40, 90]))]
        for copy in range(rng.choice([1, 2, 30 if group == 0 else 4])):
            w = list(base)
            for _ in range(rng.randrange(max(1, len(w) // 20 + 1))):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (None, rows[0][1]), (n + 4, "one two"), (n + 5, "one two"), (n + 6, "One  two"), (n + 7, "x " * 9000), (0, rows[0][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    assert sorted((str(r[0]), r[1]) for r in m.near_duplicates(docs).collect()) == brute(rows)


def test_candidates_at_the_threshold():
    rng = np.random.default_rng(7)
    pairs = 300
    for n in (5, 8, 10, 12, 20, 30, 50, 64, 65, 80, 100, 250):
        for least in (0.8, 0.85):
            edits = int((1 - least) * n + 1e-9)
            sides = [[], []]
            for _ in range(pairs):
                a = rng.integers(0, 2**63, n).tolist()
                b = list(a)
                for at in rng.choice(n, edits, replace=False):
                    b[at] = int(rng.integers(0, 2**63))
                if edits and rng.random() < 0.3:  # a word less instead of one substitution
                    del b[max(i for i in range(n) if a[i] != b[i])]
                assert m.similar(a, b, 0.8)
                sides[0].append(a)
                sides[1].append(b)
            found = []
            for texts in sides:
                keys, at = m.candidate_keys(np.array(sum(texts, []), np.uint64), np.cumsum([0] + [len(t) for t in texts]))
                found.append([set(keys[x:y].tolist()) for x, y in zip(at, at[1:], strict=False)])
            share = sum(bool(x & y) for x, y in zip(*found, strict=True)) / pairs
            assert share == 1 if n <= 64 else share >= 0.98, (n, least, share)


def test_empty(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_class(spark):
    text = "some words of a document that is long enough to be compared with another one here"
    rows = [(7, text, 1, "a"), (3, text + " more", 2, "b"), (None, text, 3, "c"), (9, "another text", 4, "d"), (9, "a second text of the same id", 5, "e"), (None, "no id and alone", 6, "f"), (9, "another text", 4, "d"), (11, None, 7, "g"), (12, "", 8, "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, class_id int, row_key string")
    got = m.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[2] for r in got.collect()) == [2, 4, 5, 6, 7]
    assert m.keep_one_of_each(docs.limit(0)).collect() == []


def test_first_pairs_of_similar_texts_meet(spark):
    """Similar texts in one wide bucket share one of their first word pairs, whatever is frequent."""
    rng = random.Random(31)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("rst")
    texts = []
    for _ in range(60):
        a = [word() for _ in range(rng.randrange(5, 90))]
        b = list(a)
        for _ in range(int(0.2 * len(a))):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], [word()], [word()]])
        assert m.similar(a, b, 0.8)
        texts += [a, b]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").withColumn("root", m.F.col("id"))
    spare = lambda n: 2 * np.floor(0.2 * (n + 1) + 1e-9)
    first = {}
    for r in m.first_tokens(rows, m.pair_tokens, spare).collect():
        first.setdefault(r.id, {})[r.token] = r
    for i in range(0, len(texts), 2):
        shared = first[i].keys() & first[i + 1].keys()
        need = lambda n: n - 2 * int(0.2 * (n + 1) + 1e-9)
        fit = [t for t in shared if 1 + min(first[k][t]["all"] - first[k][t].place for k in (i, i + 1)) >= need(max(first[k][t]["all"] for k in (i, i + 1)))]
        assert fit or texts[i] == texts[i + 1], i


def test_profiles_pass_every_similar_pair():
    rng = random.Random(37)
    sides = [[], []]
    for i in range(400):
        n = rng.choice([1, 3, 10, 60, 400, 2000])
        word = lambda: rng.randrange(rng.choice([3, 50, 100000]))  # noqa: B023, E731
        a = [word() for _ in range(n)]
        b = list(a) if i % 4 else [word() for _ in range(n)]
        for _ in range(int(0.2 * n) if i % 4 else 0):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], [word()], [word(), word()]])
        sides[0].append(a)
        sides[1].append(b)
    counts = [m.profiles_of(np.array(sum(s, []), np.uint64), np.cumsum([0] + [len(t) for t in s])) for s in sides]
    longest = np.array([max(len(a), len(b)) for a, b in zip(*sides, strict=True)])
    passed = m.can_be_similar(*counts, longest, 0.8)
    true = np.array([m.similar(a, b, 0.8) for a, b in zip(*sides, strict=True)])
    assert true.sum() > 100 and not (true & ~passed).any() and (~passed).sum() > 20


def test_alignment_in_turns_finds_the_same_pairs(spark, monkeypatch):
    words = [f"v{i}" for i in range(40)]
    texts = spark.createDataFrame([(i, " ".join(["z"] * i + words[i:])) for i in range(12)], "id long, text string")
    pairs = m.write_out(spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)], "a long, b long"), "test-pairs")
    once = sorted(map(tuple, m.align_pairs(pairs, texts).collect()))
    monkeypatch.setattr(m, "TURN", 7)
    turns = []
    monkeypatch.setattr(m, "_aligned", lambda part, *rest, f=m._aligned: turns.append(part.count()) or f(part, *rest))
    assert sorted(map(tuple, m.align_pairs(pairs, texts).collect())) == once == [(a, b) for a in range(12) for b in range(a + 1, 12) if b - a <= 8]
    assert len(turns) == 6 and sum(turns) == 66
