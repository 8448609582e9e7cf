import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from siftline.llm import phrase_mining as m


def brute(rows, least=10, longest=3, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in many.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def some_rows(seed=1, count=300):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "b", "é", "É", "İx", "x\x0cy", "x\xa0y", "zz", "\U0001f600"] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(count):
        w = [vocabulary[min(int(x), 39)] for x in rng.zipf(1.4, int(rng.integers(0, 60)))]
        marks = rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ; "], len(w))
        rows.append((["en", "de", None, "und", ""][int(rng.integers(0, 5))], "".join(x + y for x, y in zip(w, marks, strict=True))))
    rows += [("en", None), ("en", ""), (None, " . "), ("fr", "new york city " * 4000), ("fr", "York City " * 30)] + [("es", "same words here")] * 12
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, f int, `a.b` string")


@pytest.mark.parametrize(("bits", "longest"), [(m.BITS, 3), (1 << 7, 4)])
def test_against_brute_force(spark, bits, longest):
    """Also with four words, and with a bitmap so small that nearly everything is a false hit."""
    rows = some_rows(longest)
    got = sorted(tuple(r) for r in m.mine_phrases(table(spark, rows), longest=longest, most_bits=bits).collect())
    assert got == brute(rows, longest=longest)


def test_top_and_least(spark):
    rows = some_rows(9)
    got = sorted(tuple(r) for r in m.mine_phrases(table(spark, rows), least=3, top=7, share=90).collect())
    assert got == brute(rows, least=3, top=7, share=90)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in m.op13_phrase_mining(spark, sf).collect()) == sorted(con.sql(m.OP13_SQL).fetchall())


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    levels = spark.createDataFrame([("x", "a", 1, big + 1), ("x", "b", 1, big + 2), ("x", "a b", 2, big)], "g string, phrase string, words int, f long")
    (row,) = m._scored(levels, 3, 50).collect()
    assert row["score"] == 10**6 * big * big // ((big + 1) * (big + 2))


def test_empty(spark):
    assert m.mine_phrases(spark.createDataFrame([], "text string, lang string")).collect() == []
