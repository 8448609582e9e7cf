"""The inverted index against scans, brute force and its own pruning."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from siftline.operators import inverted, retrieve, suggest
from siftline.operators.inverted import InvertedIndex
from siftline.plans.search import SearchEngine

WORDS = ["the", "fire", "safety", "report", "zebra", "a", "b1", "étude", "long_word"]


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    pick = lambda: " ".join(rng.choices(WORDS, [60, 5, 5, 3, 1, 30, 2, 2, 1], k=rng.randrange(0, 60)))
    rows = [(i, pick(), f"{rng.choice(WORDS)}_{i % 9}.pdf", "b") for i in range(n)] + [(n, None, None, None), (n + 1, "", "x", "b"), (n + 2, "zebra " * 500, "zebra.pdf", "b")]
    return spark.createDataFrame(rows, "doc_id long, chunk_text string, filename string, bucket string")


@pytest.mark.parametrize(("width", "first"), [(8, 2), (1024, 32)])
def test_search_equals_the_scan(spark, tmp_path, monkeypatch, width, first):
    monkeypatch.setattr(inverted, "WIDTH", width)
    chunks, fields = docs(spark), {"chunk_text": 1.0, "filename": 3.0, "bucket": 0.5}
    index = InvertedIndex(spark, f"{tmp_path}/ix")
    index.add(chunks.where("doc_id % 3 = 0"), list(fields))
    index.add(chunks.where("doc_id % 3 <> 0"), list(fields))
    for terms in (["zebra"], ["fire", "safety", "the"], ["the", "the", "nowhere"], ["b"], ["nowhere"], ["étude", "zebra", "b"]):
        scan = retrieve.keyword_search(chunks, list(dict.fromkeys(terms)), fields).select("doc_id", F.round("bm25", 7))
        assert sorted(map(tuple, index.matches(terms, fields).select("key", F.round("bm25", 7)).collect())) == sorted(map(tuple, scan.collect()))
        want = retrieve.top(retrieve.keyword_search(chunks, list(dict.fromkeys(terms)), fields), "bm25", 12, "doc_id")
        got = index.search(terms, fields, 12, first=first)
        assert [(r.key, round(r.bm25, 7)) for r in got.collect()] == [(r.doc_id, round(r.bm25, 7)) for r in want.collect()]
    where = F.col("doc_id") % 5 == 1
    want = retrieve.top(retrieve.keyword_search(chunks, ["fire", "zebra"], fields, where), "bm25", 12, "doc_id").select("doc_id", F.round("bm25", 7)).collect()
    got = retrieve.indexed_search(index, chunks, ["fire", "zebra"], fields, 12, where).select("doc_id", F.round("bm25", 7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_bounds_rule_out_blocks_and_bound_their_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WIDTH", 8)
    chunks, fields = docs(spark), {"chunk_text": 1.0}
    index = InvertedIndex(spark, f"{tmp_path}/ix")
    index.add(chunks, ["chunk_text"])
    stats = index.stats(["zebra", "the"], ["chunk_text"])
    bound = {r.block: r.bound for r in index.bounds(["zebra", "the"], fields, stats).collect()}
    blocks = max(1, -(-chunks.count() // 8))
    scores = index.matches(["zebra", "the"], fields).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).collect()
    assert all(r.bm25 <= bound[r.block] + 1e-9 for r in scores)
    best = sorted((r.bm25 for r in scores), reverse=True)[4]
    assert sum(b < best for b in bound.values()) > len(bound) / 4


def test_a_lookup_reads_its_row_groups_and_no_text(spark, tmp_path):
    chunks = docs(spark, 300).withColumn("chunk_text", F.concat("chunk_text", F.lit(" w"), F.col("doc_id")))
    index = InvertedIndex(spark, f"{tmp_path}/ix")
    index.add(chunks, ["chunk_text"], partitions=6)
    plan = index.search(["w17"], {"chunk_text": 1.0}, 5)._jdf.queryExecution().toString()
    assert "In(term, [w17])" in plan.replace("EqualTo(term,w17)", "In(term, [w17])") and "split(" not in plan and "chunk_text" not in plan.replace("chunk_text)", "").replace("chunk_text\x00", "").replace("[chunk_text", "").replace("= chunk_text", "").replace("chunk_text,", "")
    files = spark.read.parquet(f"{index.path}/{index.segments()[0]}/postings").select(F.input_file_name().alias("f"), "term").groupBy("f").agg(F.min("term").alias("a"), F.max("term").alias("b")).collect()
    assert sum(r.a <= "w17" <= r.b for r in files) == 1 and len(files) > 2


def test_texts_are_cut_where_their_block_is_and_no_deletions_are_kept(spark, tmp_path):
    chunks = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("abcdefghijkl"), "id", F.lit(" w w")).alias("chunk_text"))
    seen, write = [], DataFrameWriter.parquet

    def noted(self, path, **options):
        seen.append((path.rpartition("/")[2], self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", noted)
        index = InvertedIndex(spark, f"{tmp_path}/ix")
        index.add(chunks, ["chunk_text"])
    plans = dict(seen)
    # one exchange, of texts by block, none of terms; no cut of texts behind a range
    assert plans["unsorted"].count("Exchange hashpartitioning(block") == plans["unsorted"].count("Exchange ") == 1 and "Aggregate" not in plans["unsorted"]
    assert all("split(" not in p for p in plans.values() if "rangepartitioning" in p)
    # no table beside the dictionary grows with its terms, and a fuzzy lookup reads the fixed prefix alone
    assert list(plans) == ["unsorted", "postings", "terms", "fields"]
    near = index.near_terms("abcdefghijkl7", 1)
    assert sorted((r.term, r.df, r.edits) for r in near.collect())[:2] == [("abcdefghijkl0", 1, 1), ("abcdefghijkl1", 1, 1)]
    assert "StringStartsWith(term,ab)" in near._jdf.queryExecution().toString()
    assert index.matches(["w"], {"chunk_text": 1.0}).count() == 500


def test_string_keys_and_an_unfinished_segment(spark, tmp_path):
    chunks = docs(spark, 50).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    index = InvertedIndex(spark, f"{tmp_path}/ix")
    with pytest.raises(ValueError, match="no index"):
        index.table("terms")
    index.add(chunks, ["chunk_text"])
    (tmp_path / "ix" / "s-000009-x" / "postings").mkdir(parents=True)  # a writer that was lost
    want = retrieve.keyword_search(chunks, ["fire"], {"chunk_text": 1.0})
    assert sorted((r.key, round(r.bm25, 7)) for r in index.matches(["fire"], {"chunk_text": 1.0}).collect()) == sorted((r.doc_id, round(r.bm25, 7)) for r in want.collect())
    assert index.search(["nowhere"], {"chunk_text": 1.0}, 3).collect() == []


def osa_distance(a, b):
    """Edits with a swap of neighbours as one, by the plain table."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_by_columns(spark):
    rng = random.Random(5)
    words = ["", "a", "ab", "ba", "ca", "abc", "reprot", "report", "é", *{"".join(rng.choices("abcd", k=rng.randrange(1, 8))) for _ in range(150)}]
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    for asked in ("report", "abc", "badc", "a", ""):
        got = {r.term: r.e for r in frame.select("term", inverted.osa(F.col("term"), asked).alias("e")).collect()}
        assert got == {w: osa_distance(w, asked) for w in words}


def test_fuzzy_lookup_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(7)
    words = sorted({"th" + "".join(rng.choices("abc", k=rng.randrange(0, 14))) for _ in range(600)} | {"other", "t"})
    chunks = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, chunk_text string")
    index = InvertedIndex(spark, f"{tmp_path}/ix")
    index.add(chunks, ["chunk_text"])
    for asked in ("thabcabc", "thab", "thbacbacbacb", "thc"):
        most = retrieve.edits_allowed(asked)
        want = sorted((w, osa_distance(w, asked)) for w in words if w[:2] == "th" and len(w) > 2 and osa_distance(w, asked) <= most)
        near = index.near_terms(asked, most)
        assert sorted((r.term, r.edits) for r in near.collect()) == want
        assert "Python" not in near._jdf.queryExecution().toString()
    assert index.expand(["thabcacb", "zz"], retrieve.edits_allowed)[:3] == ["thabcacb", "zz", index.near_terms("thabcacb", 2).orderBy("edits", F.desc("df"), "term").first().term]


def test_engine_answers_the_same_with_and_without_an_index(spark, tmp_path):
    from datetime import datetime

    from siftline.functions.embed import embed

    chunks = docs(spark, 120).where("filename IS NOT NULL").withColumns({"extension": F.lit("pdf"), "mime_type": F.lit("application/pdf"), "object_key": F.concat(F.lit("b/"), "doc_id"), "_id": F.col("doc_id").cast("string"), "size_bytes": F.lit(5), "owner": F.lit("me"), "uploaded_at": F.lit(datetime(2024, 1, 2))})
    vectors = chunks.select(F.col("doc_id").alias("vec_id"), embed(F.col("chunk_text")).alias("embedding"))
    index = InvertedIndex(spark, f"{tmp_path}/ix")
    index.add(chunks, list(retrieve.LIVE_FIELDS))
    plain, quick = SearchEngine(chunks, vectors), SearchEngine(chunks, vectors, index=index)
    for asked in ("pdf files about zebra safety", "zebar reports"):
        a, b = (e.search(asked, limit=8, now=datetime(2024, 2, 1)).hits.select("doc_id", "combined").collect() for e in (plain, quick))
        assert a == b and a
    a, b = (e.hybrid("zebra", [0.0] * 64, size=50) for e in (plain, quick))
    assert a[0].select("doc_id", "combined").collect() == b[0].select("doc_id", "combined").collect()
    assert a[2].first() == b[2].first()


def test_completions_grow(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "name string, weight double")
    path = f"{tmp_path}/c"
    suggest.write_completions(frame([(f"Doc {i}", float(i % 7)) for i in range(90)] + [("x" * 80 + "1", 1.0), ("", 1.0), (None, 1.0)]), path, keep=5)
    suggest.write_completions(frame([("doc new", 9.0), ("Doc 6", 8.0), ("x" * 80 + "2", 1.0)]), path, keep=5)
    table = suggest.completion_table(spark, path)
    assert [r.name for r in suggest.complete(table, "dO", 4).collect()] == ["doc new", "Doc 6", "Doc 13", "Doc 20"]
    assert [r.name for r in suggest.complete(table, "x" * 80, 4).collect()] == ["x" * 80 + "1", "x" * 80 + "2"]
    assert [r.name for r in suggest.complete(table, "x" * 80 + "2", 4).collect()] == ["x" * 80 + "2"]
    assert suggest.complete(table, "nobody").collect() == []
    assert table.groupBy("prefix").count().agg(F.max("count")).first()[0] == 5
    assert "EqualTo(prefix,do)" in suggest.complete(table, "do")._jdf.queryExecution().toString()
