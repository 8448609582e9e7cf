"""Contracts of the engine's operators on literal rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.config import CachePolicy, SearchConfig
from siftline.functions import text as fx
from siftline.functions.embed import embed
from siftline.operators import cache, chunking, dead_letters, documents, ingest, parse, predicates, quality, report, results, retrieve
from siftline.plans.search import SearchEngine
from siftline.sources import chunk_store, generators, readers
from siftline.streaming import ingestion


def test_chunks_cover_the_text_in_bounds():
    rng = random.Random(1)
    words = ["alpha", "be", "gammagamma", "d\n", "e\n\n", "x" * 700]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(400)))
        got = chunking.chunk_one(text)
        body = text.strip()
        assert [c["chunk_index"] for c in got] == list(range(len(got)))
        for c in got:
            assert 20 <= len(c["text"]) <= 600 and body[c["start_char"] : c["end_char"]] == c["text"] and c["total_chunks"] == len(got)
        covered = set()
        for c in got:
            covered.update(range(c["start_char"], c["end_char"]))
        left = sum(not ch.isspace() for i, ch in enumerate(body) if i not in covered)
        assert left <= 20 * (1 + len(body) // 500)
    assert chunking.chunk_one(None) == [] and chunking.chunk_one("short") == []


def test_chunk_column_counts(spark):
    docs = spark.createDataFrame([(1, "word " * 400), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.explode_chunks(docs, "text").collect()
    assert {r.doc_id for r in rows} == {1} and all(r.chunk_total == len(rows) for r in rows)


def test_parse_follows_the_phrases(spark):
    row = parse.parse(spark.createDataFrame([("Show me PDF files about fire safety bigger than 2.5MB last week",), (" ",)], "query string"), 2024).collect()
    assert row[0].filters == ["date:last_week", "size:size_gt:2.5MB", "extension:5mb", "extension:pdf"]
    assert row[0].keywords == ["fire", "safety"] and (row[1].filters, row[1].keywords, row[1].intent_text) == ([], [], "")


def test_exact_date_is_half_open_in_its_zone(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 5, 14, 18, 30)), (2, datetime(2024, 5, 15, 18, 29, 59)), (3, datetime(2024, 5, 15, 18, 30)), (4, datetime(2024, 5, 14, 18, 29))], "i int, uploaded_at timestamp")
    assert {r.i for r in rows.where(predicates.clause("exact_date:may_15_2024", datetime(2024, 6, 1), "+05:30")).collect()} == {1, 2}
    assert rows.where(predicates.clause("exact_date:feb_30_2024", datetime(2024, 6, 1))).count() == 0


def test_dedup_keeps_the_best_chunk_of_a_file(spark):
    hits = spark.createDataFrame([("b", "f.pdf", 1, 0.7), ("b", "f.pdf", 2, 0.9), ("c", "f.pdf", 3, 0.8)], "bucket string, filename string, doc_id long, combined double")
    assert {(r.bucket, r.combined) for r in results.best_per(hits, ["bucket", "filename"], "combined", "doc_id").collect()} == {("b", 0.9), ("c", 0.8)}
    assert [r.combined for r in results.worker_dedup(hits.withColumn("object_key", F.lit("")).withColumn("_id", F.lit("")), "combined").collect()] == [0.9]


def test_normalisation_edges(spark):
    one = spark.createDataFrame([(1, 5.0)], "id int, s double")
    assert one.select(retrieve.min_max("s").alias("n")).first().n == 1.0
    three = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, s double")
    assert sorted(r.n for r in three.select(retrieve.min_max("s").alias("n")).collect()) == [0.001, 0.5, 1.0]
    assert three.where("id > 5").select(retrieve.min_max("s").alias("n")).collect() == []


def test_keyword_only_hits_stay_below_the_threshold(spark):
    knn = spark.createDataFrame([(1, 0.9), (2, 0.5)], "doc_id int, knn double")
    words = spark.createDataFrame([(3, 9.0), (4, 1.0)], "doc_id int, bm25 double")
    got = {r.doc_id: r.combined for r in retrieve.fuse(knn, words, "doc_id").collect()}
    assert got[1] == 0.6 and got[3] == 0.4 and all(0 <= v <= 1 for v in got.values())


@pytest.mark.parametrize("term,most", [("ab", 0), ("abc", 1), ("abcde", 1), ("abcdef", 2)])
def test_edits_allowed(term, most):
    assert retrieve.edits_allowed(term) == most


def test_fuzzy_search_finds_a_swapped_word(spark):
    chunks = spark.createDataFrame([(1, "the report is here", "a.pdf"), (2, "nothing at all", "b.pdf")], "doc_id long, chunk_text string, filename string")
    assert [r.doc_id for r in retrieve.keyword_search(chunks, ["reprot"], {"chunk_text": 1.0}, fuzzy=True).collect()] == [1]


def test_upsert_keeps_old_values_of_nulls_and_deletes(spark):
    old = spark.createDataFrame([("a#0", "f", 1), ("a#1", "f", 2), ("b#0", "g", 3)], "_id string, object_key string, n int")
    new = spark.createDataFrame([("a#0", "f", None), ("c#0", "h", 9)], "_id string, object_key string, n int")
    once = ingest.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a#0", "f", 1), ("a#1", "f", 2), ("b#0", "g", 3), ("c#0", "h", 9)]
    assert sorted(map(tuple, ingest.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    assert {r._id for r in ingest.upsert(old, new, replace_file="object_key").collect()} == {"a#0", "b#0", "c#0"}
    assert {r._id for r in ingest.delete_by_key(old, new).collect()} == {"b#0"}


def test_dead_letter_counts(spark):
    letters = spark.createDataFrame([('{"original_payload":"x"}',), ('{"original_payload":"x","retry_count":2}',), ('{"original_payload":"x","retry_count":3}',), ("{no",), ('{"error":"e"}',), (None,)], "value string")
    got = [(r.action, r.next_count, r.wait_seconds) for r in dead_letters.transition(letters).collect()]
    assert got == [("retry", 1, 60), ("retry", 3, 900), ("permanent", None, None), ("skip", None, None), ("permanent", None, None), ("skip", None, None)]


def test_cache_promotes_and_expires():
    now = [0.0]
    store = cache.ResultCache(CachePolicy(), lambda: now[0])
    calls = []
    run = lambda: calls.append(1) or {"total": 1}
    assert cache.cached_search(store, "search:a", run)["_cache"]["hit"] is False
    for _ in range(10):
        assert cache.cached_search(store, "search:a", run)["_cache"]["hit"]
    now[0] = 1799
    assert store.get("search:a") and len(calls) == 1
    now[0] = 1801
    assert store.get("search:a") is None and store.get_stats()["hits"] == 11
    store.set("search:b", {"x": 1}, has_filters=True)
    assert store.entries["search:b"][0] == 1801 + 600 and store.invalidate_all() == 1


def test_cache_key_ignores_tag_order_and_case(spark):
    args = lambda q, tags: [F.lit(q), F.lit("PDF"), *[F.lit(None).cast("string")] * 2, F.array(*map(F.lit, tags)), *[F.lit(None).cast("string")] * 2, F.lit(10), F.lit(0)]
    row = spark.range(1).select(cache.library_key(*args("Fire Safety", "ab")).alias("x"), cache.library_key(*args("fire safety", "ba")).alias("y"), cache.library_key(*args("report", "ab")).alias("z")).first()
    assert row.x == row.y != row.z and len(row.x) == len(cache.PREFIX) + 32


def test_quality_flags(spark):
    texts = ["plain words here", "<FEFF00410042>", "a endobj b", "Acrobat Distiller", "<x:xmpmeta>", "/ENU (a) /DEU (b)", "éééé", "ab" * 40, "  \n  a", "1234567890" * 4]
    got = [len(r.f) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(quality.flags(F.col("t")).alias("f")).collect()]
    assert got[0] == 0 and all(n >= 1 for n in got[1:])


def test_embedding_has_unit_length_or_none(spark):
    row = spark.createDataFrame([("fire safety rules",), ("  ",), (None,)], "t string").select(F.round(fx.norm(embed(F.col("t"))), 6).alias("n")).collect()
    assert [r.n for r in row] == [1.0, 0.0, 0.0]


def test_stream_equals_batch(spark, tmp_path):
    record = lambda n, k, s=10: f'{{"Records":[{{"eventName":"s3:{n}","s3":{{"bucket":{{"name":"u"}},"object":{{"key":"{k}","size":{s},"contentType":"application/pdf"}}}}}}]}}'
    values = [record("ObjectCreated:Put", "a+b.PDF"), record("ObjectCreated:Put", "c.pdf"), "{broken", record("ObjectRemoved:Delete", "c.pdf"), record("ObjectCreated:Put", "big.pdf", 200 * 1024 * 1024), record("ObjectAccessed:Get", "a.pdf"), record("ObjectCreated:Put", "d.pdf")]
    frame = spark.createDataFrame([(str(i), v, "t", 0, i, datetime(2024, 1, 1, 0, 0, i)) for i, v in enumerate(values)], readers.MESSAGE)
    frame.repartitionByRange(3, "offset").write.json(f"{tmp_path}/in")
    query = ingestion.start(readers.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/stream", f"{tmp_path}/dead", f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert query.exception() is None
    ingestion.apply_batch(frame, f"{tmp_path}/batch", f"{tmp_path}/dead2")
    names = lambda where: sorted((r._id, r.filename, r.extension) for r in chunk_store.chunk_table(spark, f"{tmp_path}/{where}").collect())
    assert names("stream") == names("batch") == [("u__a b.PDF#0", "a b.PDF", "pdf"), ("u__d.pdf#0", "d.pdf", "pdf")]
    assert spark.read.json(f"{tmp_path}/dead").count() == spark.read.json(f"{tmp_path}/dead2").count() == 2


def test_blobs_and_point_get(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text(" hello ")
    (tmp_path / "x" / "b.bin").write_bytes(b"%PDF-1.7")
    rows = readers.blobs(spark, str(tmp_path / "x")).withColumn("mime", ingest.detect_mime(F.col("content"), F.col("content_type"))).withColumn("r", ingest.extract(F.col("content"), F.col("mime")))
    got = {r.filename: (r.mime, r.r.text, r.r.success) for r in rows.collect()}
    assert got == {"a.txt": ("text/plain", "hello", True), "b.bin": ("application/pdf", None, False)}


def test_engine_end_to_end(spark):
    chunks = spark.createDataFrame([(i, f"k/{i}", "b", f"f{i % 3}.pdf", "pdf", "application/pdf", 10, datetime(2024, 1, 2), f"fire safety text {i}" if i < 4 else f"other words {i}", "me", f"id{i}") for i in range(9)], "doc_id long, object_key string, bucket string, filename string, extension string, mime_type string, size_bytes long, uploaded_at timestamp, chunk_text string, owner string, _id string")
    vectors = chunks.select(F.col("doc_id").alias("vec_id"), embed(F.col("chunk_text")).alias("embedding"))
    engine = SearchEngine(chunks, vectors)
    found = engine.search("find me pdf files about fire safety", limit=5, now=datetime(2024, 2, 1))
    rows = found.hits.collect()
    assert found.keywords == ["fire", "safety"] and rows and all(r.combined >= 0.45 and "fire" in r.chunk_text for r in rows)
    assert len({r.filename for r in rows}) == len(rows) and rows[0].summary
    page, facets, size = engine.hybrid("fire safety", engine.embed_query("fire safety"), size=2, extension="pdf")
    assert len(page.collect()) == 2 and facets["extension"].first().key == "pdf" and size.first().total_size == 40
    assert [r.filename for r in engine.suggest("F").collect()] == ["f0.pdf", "f1.pdf", "f2.pdf"]
    assert retrieve.clamp_limit("x") == SearchConfig().default_limit


def record(name, key, size=10, kind="application/octet-stream"):
    return f'{{"Records":[{{"eventName":"s3:{name}","s3":{{"bucket":{{"name":"u"}},"object":{{"key":"{key}","size":{size},"contentType":"{kind}"}}}}}}]}}'


def messages(spark, values, start=0):
    return spark.createDataFrame([(str(i), v, "t", 0, start + i, datetime(2024, 1, 1, 0, 0, start + i)) for i, v in enumerate(values)], readers.MESSAGE)


def test_files_are_found_by_their_sentences(spark, tmp_path):
    store = tmp_path / "store" / "u" / "reports"
    store.mkdir(parents=True)
    sentence = "The lighthouse keeper counted seventeen pelicans before breakfast."
    (store / "birds.html").write_text("<html><head><style>x</style></head><body><p>" + sentence + "</p>" + "<p>Filler about tides and harbours.</p>" * 60 + "</body></html>")
    (store / "engine.txt").write_text("Gearbox oil is changed every ninety days. " * 30)
    (store / "blank.txt").write_text("   \n ")
    (store / "scan.pdf").write_bytes(b"%PDF-1.7 no text here")
    kinds = {"birds.html": "text/html", "engine.txt": "text/plain", "blank.txt": "text/plain", "scan.pdf": "application/pdf", "missing.txt": "text/plain", "plan.docx": documents.WORD, "photo.jpg": "image/jpeg", "bad.jpg": "image/jpeg"}
    (store / "plan.docx").write_bytes(generators.word_file(["The harbour plan for the coming winter."], {"title": "Harbour plan", "author": "Ada", "created": "2024-01-02T03:04:05Z"}))
    (store / "photo.jpg").write_bytes(generators.jpeg_file(640, 480, generators.tiff_block({271: b"Maker\0"}, {36867: b"2024:01:02 03:04:05\0"})))
    (store / "bad.jpg").write_bytes(b"\xff\xd8\xff no image")
    messages(spark, [record("ObjectCreated:Put", f"reports/{n}", kind=k) for n, k in kinds.items()]).write.json(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing to do
        query = ingestion.start(readers.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/dead", f"{tmp_path}/ck", store=f"{tmp_path}/store")
        query.awaitTermination(120)
        assert query.exception() is None
    table = chunk_store.chunk_table(spark, f"{tmp_path}/table")
    rows = table.collect()
    assert {r.filename for r in rows} == {"birds.html", "engine.txt", "plan.docx", "photo.jpg"} and all(len(r.embedding) == 64 for r in rows)
    plan, photo = (next(r for r in rows if r.filename == n) for n in ("plan.docx", "photo.jpg"))
    assert (plan.title, plan.author, plan.page_count, plan.tags, plan.doc_created_at.year) == ("Harbour plan", "Ada", 1, ["author:Ada", "title:Harbour plan", "pages:1"], 2024)
    assert photo.chunk_text == "Image: photo.jpg (640x480 pixels, image/jpeg) Camera: Maker. Date: 2024:01:02 03:04:05."
    errors = sorted(r.key for r in spark.read.json(spark.read.option("recursiveFileLookup", "true").json(f"{tmp_path}/dead").rdd.map(lambda r: r.value)).collect())
    assert errors == ["reports/bad.jpg", "reports/missing.txt", "reports/scan.pdf"]
    found = SearchEngine.over(table).search("lighthouse keeper counted seventeen pelicans", limit=3, now=datetime(2024, 2, 1))
    hits = found.hits.collect()
    assert hits[0].filename == "birds.html" and "pelicans" in hits[0].chunk_text and found.total.first().total >= 1
    # a shorter text leaves no old chunk behind, a blank one none at all
    (store / "engine.txt").write_text("Gearbox oil is changed every ninety days.")
    (store / "birds.html").write_text("<p> </p>")
    ingestion.apply_batch(messages(spark, [record("ObjectCreated:Put", f"reports/{n}", kind=kinds[n]) for n in ("engine.txt", "birds.html")], 10), f"{tmp_path}/table", f"{tmp_path}/dead", store=f"{tmp_path}/store")
    left = chunk_store.chunk_table(spark, f"{tmp_path}/table").where("filename IN ('engine.txt', 'birds.html')")
    assert [(r.filename, r.chunk_total) for r in left.collect()] == [("engine.txt", 1)]


def test_retries_wait_and_end(spark, tmp_path):
    """A payload that always fails is resent after 60, 300 and 900 seconds and then kept as permanent."""
    payload = record("ObjectCreated:Put", "gone.txt", kind="text/plain")
    text = lambda where: spark.read.option("recursiveFileLookup", "true").schema(readers.MESSAGE + ", retry_count int").json(f"{tmp_path}/{where}")
    sent = messages(spark, [payload])
    for count, wait in ((0, 60), (1, 300), (2, 900)):
        ingestion.apply_batch(sent, f"{tmp_path}/table", f"{tmp_path}/dead{count}", store=f"{tmp_path}/store", batch=("ingest", 0))
        ingestion.apply_batch(sent, f"{tmp_path}/table", f"{tmp_path}/dead{count}", store=f"{tmp_path}/store", batch=("ingest", 0))
        letters = text(f"dead{count}").select("value")
        assert letters.count() == 1
        failed = dead_letters.transition(letters).select(F.col("letter.failed_at").cast("timestamp").alias("t"), "retry_count").first()
        assert failed.retry_count == count
        late = lambda s: failed.t.replace(tzinfo=None) + timedelta(seconds=s)  # noqa: B023, E731
        ingestion.retry_batch(letters, f"{tmp_path}/early{count}", f"{tmp_path}/back{count}", f"{tmp_path}/never", now=late(wait - 1))
        assert text(f"early{count}").count() == 0 and [r.value for r in text(f"back{count}").collect()] == [r.value for r in letters.collect()]
        ingestion.retry_batch(letters, f"{tmp_path}/main{count}", f"{tmp_path}/dead{count}", f"{tmp_path}/log", now=late(wait))
        sent = text(f"main{count}")
        assert [(r.value, r.retry_count) for r in sent.collect()] == [(payload, count + 1)]
    ingestion.apply_batch(sent, f"{tmp_path}/table", f"{tmp_path}/dead3", store=f"{tmp_path}/store")
    ingestion.retry_batch(text("dead3").select("value"), f"{tmp_path}/main3", f"{tmp_path}/dead3", f"{tmp_path}/log", now=datetime(2099, 1, 1))
    assert text("main3").count() == 0 and [r.retry_count for r in spark.read.json(text("log").rdd.map(lambda r: r.value)).collect()] == [3]


def test_upsert_takes_one_row_of_a_key_and_versions_survive(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x")], "_id string, size_bytes long, author string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, None), ("b", 1, "z"), (None, 9, "n")], "_id string, size_bytes long, author string")
    assert sorted(map(tuple, ingest.upsert(old, new).collect())) == [("a", 3, "x"), ("b", 1, "z")]
    assert sorted(map(tuple, ingest.upsert(old, new, order=-F.col("size_bytes")).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    path = f"{tmp_path}/t"
    for n in range(4):
        readers.swap_in(spark.range(n), path)
    (tmp_path / "t" / "v-9").mkdir()  # a write that was never committed
    assert readers.versions(spark, path) == [2, 3] and spark.read.parquet(f"{path}/v-3").count() == 3


def test_letters_of_two_checkpoints_over_one_folder_all_stay(spark, tmp_path):
    """Batch numbers start at 0 with each checkpoint; no letter is taken for another stream's."""
    for run in (1, 2):
        messages(spark, [f"{{broken {run}"]).write.json(f"{tmp_path}/in{run}")
        for _ in range(2):  # the second start has nothing to do
            query = ingestion.start(readers.file_stream(spark, f"{tmp_path}/in{run}"), f"{tmp_path}/table", f"{tmp_path}/dead", f"{tmp_path}/ck{run}")
            query.awaitTermination(120)
            assert query.exception() is None
    found = spark.read.option("recursiveFileLookup", "true").schema("value string").json(f"{tmp_path}/dead")
    assert sorted(r.value[:30] for r in found.collect()) == ['{"original_payload":"{broken 1', '{"original_payload":"{broken 2']


def test_embedding_is_the_same_in_any_batch(spark):
    texts = ["b a b", "", None, "é x1_ x1_", "a b b " * 500]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    together = {r.i: r.e for r in frame.coalesce(1).select("i", embed(F.col("t")).alias("e")).collect()}
    alone = {r.i: r.e for r in frame.repartition(5).select("i", embed(F.col("t")).alias("e")).collect()}
    assert together == alone and together[1] == together[2] == [0.0] * 64
    assert together[0] == pytest.approx(together[4], abs=0)


def test_cache_is_bounded_and_counts_end():
    now = [0.0]
    store = cache.ResultCache(CachePolicy(), lambda: now[0], most=3)
    for k in "abc":
        store.set(k, {"x": k})
    assert store.get("a")["_cache"]["hit_count"] == 1
    store.set("d", {})
    assert store.get("b") is None and store.get("a") and set(store.entries) == {"a", "c", "d"}  # b was used least recently
    now[0] = 2 * 1800 + 1
    store.set("a", {})
    assert store.get("a")["_cache"]["hit_count"] == 1 and len(store.hits) <= 3


def test_reports_dumps_and_uploads(spark, tmp_path):
    cases = spark.createDataFrame([(1, 10.0, True, 512), (2, 6000.0, False, 384)], "case_id int, latency_ms double, passed boolean, dims int")
    report.write_report(cases, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/summary").first().slowest == 2
    assert "| over_threshold | 1 |" in [r.value for r in spark.read.text(f"{tmp_path}/report/markdown").collect()]
    assert spark.read.json(f"{tmp_path}/report/cases").where("NOT passed").first().case_id == 2
    objects = spark.createDataFrame([("u", "a b/ü.txt", b"An uploaded text of some length.", "text/plain"), ("v", "x.txt", b"Another uploaded text.", "text/plain")], "bucket string, key string, content binary, content_type string")
    sent = readers.put_objects(objects, f"{tmp_path}/store").collect()
    messages(spark, [r.value for r in sent]).write.json(f"{tmp_path}/in")
    ingestion.start(readers.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/dead", f"{tmp_path}/ck", store=f"{tmp_path}/store").awaitTermination(120)
    table = chunk_store.chunk_table(spark, f"{tmp_path}/table")
    assert sorted((r.object_key, r.chunk_text) for r in table.collect()) == [("u/a b/ü.txt", "An uploaded text of some length."), ("v/x.txt", "Another uploaded text.")]
    report.dump(table, f"{tmp_path}/dump")
    assert sorted(r.bucket for r in spark.read.json(f"{tmp_path}/dump").collect()) == ["u", "v"]
