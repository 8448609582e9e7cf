"""One query per operator over the fixture tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.config import CachePolicy, IngestConfig, SearchConfig
from siftline.functions import text as fx
from siftline.operators import cache, chunking, corpus as fixture, dead_letters, documents, exif, images, ingest, parse, predicates, quality, report, results, retrieve, suggest
from siftline.operators.inverted import InvertedIndex
from siftline.operators.vector_index import VectorIndex
from siftline.sources import generators
from siftline.sources.chunk_store import ChunkStore
from siftline.sources.readers import shared_folder, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = datetime(2024, 3, 1)
TERMS = ["licensed", "the", "erhation"]
ASKED = [
    "show me pdf files about fire safety from last week", "images bigger than 2.5MB", "Documents from january 5th, 2024", "find spreadsheets larger than 10 KB and smaller than 3 GB", "budget reports.xlsx yesterday",
    "all videos in march", "get us the quarterly presentation slides from last month", "photos < 500kb today", "what is the capacity plan for sept 5", "zips and rars", "Please list archives, songs and word files last year", "december 31 2023 audio.mp3", "", "   ", "the a an",
]
LITERALS = ["10KB", " 2.5 mb", "1GB", "0.5tb", "512", "12.5", "abc", "", "7 PB", "3kb "]


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def _pick(values: list[str], key: str, duck: bool = False) -> str:
    """SQL for the value of a row: the list's element at key modulo its length."""
    found = ", ".join(quote(v) for v in values)
    return f"([{found}])[CAST({key} % {len(values)} AS INTEGER) + 1]" if duck else f"element_at(array({found}), CAST({key} % {len(values)} AS INTEGER) + 1)"


def _asked(duck: bool = False) -> str:
    """SQL of a question for each part: the patterns of ASKED with the part's size, file type and day in them."""
    text = _pick(ASKED, "p_partkey", duck)
    for old, new in (("2.5MB", "CAST(p_size AS STRING) || '.5MB'"), (" pdf", f"' ' || {_pick(fixture.EXTENSIONS, 'p_size', duck)}"), ("5th", "CAST(1 + p_partkey % 28 AS STRING) || 'th'"), ("budget", "p_brand")):
        text = f"replace({text}, {quote(old)}, {new})"
    return text


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """i, query: a question for each part."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.expr(_asked()).alias("query"))


def rows(spark: SparkSession, values: list, column: str = "query") -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} string")


def literal_rows(values: list, column: str = "query") -> str:
    return "(VALUES " + ", ".join(f"({i}, {quote(v)})" for i, v in enumerate(values)) + f") AS t(i, {column})"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CASES = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in fixture.MIME.items())
EXT = "[" + ", ".join(f"'{e}'" for e in fixture.EXTENSIONS) + "]"
CORPUS = f"""
a AS (SELECT *, ({EXT})[CAST(doc_id % 8 AS INTEGER) + 1] AS extension FROM documents),
b AS (SELECT *, CASE extension {CASES} END AS mime_type, 'doc_' || (doc_id % 160) || '.' || extension AS filename FROM a),
corpus AS (SELECT doc_id, replace(source || '/' || doc_id || '/' || filename, '/', '__') || '#0' AS _id, source || '/' || doc_id || '/' || filename AS object_key, source AS bucket, filename, extension, mime_type,
  'user' || (doc_id % 7) AS owner, n_chars * 1024 AS size_bytes, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS uploaded_at, lang AS language, text AS chunk_text FROM b)"""
WORDS = r"list_filter(string_split_regex(lower(%s), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


def chunks(spark: SparkSession, sf: str, tags: bool = False) -> DataFrame:
    return fixture.corpus(spark, sf, tags)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- chunk table, events, keys ----------------------------------------------------------------------


@query("corpus_view", f"WITH {CORPUS} SELECT doc_id, _id, object_key, bucket, filename, extension, mime_type, owner, size_bytes, epoch_us(uploaded_at) AS uploaded_us, language, length(chunk_text) AS chars FROM corpus")
def corpus_view(spark, sf):
    return chunks(spark, sf).select("doc_id", "_id", "object_key", "bucket", "filename", "extension", "mime_type", "owner", "size_bytes", F.unix_micros("uploaded_at").alias("uploaded_us"), "language", F.length("chunk_text").cast("long").alias("chars"))


EVENT_NAME = "CASE event_type WHEN 'signup' THEN 's3:ObjectCreated:Put' WHEN 'purchase' THEN 's3:ObjectCreated:Post' WHEN 'click' THEN 's3:ObjectRemoved:Delete' ELSE 's3:ObjectAccessed:Get' END"


@query("event_route", f"WITH e AS (SELECT {EVENT_NAME} AS n FROM events) SELECT CASE WHEN n LIKE 's3:ObjectRemoved%' THEN 'delete' WHEN n LIKE 's3:ObjectCreated%' THEN 'ingest' ELSE 'skip' END AS action, count(*) AS n FROM e GROUP BY 1")
def event_route(spark, sf):
    return table(spark, sf, "events").select(ingest.route(F.expr(EVENT_NAME)).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def messages(spark, sf) -> DataFrame:
    """Object events in JSON; every 50th is broken, every 7th has two records."""
    record = "named_struct('eventName', {0}, 's3', named_struct('bucket', named_struct('name', concat('b', user_id % 5)), 'object', named_struct('key', concat('in+box/file%20', event_id, '.PDF'), 'size', cast(event_id * 1000000 as bigint), 'contentType', 'application/pdf')))".format(EVENT_NAME)
    body = f"to_json(named_struct('Records', CASE WHEN event_id % 7 = 0 THEN array({record}, {record}) ELSE array({record}) END))"
    return table(spark, sf, "events").select("event_id", F.col("ts").alias("timestamp"), F.expr(f"CASE WHEN event_id % 50 = 0 THEN '{{broken' ELSE {body} END").alias("value"))


@query("event_explode_json", f"""SELECT event_id, 'b' || (user_id % 5) AS bucket, 'in box/file ' || event_id || '.PDF' AS key, 'pdf' AS extension, CASE WHEN event_id * 1000000 > 104857600 THEN 'too_large' ELSE 'ok' END AS branch, {EVENT_NAME} AS event_name
FROM events, range(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END) WHERE event_id % 50 <> 0""")
def event_explode_json(spark, sf):
    found = ingest.derive(ingest.explode_records(ingest.decode_events(messages(spark, sf))))
    return found.select("event_id", "bucket", "key", "extension", ingest.size_branch(F.col("size")).alias("branch"), "event_name")


@query("event_decode_errors", "SELECT event_id FROM events WHERE event_id % 50 = 0")
def event_decode_errors(spark, sf):
    return ingest.decode_events(messages(spark, sf)).where("NOT ok").select("event_id")


@query("url_decode_keys", "SELECT page_id, url_decode(replace(url, '+', ' ')) AS key FROM pages")
def url_decode_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", ingest.decode_key(F.col("url")).alias("key"))


@query("filename_extension", """SELECT page_id, filename, CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) ELSE '' END AS extension FROM (SELECT page_id, string_split(url, '/')[-1] AS filename FROM pages)""")
def filename_extension(spark, sf):
    name = F.element_at(F.split("url", "/"), -1)
    return table(spark, sf, "pages").select("page_id", name.alias("filename"), ingest.extension_of(name).alias("extension"))


META = "map('Content-Language', CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, 'language', CASE WHEN doc_id % 6 = 0 THEN 'xx' END, 'dc:creator', CASE WHEN doc_id % 2 = 0 THEN concat('Author ', doc_id % 10) ELSE '' END, 'Author', CASE WHEN doc_id % 5 = 0 THEN 'Backup' END, 'dc:title', CASE WHEN doc_id % 4 = 0 THEN concat('Title ', doc_id) END, 'meta:page-count', CASE doc_id % 4 WHEN 0 THEN '12' WHEN 1 THEN 'abc' WHEN 2 THEN '' ELSE '0' END)"


@query("metadata_coalesce_tags", f"""WITH {CORPUS}, m AS (SELECT doc_id, filename,
 coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE language END, ''), CASE WHEN doc_id % 6 = 0 THEN 'xx' END, 'en') AS language,
 coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN 'Author ' || (doc_id % 10) ELSE '' END, ''), CASE WHEN doc_id % 5 = 0 THEN 'Backup' END, '') AS author,
 coalesce(CASE WHEN doc_id % 4 = 0 THEN 'Title ' || doc_id END, filename) AS title, CASE WHEN doc_id % 4 = 0 THEN 12 ELSE 0 END AS page_count FROM corpus)
SELECT doc_id, language, author, title, page_count, array_to_string(list_filter([CASE WHEN author <> '' THEN 'author:' || author END, CASE WHEN title <> filename THEN 'title:' || title END, CASE WHEN page_count <> 0 THEN 'pages:' || page_count END], lambda x: x IS NOT NULL), '|') AS tags FROM m""")
def metadata_coalesce_tags(spark, sf):
    base = chunks(spark, sf).withColumn("lang", F.col("language")).drop("language")
    found = base.withColumn("meta", F.expr(META)).withColumns(ingest.metadata_columns(F.col("meta"), F.col("filename")))
    return found.select("doc_id", "language", "author", "title", "page_count", F.array_join(ingest.tags(F.col("author"), F.col("title"), F.col("page_count"), F.col("filename")), "|").alias("tags"))


@query("size_guard_split", "SELECT CASE WHEN n_chars * 65536 > 104857600 THEN 'too_large' ELSE 'ok' END AS branch, count(*) AS n FROM documents GROUP BY 1")
def size_guard_split(spark, sf):
    return table(spark, sf, "documents").select(ingest.size_branch(F.col("n_chars") * 65536).alias("branch")).groupBy("branch").agg(F.count("*").alias("n"))


@query("size_literal_parse", f"""WITH t AS (SELECT i, upper(trim(literal)) AS s FROM (SELECT p_partkey AS i, replace({_pick(LITERALS, 'p_partkey', True)}, '10', CAST(p_size AS STRING)) AS literal FROM part)), p AS (SELECT i, regexp_extract(s, '^(\\d+(?:\\.\\d+)?)\\s*(KB|MB|GB|TB)?$', 1) AS n, regexp_extract(s, '^(\\d+(?:\\.\\d+)?)\\s*(KB|MB|GB|TB)?$', 2) AS u FROM t)
SELECT i, CASE WHEN n <> '' AND NOT (u = '' AND contains(n, '.')) THEN CAST(floor(CAST(n AS DOUBLE) * CASE u WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 WHEN 'TB' THEN 1099511627776 ELSE 1 END) AS BIGINT) END AS bytes FROM p""")
def size_literal_parse(spark, sf):
    literal = F.expr(f"replace({_pick(LITERALS, 'p_partkey')}, '10', CAST(p_size AS STRING))")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("i"), fx.size_bytes(literal).alias("bytes"))


# ---- chunking and extraction -----------------------------------------------------------------------


@query("chunk_fixed_stride", """SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 540 AS INTEGER) AS start_char, md5(substring(text, CAST(k * 540 + 1 AS BIGINT), 600)) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text), 1) / 540.0) AS BIGINT))) AS k FROM documents) WHERE length(substring(text, CAST(k * 540 + 1 AS BIGINT), 600)) >= 20""")
def chunk_fixed_stride(spark, sf):
    return chunking.fixed_stride(table(spark, sf, "documents"), "text").select("doc_id", "chunk_index", "start_char", F.md5(F.encode("chunk_text", "UTF-8")).alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return chunking.explode_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("html_to_text", r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM t""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.encode(ingest.html_text(F.col("html")), "UTF-8")).alias("digest"))


@query("extract_result", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unsupported type' END AS error, page_id % 3 <> 0 AS success FROM pages")
def extract_result(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html")
    return table(spark, sf, "pages").select("page_id", ingest.extract(F.encode("html", "UTF-8"), kind).alias("r")).select("page_id", "r.error", "r.success")


CONTROL = r"[\x00-\x08\x0b-\x1f]"
KINDS = [documents.WORD, documents.SLIDES, documents.SHEETS, documents.PDF]


def made_files(spark, sf) -> DataFrame:
    """Each document as an office or PDF file with properties."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", CONTROL, " ").alias("text"), kind.alias("mime"), F.concat(F.lit("Title é "), "doc_id").alias("title"), F.concat(F.lit("Author "), F.col("doc_id") % 10).alias("author"), F.lit("").alias("created"), F.col("lang").alias("language")
    )
    return generators.office_files(rows).select("doc_id", "mime", "content")


@query("extract_office_pdf", f"""WITH d AS (SELECT doc_id, lang, regexp_replace(text, {quote(CONTROL)}, ' ', 'g') AS t FROM documents), l AS (SELECT *, len(string_split(t, chr(10))) AS n FROM d)
SELECT doc_id, md5(trim(t)) AS digest, CASE WHEN doc_id % 4 = 3 THEN 'en' ELSE lang END AS language, 'Author ' || (doc_id % 10) AS author, 'Title é ' || doc_id AS title,
  CAST(CASE doc_id % 4 WHEN 0 THEN 1 + n // 40 WHEN 2 THEN 0 ELSE ceil(n / 40.0) END AS INTEGER) AS page_count FROM l""")
def extract_office_pdf(spark, sf):
    """Text and properties of files made of the documents: the round trip through four formats."""
    found = documents.extracted(made_files(spark, sf), F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("success"), F.lit("other").alias("error")))
    found = found.withColumns(ingest.metadata_columns(F.col("meta"), F.lit("f")))
    return found.select("doc_id", F.md5(F.encode("r.text", "UTF-8")).alias("digest"), "language", "author", "title", "page_count")


@query("image_exif", """SELECT event_id, CAST(100 + event_id % 900 AS INTEGER) AS width, CAST(80 + user_id % 700 AS INTEGER) AS height, CAST(1 + event_id % 8 AS INTEGER) AS orientation, 'Maker ' || (event_id % 5) AS camera_make,
  CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS capture_date, CASE WHEN event_id % 4 <> 0 THEN round((event_id % 648001 - 324000) / 3600.0, 6) END AS gps_lat,
  CASE WHEN event_id % 4 <> 0 THEN round((event_id * 7 % 1296001 - 648000) / 3600.0, 6) END AS gps_lon, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 3000 - 500 AS DOUBLE) END AS gps_alt_m FROM events""")
def image_exif(spark, sf):
    """Facts of photos made of the events, read back from their headers."""
    n, has = F.col("event_id"), F.col("event_id") % 4 != 0
    rows = table(spark, sf, "events").select(
        "event_id", (100 + n % 900).cast("int").alias("width"), (80 + F.col("user_id") % 700).cast("int").alias("height"), (1 + n % 8).cast("int").alias("orientation"), F.concat(F.lit("Maker "), n % 5).alias("make"), F.lit("M").alias("model"),
        F.when(n % 3 != 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("taken"), F.when(has, n % 648001 - 324000).alias("lat"), F.when(has, n * 7 % 1296001 - 648000).alias("lon"), F.when(has, n % 3000 - 500).alias("alt"),
    )
    found = exif.with_image_facts(generators.photos(rows).select("event_id", "content"))
    return found.select("event_id", *[F.col(f"image.{c}") for c in ("width", "height", "orientation", "camera_make", "capture_date", "gps_lat", "gps_lon", "gps_alt_m")])


HEADS = ["255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE0", "00112233", "504B0304"]


@query("mime_detection", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'text/plain' ELSE (['application/pdf', 'image/png', 'image/jpeg', 'application/octet-stream', 'application/zip'])[CAST(doc_id % 5 AS INTEGER) + 1] END AS mime FROM documents""")
def mime_detection(spark, sf):
    """Types of documents with the first bytes of other files before their text."""
    content = F.concat(F.unhex(F.expr(_pick(HEADS, "doc_id"))), F.encode("text", "UTF-8"))
    declared = F.when(F.col("doc_id") % 7 == 0, "text/plain").otherwise("application/octet-stream")
    return table(spark, sf, "documents").select("doc_id", ingest.detect_mime(content, declared).alias("mime"))


# ---- upsert and delete -------------------------------------------------------------------------------



def even_ids(spark, sf) -> tuple[DataFrame, DataFrame]:
    base = chunks(spark, sf)
    old = base.where("doc_id % 3 <> 0").select("_id", "object_key", "size_bytes", F.col("owner").alias("author"))
    new = base.where("doc_id % 2 = 0").select("_id", "object_key", (F.col("size_bytes") + 1).alias("size_bytes"), F.when(F.col("doc_id") % 4 == 0, F.lit("new")).alias("author"))
    return old, new


MERGED = f"""WITH {CORPUS} SELECT _id, object_key, CASE WHEN doc_id % 2 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 3 <> 0 THEN owner END AS author FROM corpus WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0"""


@query("upsert_merge", MERGED)
def upsert_merge(spark, sf):
    return ingest.upsert(*even_ids(spark, sf))


@query("idempotent_upsert", MERGED)
def idempotent_upsert(spark, sf):
    old, new = even_ids(spark, sf)
    return ingest.upsert(ingest.upsert(old, new), new)


@query("upsert_replace_file", f"WITH {CORPUS}, c AS (SELECT *, bucket AS file FROM corpus) SELECT _id, file FROM c WHERE bucket NOT IN ('src1', 'src2') OR doc_id % 40 < 20")
def upsert_replace_file(spark, sf):
    base = chunks(spark, sf).select("_id", F.col("bucket").alias("file"), "doc_id")
    batch = base.where("file IN ('src1', 'src2') AND doc_id % 40 < 20").drop("doc_id")
    return ingest.upsert(base.drop("doc_id"), batch, replace_file="file")


@query("delete_by_key", f"WITH {CORPUS} SELECT _id FROM corpus WHERE doc_id % 10 <> 3")
def delete_by_key(spark, sf):
    base = chunks(spark, sf)
    return ingest.delete_by_key(base.select("_id", "object_key"), base.where("doc_id % 10 = 3").select("object_key")).select("_id")


def stored(spark, sf, name: str) -> ChunkStore:
    """A chunk table of four columns, its own for each call."""
    kinds = "_id string, object_key string, size_bytes long, author string"
    return ChunkStore(spark, f"{_folder(spark, sf, name)}-{uuid.uuid4().hex}", T.StructType.fromDDL(kinds))


@query("store_upsert", MERGED)
def store_upsert(spark, sf):
    """The same merge as upsert_merge, by a base and two deltas that are merged on reading; the second delta is a repeated batch."""
    old, new = even_ids(spark, sf)
    chunk_table = stored(spark, sf, "store")
    chunk_table.commit(old, batch=("load", 0))
    chunk_table.compact()
    chunk_table.commit(new, batch=("load", 1))
    chunk_table.commit(new, batch=("load", 1))
    return chunk_table.read()


@query("store_replace_delete", f"WITH {CORPUS} SELECT _id, bucket AS object_key, CASE WHEN bucket IN ('src1', 'src2') THEN 0 ELSE size_bytes END AS size_bytes FROM corpus WHERE bucket <> 'src4' AND (bucket NOT IN ('src1', 'src2') OR doc_id % 40 < 20)")
def store_replace_delete(spark, sf):
    """Files rewritten and deleted by tombstones: a bucket of the corpus stands for a file."""
    base = chunks(spark, sf).select("_id", F.col("bucket").alias("object_key"), "size_bytes", F.col("owner").alias("author"), "doc_id")
    chunk_table = stored(spark, sf, "store")
    chunk_table.commit(base.drop("doc_id"))
    anew = base.where("object_key IN ('src1', 'src2') AND doc_id % 40 < 20").select("_id", "object_key", F.lit(0).cast("long").alias("size_bytes"))
    chunk_table.commit(anew, deleted=base.where("object_key = 'src4'").select("object_key").distinct(), replaced=anew.select("object_key").distinct())
    return chunk_table.read().select("_id", "object_key", "size_bytes")


@query("store_bulk_outcome", "SELECT coalesce(e, 'written') AS outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'no key' WHEN n_chars > 5000 THEN 'too long' END AS e FROM documents) GROUP BY 1")
def store_bulk_outcome(spark, sf):
    """Written and refused rows of one commit, counted while it is written."""
    rows_ = chunks(spark, sf).select(F.when(F.col("doc_id") % 9 != 0, F.col("_id")).alias("_id"), "object_key", "size_bytes", F.col("owner").alias("author"))
    chunk_table = stored(spark, sf, "store")
    done = chunk_table.commit(rows_, check=F.when(F.col("size_bytes") > 5000 * 1024, "too long"))
    refused = chunk_table.refused(done.version).select(F.col("_error").alias("outcome"))
    return chunk_table.read().select(F.lit("written").alias("outcome")).unionByName(refused).groupBy("outcome").agg(F.count("*").alias("n"))


@query("bulk_outcome", "SELECT count(*) FILTER (doc_id % 9 <> 0) AS success, count(*) FILTER (doc_id % 9 = 0) AS failed FROM documents")
def bulk_outcome(spark, sf):
    return ingest.bulk_outcome(chunks(spark, sf).select(F.when(F.col("doc_id") % 9 != 0, F.col("_id")).alias("_id")))


@query("point_get", f"WITH {CORPUS} SELECT doc_id, filename FROM corpus WHERE _id = 'src7__7__doc_7.png#0'")
def point_get(spark, sf):
    return chunks(spark, sf).where(F.col("_id") == "src7__7__doc_7.png#0").select("doc_id", "filename")


# ---- query parsing -------------------------------------------------------------------------------------

ASKED_ROWS = f"(SELECT p_partkey AS i, {_asked(duck=True)} AS query FROM part)"
CLEAN = f"(SELECT i, lower(trim(query)) AS q FROM {ASKED_ROWS})"


def _array(parts: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), '|')"


DATE_SQL = _array([f"CASE WHEN regexp_extract(q, {quote(parse.EXACT_DATE)}, 1) <> '' THEN 'exact_date:' || regexp_extract(q, {quote(parse.EXACT_DATE)}, 1) || '_' || regexp_extract(q, {quote(parse.EXACT_DATE)}, 2) || '_' || coalesce(nullif(regexp_extract(q, {quote(parse.EXACT_DATE)}, 3), ''), '2024') END"] + [f"CASE WHEN regexp_matches(q, {quote(p)}) THEN 'date:{n}' END" for p, n in parse.DATES] + [f"CASE WHEN regexp_extract(q, {quote(p)}, 1) <> '' THEN 'month:' || regexp_extract(q, {quote(p)}, 1) END" for p in parse.MONTHS])
SIZE_SQL = _array([f"CASE WHEN regexp_matches(q, {quote('(?i)' + p)}) THEN 'size:{w}:' || regexp_extract(q, {quote('(?i)' + p)}, 1) || upper(regexp_extract(q, {quote('(?i)' + p)}, 2)) END" for p, w in parse.SIZES])
TYPE_SQL = _array([f"CASE WHEN regexp_matches(q, {quote(p)}) THEN 'type:{n}' END" for p, n in parse.TYPES])
EXT_SQL = f"array_to_string(list_transform(list_concat(regexp_extract_all(q, {quote(parse.KNOWN)}, 1), regexp_extract_all(q, {quote(parse.DOTTED)}, 1)), lambda x: 'extension:' || x), '|')"


def _parsed(expression: Callable) -> Callable:
    return lambda spark, sf: asked(spark, sf).withColumn("q", F.lower(F.trim("query"))).select("i", F.array_join(expression(F.col("q")), "|").alias("found"))


query("parse_dates", f"SELECT i, {DATE_SQL} AS found FROM {CLEAN}")(_parsed(lambda q: parse.date_filters(q, 2024)))
query("parse_sizes", f"SELECT i, {SIZE_SQL} AS found FROM {CLEAN}")(_parsed(parse.size_filters))
query("parse_types", f"SELECT i, {TYPE_SQL} AS found FROM {CLEAN}")(_parsed(parse.type_filters))
query("parse_extensions", f"SELECT i, {EXT_SQL} AS found FROM {CLEAN}")(_parsed(parse.extension_filters))


def _intent_sql() -> str:
    text = "q"
    for p in [parse.EXACT_DATE, *[p for p, _ in parse.DATES], *parse.MONTHS, *[p for p, _ in parse.SIZES], *[p for p, _ in parse.TYPES], parse.KNOWN, parse.DOTTED]:
        text = f"regexp_replace({text}, {quote('(?i)' + p)}, ' ', 'g')"
    text = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    for p in parse.FILLER:
        text = f"regexp_replace({text}, {quote('(?i)' + p)}, ' ', 'g')"
    stop = "[" + ", ".join(quote(w) for w in parse.STOPWORDS) + "]"
    return f"list_filter(string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({stop}, lower(w)))"


@query("parse_keywords", f"SELECT i, array_to_string(w, ' ') AS intent_text, array_to_string(list_filter(w, lambda x: length(x) > 2), '|') AS keywords FROM (SELECT i, {_intent_sql()} AS w FROM {CLEAN})")
def parse_keywords(spark, sf):
    return parse.parse(asked(spark, sf), 2024).select("i", "intent_text", F.array_join("keywords", "|").alias("keywords"))


RANGES = {"last_week": 7, "last_month": 30, "last_year": 365, "yesterday": 1, "today": 1, "other": 7}


@query("date_ranges", " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n, epoch_us(min(ts)) AS first_us FROM events WHERE ts >= TIMESTAMP '2024-01-20' - to_days({d}) AND ts <= TIMESTAMP '2024-01-20'" for k, d in RANGES.items()))
def date_ranges(spark, sf):
    """Events in the range that each phrase means on one day."""
    events, day = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts")), datetime(2024, 1, 20)
    inside = lambda k: (F.col("ts") >= F.lit(predicates.date_range(k, day)[0])) & (F.col("ts") <= F.lit(predicates.date_range(k, day)[1]))
    keys = F.array(*[F.when(inside(k), F.lit(k)) for k in RANGES])
    found = events.select("ts", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"))
    return found


# ---- filters -----------------------------------------------------------------------------------------------

FILTERS = {
    "filter_extension": (["extension:pdf"], "extension = 'pdf'"),
    "filter_type_document": (["type:document"], "mime_type LIKE 'application/%'"),
    "filter_type_presentation": (["type:presentation"], "extension IN ('ppt', 'pptx') OR mime_type LIKE 'application/vnd.ms-powerpoint%'"),
    "filter_type_spreadsheet": (["type:spreadsheet"], "extension IN ('xls', 'xlsx', 'csv') OR mime_type LIKE 'application/vnd.ms-excel%'"),
    "filter_type_image": (["type:image"], "mime_type LIKE 'image/%'"),
    "filter_type_pdf": (["type:pdf"], "extension = 'pdf'"),
    "filter_type_other": (["type:text"], "mime_type LIKE 'text%'"),
    "filter_type_archive": (["type:archive"], "false"),
    "filter_size_range": (["size:size_gt:1MB", "size:size_lt:5.5MB"], "size_bytes > 1048576 AND size_bytes < 5767168"),
    "filter_size_malformed": (["size:size_gt:lots"], "true"),
    "filter_date_range": (["date:last_week"], "uploaded_at BETWEEN TIMESTAMP '2023-12-28' AND TIMESTAMP '2024-01-04'", datetime(2024, 1, 4)),
    "filter_exact_date": (["exact_date:jan_5_2024"], "uploaded_at >= TIMESTAMP '2024-01-04 18:30:00' AND uploaded_at < TIMESTAMP '2024-01-05 18:30:00'"),
    "filter_match_none": (["exact_date:feb_31_2024"], "false"),
    "filter_month_ignored": (["month:march"], "true"),
    "filter_and_conflict": (["extension:pdf", "extension:docx"], "false"),
}


def _filtered(filters: list[str], now: datetime = NOW) -> Callable:
    return lambda spark, sf: chunks(spark, sf).where(predicates.all_of(filters, now, "+05:30")).select("doc_id", "filename")


for _name, (_filters, _where, *_now) in FILTERS.items():
    query(_name, f"WITH {CORPUS} SELECT doc_id, filename FROM corpus WHERE {_where}")(_filtered(_filters, *_now))

LABELS = "l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)"


@query("filter_tags_any", f"WITH {LABELS} SELECT d.doc_id FROM documents d JOIN l USING (doc_id) WHERE quality = 0 OR toxic = 1")
def filter_tags_any(spark, sf):
    return chunks(spark, sf, tags=True).where(predicates.builder_filter(tags=["quality:0", "toxic:1"])).select("doc_id")


@query("filter_bucket_owner", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE bucket = 'src3' AND owner = 'user2' AND extension = 'pptx'")
def filter_bucket_owner(spark, sf):
    return chunks(spark, sf).where(predicates.builder_filter(extension=".PPTX", bucket="src3", owner="user2")).select("doc_id")


@query("filter_date_from_to", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE uploaded_at >= TIMESTAMP '2024-01-03' AND uploaded_at <= TIMESTAMP '2024-01-09'")
def filter_date_from_to(spark, sf):
    return chunks(spark, sf).where(predicates.builder_filter(date_from="2024-01-03", date_to="2024-01-09")).select("doc_id")


@query("filter_allowed_buckets", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE bucket IN ('src1', 'src4')")
def filter_allowed_buckets(spark, sf):
    return chunks(spark, sf).where(predicates.builder_filter(buckets=["src1", "src4"])).select("doc_id")


# ---- index and retrieval -----------------------------------------------------------------------------------

TOKENS = f"t AS (SELECT doc_id, {WORDS % 'text'} AS terms FROM documents)"


@query("postings_tf", f"WITH {TOKENS} SELECT term, doc_id, CAST(len(any_value(terms)) AS INTEGER) AS dl, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM t) GROUP BY term, doc_id")
def postings_tf(spark, sf):
    return retrieve.postings(table(spark, sf, "documents"), "text").select("term", "doc_id", "dl", "tf")


@query("corpus_stats", f"WITH {TOKENS} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avgdl FROM t")
def corpus_stats(spark, sf):
    return table(spark, sf, "documents").select(F.size(fx.analyze(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query("idf_table", f"WITH {TOKENS}, n AS (SELECT count(*) AS n FROM t) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY term), n")
def idf_table(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(fx.analyze(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.round(F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6))


def _bm25_sql(terms: list[str], fields: dict[str, float], where: str = "true") -> str:
    arrays = {"chunk_text": WORDS % "chunk_text", "filename": WORDS % "filename"}
    lists = ", ".join(f"{arrays.get(f, f'[lower({f})]')} AS {f}_t" for f in fields)
    stats = ", ".join([f"avg(len({f}_t)) AS {f}_a" for f in fields] + [f"CAST(count(*) FILTER (list_contains({f}_t, '{t}')) AS DOUBLE) AS {f}_{i}" for f in fields for i, t in enumerate(terms)])
    part = lambda f, i, t: f"ln(1 + (n - {f}_{i} + 0.5) / ({f}_{i} + 0.5)) * 2.2 * len(list_filter({f}_t, lambda x: x = '{t}')) / (len(list_filter({f}_t, lambda x: x = '{t}')) + 1.2 * (0.25 + 0.75 * len({f}_t) / {f}_a))"
    scores = ", ".join(f"{b} * ({' + '.join(part(f, i, t) for i, t in enumerate(terms))})" for f, b in fields.items())
    return f"c AS (SELECT *, {lists} FROM corpus), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, {stats} FROM c), scored AS (SELECT doc_id, filename, bucket, greatest({scores}) AS bm25 FROM c, s WHERE {where})"


ONE = {"chunk_text": 1.0}


def _folder(spark, sf, name: str) -> str:
    """A place in the shared folder for what this application derives from the tables of sf."""
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode()).hexdigest()[:16]}"


def index(spark, sf) -> InvertedIndex:
    """The inverted index of the chunks: written by the first query that asks, read by all."""
    found = InvertedIndex(spark, _folder(spark, sf, "index"))
    if not found.segments():
        found.add(chunks(spark, sf), list(retrieve.LIVE_FIELDS))
    return found


def keyword_hits(spark, sf, terms: list[str], fields: dict[str, float], k: int, allowed=None) -> DataFrame:
    """doc_id, bm25 of the k best."""
    return index(spark, sf).search(terms, fields, k, allowed).withColumnRenamed("key", "doc_id")


@query("bm25_topk", f"WITH {CORPUS}, {_bm25_sql(TERMS, ONE)} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored WHERE bm25 > 0 ORDER BY round(bm25, 9) DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf):
    return keyword_hits(spark, sf, TERMS, ONE, 50).select("doc_id", F.round("bm25", 6).alias("bm25"))


MULTI = [*TERMS, "doc_17", "src3", "pdf"]


@query("bm25_multi_field", f"WITH {CORPUS}, {_bm25_sql(MULTI, {f: b for f, b in retrieve.LIVE_FIELDS.items()})} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored WHERE bm25 > 0 ORDER BY round(bm25, 9) DESC, doc_id LIMIT 50")
def bm25_multi_field(spark, sf):
    return keyword_hits(spark, sf, MULTI, retrieve.LIVE_FIELDS, 50).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("bm25_filtered", f"WITH {CORPUS}, {_bm25_sql(TERMS, ONE, where=chr(39).join(['extension = ', 'pdf', '']))} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored WHERE bm25 > 0 ORDER BY round(bm25, 9) DESC, doc_id LIMIT 20")
def bm25_filtered(spark, sf):
    allowed = chunks(spark, sf).where("extension = 'pdf'").select("doc_id")
    return keyword_hits(spark, sf, TERMS, ONE, 20, allowed).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("bm25_scan", f"WITH {CORPUS}, {_bm25_sql(TERMS, ONE)} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored WHERE bm25 > 0")
def bm25_scan(spark, sf):
    """Every match, scored from the texts: what answers where no index is at hand."""
    return retrieve.keyword_search(chunks(spark, sf), TERMS, ONE).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("bm25_matches", f"WITH {CORPUS}, {_bm25_sql(TERMS, ONE)} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored WHERE bm25 > 0")
def bm25_matches(spark, sf):
    """Every match, scored from the index."""
    return index(spark, sf).matches(TERMS, ONE).select(F.col("key").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query("match_all_fallback", f"WITH {CORPUS} SELECT doc_id, 1.0::DOUBLE AS bm25 FROM corpus WHERE extension = 'csv'")
def match_all_fallback(spark, sf):
    return retrieve.keyword_search(chunks(spark, sf), [], ONE, F.col("extension") == "csv").select("doc_id", "bm25")


def query_vector(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
COS = f"{DOT.format('v.embedding', 'q.embedding')} / (sqrt({DOT.format('v.embedding', 'v.embedding')}) * sqrt({DOT.format('q.embedding', 'q.embedding')}))"
KNN = f"k AS (SELECT v.vec_id, v.label, {COS} AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query("knn_topk", f"WITH {KNN} SELECT vec_id, round(1 / (2 - cosine), 6) AS knn FROM k ORDER BY round(1 / (2 - cosine), 9) DESC, vec_id LIMIT 50")
def knn_topk(spark, sf):
    return retrieve.knn_search(table(spark, sf, "embeddings"), query_vector(spark, sf), 50).select("vec_id", F.round("knn", 6).alias("knn"))


@query("knn_filtered_topk", f"WITH {KNN} SELECT vec_id, round(1 / (2 - cosine), 6) AS knn FROM k WHERE label = 3 ORDER BY round(1 / (2 - cosine), 9) DESC, vec_id LIMIT 10")
def knn_filtered_topk(spark, sf):
    return retrieve.knn_search(table(spark, sf, "embeddings"), query_vector(spark, sf), 10, where=F.col("label") == 3).select("vec_id", F.round("knn", 6).alias("knn"))


#: Part of the lists that a query probes. The table's vectors are spread evenly over the sphere, so neighbours lie in many lists; where vectors cluster a tenth suffices.
ANN_PROBE = 0.8


def vector_index(spark, sf) -> VectorIndex:
    """The vector index of the embeddings: written by the first query that asks."""
    found = VectorIndex(spark, _folder(spark, sf, "vectors"))
    if not found.exists():
        found.build(table(spark, sf, "embeddings"))
    return found


@query("ann_topk")
def ann_topk(spark, sf):
    """About the 50 nearest of every 50th vector, from the index; tests hold it to a recall of 0.9 against brute force."""
    found = vector_index(spark, sf)
    probe = max(1, round(ANN_PROBE * len(found.model().centroids)))
    near = found.search_all(table(spark, sf, "embeddings").where("vec_id % 50 = 0"), 50, probe)
    return near.select("query_id", "rank", F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@query("cosine_similarity", f"WITH {KNN} SELECT vec_id, round(cosine, 6) AS cosine FROM k")
def cosine_similarity(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(fx.cosine(F.col("embedding"), fx.vector(query_vector(spark, sf))), 6).alias("cosine"))


@query("l2_normalise", f"SELECT vec_id, round(embedding[1] / sqrt({DOT.format('embedding', 'embedding')}), 6) AS first, round(1.0::DOUBLE, 6) AS length FROM embeddings")
def l2_normalise(spark, sf):
    unit = fx.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(fx.norm(F.col("u")), 6).alias("length"))


@query("zero_vector_guard", "SELECT vec_id, 0.0::DOUBLE AS cosine FROM embeddings")
def zero_vector_guard(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fx.cosine(F.col("embedding"), fx.vector([0.0] * 64)).alias("cosine"))


ARMS = f"""{CORPUS}, {_bm25_sql(TERMS, ONE)}, {KNN},
kt AS (SELECT vec_id AS doc_id, 1 / (2 - cosine) AS s FROM k ORDER BY round(1 / (2 - cosine), 9) DESC, vec_id LIMIT 200),
bt AS (SELECT doc_id, bm25 AS s FROM scored WHERE bm25 > 0 ORDER BY round(bm25, 9) DESC, doc_id LIMIT 200),
kn AS (SELECT doc_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE greatest((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 0.001) END AS knn_norm FROM kt),
bn AS (SELECT doc_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE greatest((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 0.001) END AS bm25_norm FROM bt),
f AS (SELECT doc_id, knn_norm, bm25_norm, round(0.6 * coalesce(knn_norm, 0) + 0.4 * coalesce(bm25_norm, 0), 4) AS combined FROM kn FULL JOIN bn USING (doc_id))"""


def fused(spark, sf) -> DataFrame:
    near = retrieve.knn_search(table(spark, sf, "embeddings"), query_vector(spark, sf), 200).withColumnRenamed("vec_id", "doc_id")
    words = keyword_hits(spark, sf, TERMS, ONE, 200)
    return retrieve.fuse(near, words, "doc_id")


@query("minmax_normalise", f"WITH {ARMS} SELECT doc_id, round(bm25_norm, 6) AS bm25_norm FROM bn")
def minmax_normalise(spark, sf):
    words = keyword_hits(spark, sf, TERMS, ONE, 200)
    return words.select("doc_id", F.round(retrieve.min_max("bm25"), 6).alias("bm25_norm"))


@query("hybrid_fusion", f"WITH {ARMS} SELECT doc_id, round(knn_norm, 6) AS knn_norm, round(bm25_norm, 6) AS bm25_norm, combined FROM f")
def hybrid_fusion(spark, sf):
    return fused(spark, sf).select("doc_id", F.round("knn_norm", 6).alias("knn_norm"), F.round("bm25_norm", 6).alias("bm25_norm"), "combined")


@query("hybrid_threshold", f"WITH {ARMS} SELECT doc_id, combined FROM f WHERE combined >= 0.45")
def hybrid_threshold(spark, sf):
    return fused(spark, sf).where(F.col("combined") >= SearchConfig().threshold).select("doc_id", "combined")


@query("hybrid_search_live", f"WITH {ARMS}, h AS (SELECT doc_id, filename, bucket, combined, row_number() OVER (PARTITION BY filename ORDER BY combined DESC, doc_id) AS n FROM f JOIN corpus USING (doc_id) WHERE combined >= 0.45) SELECT doc_id, filename, bucket, combined FROM h WHERE n = 1 ORDER BY combined DESC, bucket, filename LIMIT 10")
def hybrid_search_live(spark, sf):
    few = fused(spark, sf).where(F.col("combined") >= SearchConfig().threshold)
    hits = results.worker_dedup(chunks(spark, sf).join(F.broadcast(few), "doc_id"))
    return hits.orderBy(F.desc("combined"), "bucket", "filename").limit(10).select("doc_id", "filename", "bucket", "combined")


# ---- dedup, pages, facets ------------------------------------------------------------------------------------

HITS = f"{CORPUS}, h AS (SELECT *, (doc_id * 7919) % 1000 / 1000.0::DOUBLE AS combined FROM corpus)"


def hits(spark, sf) -> DataFrame:
    return chunks(spark, sf).withColumn("combined", (F.col("doc_id") * 7919) % 1000 / F.lit(1000.0))


@query("collapse_by_file", f"WITH {HITS} SELECT filename, doc_id, combined FROM h QUALIFY row_number() OVER (PARTITION BY filename ORDER BY combined DESC, doc_id) = 1")
def collapse_by_file(spark, sf):
    return results.best_per(hits(spark, sf).select("filename", "doc_id", "combined"), ["filename"], "combined", "doc_id")


@query("dedup_worker", f"WITH {HITS} SELECT doc_id, filename, combined FROM h QUALIFY row_number() OVER (PARTITION BY filename ORDER BY combined DESC, filename, doc_id) = 1")
def dedup_worker(spark, sf):
    return results.worker_dedup(hits(spark, sf)).select("doc_id", "filename", "combined")


@query("dedup_gateway", f"WITH {HITS} SELECT doc_id, bucket, filename FROM h QUALIFY row_number() OVER (PARTITION BY bucket, filename ORDER BY combined DESC, doc_id) = 1")
def dedup_gateway(spark, sf):
    return results.gateway_dedup(hits(spark, sf)).select("doc_id", "bucket", "filename")


@query("dedup_max_score", f"WITH {HITS} SELECT bucket, filename, max(combined) AS combined FROM h GROUP BY bucket, filename")
def dedup_max_score(spark, sf):
    return results.best_per(hits(spark, sf).select("bucket", "filename", "doc_id", "combined"), ["bucket", "filename"], "combined", "doc_id").select("bucket", "filename", "combined")


@query("topk_clamped", f"WITH {HITS} SELECT doc_id, combined FROM h ORDER BY combined DESC, doc_id LIMIT 50")
def topk_clamped(spark, sf):
    return hits(spark, sf).orderBy(F.desc("combined"), "doc_id").limit(retrieve.clamp_limit(500)).select("doc_id", "combined")


@query("limit_clamp", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 10 ELSE least(p_size * 2, 50) END AS INTEGER) AS n FROM part")
def limit_clamp(spark, sf):
    wanted = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'many' WHEN 1 THEN CAST(-p_size AS STRING) WHEN 2 THEN NULL ELSE CAST(p_size * 2 AS STRING) END")
    return table(spark, sf, "part").select("p_partkey", retrieve.clamped(wanted).alias("n"))


@query("paginate", f"WITH {HITS} SELECT doc_id, combined FROM h ORDER BY combined DESC, doc_id LIMIT 10 OFFSET 20")
def paginate(spark, sf):
    return results.page(hits(spark, sf), [F.desc("combined"), "doc_id"], 10, 20).select("doc_id", "combined")


def _facet(field: str, size: int):
    query(f"facet_{field}", f'WITH {CORPUS} SELECT {field} AS key, count(*) AS count FROM corpus GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {size}')(lambda spark, sf: results.facet(chunks(spark, sf), field, size))


for _field, _size in SearchConfig().facet_sizes:
    _facet(_field, _size)


@query("facet_total_size", f"WITH {CORPUS} SELECT CAST(sum(size_bytes) AS BIGINT) AS total_size FROM corpus")
def facet_total_size(spark, sf):
    return results.total_size(chunks(spark, sf))


@query("type_counts", f"WITH {CORPUS} SELECT CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE extension END AS kind, count(*) AS n FROM corpus GROUP BY 1")
def type_counts(spark, sf):
    return results.type_counts(chunks(spark, sf).withColumn("extension", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.upper("extension"))))


@query("count_by_term", f"WITH {CORPUS} SELECT count(*) AS n FROM corpus WHERE bucket = 'src5'")
def count_by_term(spark, sf):
    return chunks(spark, sf).where(F.col("bucket") == "src5").agg(F.count("*").alias("n"))


@query("index_stats", "SELECT count(*) AS doc_count, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM documents")
def index_stats(spark, sf):
    return results.index_stats(chunks(spark, sf))


@query("suggest_prefix", f"WITH {CORPUS} SELECT DISTINCT filename FROM corpus WHERE lower(filename) LIKE 'doc!_1%' ESCAPE '!' ORDER BY 1 LIMIT 5")
def suggest_prefix(spark, sf):
    path = _folder(spark, sf, "completions")
    if not versions(spark, path):
        suggest.write_completions(chunks(spark, sf).select(F.col("filename").alias("name"), F.lit(0.0).alias("weight")), path)
    return suggest.complete(suggest.completion_table(spark, path), "DOC_1").select(F.col("name").alias("filename"))


@query("highlight_snippet")
def highlight_snippet(spark, sf):
    return chunks(spark, sf).select("doc_id", F.array_join(retrieve.highlight(F.col("chunk_text"), ["licensed", "the"]), " … ").alias("snippet"))


PASSAGE = "substring(text, CAST(k * 200 + 1 AS BIGINT), 200)"


@query("highlight_passages", f"""WITH p AS (SELECT doc_id, CAST(k * 200 AS INTEGER) AS start, {PASSAGE} AS piece, {WORDS % PASSAGE} AS w FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text), 1) / 200.0) AS BIGINT))) AS k FROM documents)),
s AS (SELECT *, CAST(len(list_filter(w, lambda x: x = 'licensed')) AS DOUBLE) AS a, CAST(len(list_filter(w, lambda x: x = 'the')) AS DOUBLE) AS b FROM p),
r AS (SELECT doc_id, start, piece, round(3.0 * a / (a + 1.2) + 1.0 * b / (b + 1.2), 9) AS score FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS INTEGER) AS rank, start, round(score, 6) AS score, md5(piece) AS digest FROM r WHERE score > 0 QUALIFY rank <= 3""")
def highlight_passages(spark, sf):
    """The three best passages of each document for two terms of different weight."""
    best = retrieve.passages(F.col("text"), ["licensed", "the"], weights={"licensed": 3.0})
    rows_ = table(spark, sf, "documents").select("doc_id", F.posexplode(best).alias("at", "p"))
    return rows_.select("doc_id", (F.col("at") + 1).alias("rank"), "p.start", F.round("p.score", 6).alias("score"), F.md5(F.encode("p.text", "UTF-8")).alias("digest"))


@query("rerank_proximity", f"""WITH w AS (SELECT doc_id, {WORDS % 'substring(text, 1, 1000)'} AS w FROM documents),
t AS (SELECT doc_id, unnest(list_filter(list_transform(w, lambda x, i: CASE WHEN x IN ('the', 'and') THEN struct_pack(term := x, place := i) END), lambda x: x IS NOT NULL), recursive := true) FROM w),
l AS (SELECT doc_id, place, max(CASE WHEN term = 'the' THEN place END) OVER r AS a, max(CASE WHEN term = 'and' THEN place END) OVER r AS b FROM t WINDOW r AS (PARTITION BY doc_id ORDER BY place)),
b AS (SELECT doc_id, min(place - least(a, b) + 1) AS best FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(best AS INTEGER) AS words, round(coalesce(2.0 / best, 0), 6) AS proximity FROM documents LEFT JOIN b USING (doc_id)""")
def rerank_proximity(spark, sf):
    """The shortest stretch with both terms in the head of each document, and the nearness that a second ranking takes from it."""
    head = F.substring("text", 1, 1000)
    return table(spark, sf, "documents").select("doc_id", retrieve.covering_window(fx.analyze(head), ["the", "and"]).alias("words"), F.round(retrieve.proximity(head, ["the", "and"]), 6).alias("proximity"))


@query("ordered_distinct", f"WITH {TOKENS} SELECT doc_id, md5(array_to_string(list_filter(terms, lambda w, i: list_position(terms, w) = i), ' ')) AS digest FROM t")
def ordered_distinct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(F.array_join(F.array_distinct(fx.analyze(F.col("text"))), " "), "UTF-8")).alias("digest"))


@query("filter_exact_keyword", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE owner = 'user3' AND filename = 'doc_10.txt'")
def filter_exact_keyword(spark, sf):
    return chunks(spark, sf).where(predicates.exact(owner="user3", filename="doc_10.txt")).select("doc_id")


@query("source_projection", f"WITH {CORPUS} SELECT doc_id, filename, bucket FROM corpus WHERE extension = 'pdf'")
def source_projection(spark, sf):
    """Some fields of the hits without the large one; the scan reads no text."""
    return predicates.project(chunks(spark, sf).where("extension = 'pdf'"), include=["doc_id", "filename", "bucket", "chunk_text", "author"], exclude=["chunk_text", "embedding"])


@query("idempotent_extraction", "SELECT count(*) AS pages, 0 AS differing FROM pages")
def idempotent_extraction(spark, sf):
    """Pages whose text differs between two extractions of the same bytes."""
    once = lambda: table(spark, sf, "pages").select("page_id", ingest.extract(F.encode("html", "UTF-8"), F.lit("text/html")).alias("r")).select("page_id", "r.text")
    a, b = once(), once().toDF("id", "again")
    both = a.join(b, F.col("page_id") == F.col("id"), "full")
    return both.agg(F.count("*").alias("pages"), F.count_if(~F.equal_null("text", "again")).cast("int").alias("differing"))


@query("snippet_fallback", f"WITH {CORPUS} SELECT doc_id, md5(substring(chunk_text, 1, 150)) AS digest FROM corpus")
def snippet_fallback(spark, sf):
    return chunks(spark, sf).select("doc_id", F.md5(F.encode(F.element_at(retrieve.highlight(F.col("chunk_text"), ["zzzznever"]), 1), "UTF-8")).alias("digest"))


@query("fuzzy_terms", f"WITH {TOKENS}, v AS (SELECT DISTINCT unnest(terms) AS term FROM t) SELECT term, CAST(damerau_levenshtein(term, 'thesnd') AS INTEGER) AS edits FROM v WHERE left(term, 2) = 'th' AND damerau_levenshtein(term, 'thesnd') <= 2")
def fuzzy_terms(spark, sf):
    return index(spark, sf).near_terms("thesnd", retrieve.edits_allowed("thesnd")).select("term", "edits")


@query("fuzzy_terms_scan", f"WITH {TOKENS}, v AS (SELECT DISTINCT unnest(terms) AS term FROM t) SELECT term, CAST(damerau_levenshtein(term, 'erhation') AS INTEGER) AS edits FROM v WHERE left(term, 2) = 'er' AND damerau_levenshtein(term, 'erhation') <= 2")
def fuzzy_terms_scan(spark, sf):
    vocabulary = table(spark, sf, "documents").select(F.explode(fx.analyze(F.col("text"))).alias("term")).distinct()
    return retrieve.fuzzy_terms(vocabulary, "erhation").select("term", "edits")


@query("rerank_lexical", f"WITH {HITS}, p AS (SELECT * FROM h WHERE combined < 0.9 ORDER BY combined DESC, doc_id LIMIT 50) SELECT doc_id, round(len(list_intersect({WORDS % 'substring(chunk_text, 1, 1000)'}, ['the', 'licensed', 'and'])) / 3.0, 6) AS rerank_score, false AS fast_path FROM p")
def rerank_lexical(spark, sf):
    pool = hits(spark, sf).where("combined < 0.9").orderBy(F.desc("combined"), "doc_id").limit(50)
    return retrieve.rerank(pool, ["the", "licensed", "and"]).select("doc_id", F.round("rerank_score", 6).alias("rerank_score"), "fast_path")


@query("rerank_fast_path", f"WITH {HITS}, p AS (SELECT doc_id, CASE WHEN doc_id = 7 THEN 0.97::DOUBLE ELSE combined / 2 END AS combined FROM h) SELECT doc_id, combined AS rerank_score, true AS fast_path FROM p ORDER BY combined DESC, doc_id LIMIT 50")
def rerank_fast_path(spark, sf):
    pool = hits(spark, sf).withColumn("combined", F.when(F.col("doc_id") == 7, F.lit(0.97)).otherwise(F.col("combined") / 2)).orderBy(F.desc("combined"), "doc_id").limit(50)
    return retrieve.rerank(pool, ["the"]).select("doc_id", "rerank_score", "fast_path")


# ---- cache -------------------------------------------------------------------------------------------------------


@query("cache_key_gateway", f"SELECT i, 'search:' || sha256(query) AS key FROM {ASKED_ROWS}")
def cache_key_gateway(spark, sf):
    return asked(spark, sf).select("i", cache.gateway_key(F.col("query")).alias("key"))


@query("cache_key_library", f"""SELECT i, 'search:' || left(sha256('{{"bucket":"","date_from":"","date_to":"","ext":"pdf","from":0,"owner":"","q":"' || lower(trim(query)) || '","size":10,"tags":["a","b"]}}'), 32) AS key FROM {ASKED_ROWS}""")
def cache_key_library(spark, sf):
    none = F.lit(None).cast("string")
    return asked(spark, sf).select("i", cache.library_key(F.col("query"), F.lit("PDF"), none, none, F.array(F.lit("b"), F.lit("a")), none, none, F.lit(10), F.lit(0)).alias("key"))


def log(spark, sf) -> DataFrame:
    """events as a query log."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("q"), k).alias("query"), F.concat(F.lit("q"), F.col("user_id") % 40).alias("key"), (F.col("event_type") == "view").alias("has_filters"))


QLOG = "q AS (SELECT event_id, ts, 'q' || json_extract_string(props, '$.k') AS query FROM events)"


@query("popular_queries", f"WITH {QLOG} SELECT query, count(*) AS n FROM q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def popular_queries(spark, sf):
    return cache.popular(log(spark, sf))


@query("recent_queries", f"WITH {QLOG} SELECT query, epoch_us(max(ts)) AS last_us FROM q WHERE contains(query, '1') GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 10")
def recent_queries(spark, sf):
    return cache.recent(log(spark, sf), contains="1").select("query", F.unix_micros("last").alias("last_us"))


LONG = CachePolicy(default_ttl=7200, filtered_ttl=7200, popular_ttl=43200, popular_at=3)


PROMOTED = """WITH RECURSIVE e AS (SELECT event_id, ts, 'q' || (user_id % 40) AS key, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, n, event_id, false AS hit, ts + INTERVAL 2 HOUR AS alive, 0 AS hits, NULL::TIMESTAMP AS counted FROM e WHERE n = 1
 UNION ALL SELECT key, n, event_id, hit, CASE WHEN hit AND so_far + 1 = 3 THEN ts + INTERVAL 12 HOUR WHEN hit THEN alive ELSE ts + INTERVAL 2 HOUR END, CASE WHEN hit THEN so_far + 1 ELSE so_far END, CASE WHEN hit THEN ts + INTERVAL 24 HOUR ELSE counted END
 FROM (SELECT e.key, e.n, e.event_id, e.ts, e.ts < r.alive AS hit, r.alive, CASE WHEN r.counted IS NOT NULL AND e.ts >= r.counted THEN 0 ELSE r.hits END AS so_far, r.counted FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT event_id, key, hit, epoch_us(alive) AS expires_us FROM r"""


@query("cache_ttl_replay", PROMOTED)
def cache_ttl_replay(spark, sf):
    return cache.replay(log(spark, sf), LONG).select("event_id", "key", "hit", F.unix_micros("expires_at").alias("expires_us"))


REPLAY = """WITH RECURSIVE e AS (SELECT event_id, ts, 'q' || (user_id % 40) AS key, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, n, ts AS started, false AS hit FROM e WHERE n = 1
 UNION ALL SELECT e.key, e.n, CASE WHEN e.ts < r.started + INTERVAL 2 HOUR THEN r.started ELSE e.ts END, e.ts < r.started + INTERVAL 2 HOUR FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(100.0 * count(*) FILTER (hit) / count(*), 2) AS hit_rate_pct, count(DISTINCT key) AS cached_keys FROM r"""


@query("cache_hit_stats", REPLAY)
def cache_hit_stats(spark, sf):
    never = CachePolicy(default_ttl=7200, filtered_ttl=7200, popular_at=10**9)
    return cache.statistics(cache.replay(log(spark, sf), never))


# ---- dead letters ------------------------------------------------------------------------------------------------


def letters(spark, sf) -> DataFrame:
    body = "to_json(named_struct('original_payload', CASE WHEN event_id % 13 = 0 THEN '' ELSE props END, 'error', 'boom', 'bucket', 'b', 'key', 'k', 'failed_at', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'retry_count', CASE WHEN event_id % 5 = 4 THEN NULL ELSE cast(event_id % 5 as int) END))"
    return table(spark, sf, "events").where("event_type = 'error'").select("event_id", "ts", F.expr(f"CASE WHEN event_id % 17 = 0 THEN 'not json' ELSE {body} END").alias("value"))


LETTERS = """l AS (SELECT event_id, ts, CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 5 = 4 THEN 0 ELSE event_id % 5 END AS c, event_id % 17 = 0 AS bad, event_id % 13 = 0 AS blank FROM events WHERE event_type = 'error'),
m AS (SELECT *, CASE WHEN bad THEN 'skip' WHEN c >= 3 OR blank THEN 'permanent' ELSE 'retry' END AS action FROM l)"""


@query("dlq_transition", f"WITH {LETTERS} SELECT event_id, CAST(c AS INTEGER) AS retry_count, action, CAST(CASE WHEN action = 'retry' THEN c + 1 END AS INTEGER) AS next_count, CAST(CASE WHEN action = 'retry' THEN ([60, 300, 900])[CAST(c AS INTEGER) + 1] END AS INTEGER) AS wait_seconds FROM m")
def dlq_transition(spark, sf):
    return dead_letters.transition(letters(spark, sf)).select("event_id", "retry_count", "action", "next_count", "wait_seconds")


@query("dlq_backoff_due", f"WITH {LETTERS} SELECT event_id FROM m WHERE action = 'retry' AND date_trunc('second', ts) + to_seconds(([60, 300, 900])[CAST(c AS INTEGER) + 1]) <= TIMESTAMP '2024-01-15'")
def dlq_backoff_due(spark, sf):
    moved = dead_letters.transition(letters(spark, sf)).withColumn("failed_at", F.col("letter.failed_at"))
    return dead_letters.due(moved, F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query("dlq_permanent", f"WITH {LETTERS} SELECT count(*) AS n FROM m WHERE action = 'permanent'")
def dlq_permanent(spark, sf):
    return dead_letters.transition(letters(spark, sf)).where("action = 'permanent'").agg(F.count("*").alias("n"))


@query("dlq_chain", f"WITH {LETTERS} SELECT event_id, CASE WHEN bad THEN 'skip' ELSE 'permanent' END AS ended, CAST(CASE WHEN bad OR blank THEN 0 ELSE greatest(3 - c, 0) END AS INTEGER) AS retries FROM m")
def dlq_chain(spark, sf):
    """Letters whose payloads fail again each time they are resent, until no attempt is left."""
    state = letters(spark, sf).withColumn("retries", F.lit(0))
    for _ in range(4):
        moved = dead_letters.transition(state)
        again = dead_letters.envelope(F.col("letter.original_payload"), F.col("letter.error"), F.col("letter.bucket"), F.col("letter.key"), F.col("letter.failed_at"), F.col("next_count"))
        resent = F.col("action") == "retry"
        state = moved.select("event_id", F.when(resent, again).otherwise(F.col("value")).alias("value"), (F.col("retries") + resent.cast("int")).alias("retries"))
    return dead_letters.transition(state).select("event_id", F.col("action").alias("ended"), "retries")


@query("dlq_backoff_schedule", "SELECT event_id, CAST(([60, 300, 900])[CAST(least(event_id % 12, 2) AS INTEGER) + 1] AS INTEGER) AS s FROM events")
def dlq_backoff_schedule(spark, sf):
    return table(spark, sf, "events").select("event_id", dead_letters.backoff((F.col("event_id") % 12).cast("int")).alias("s"))


# ---- text quality --------------------------------------------------------------------------------------------------

BAD = [
    "ok plain words of text here", "<FEFF00410042>", "ABCDEF0123456789ABCDEF00 x", "a /IncludeSlug b endobj c %%EOF d endstream", "Acrobat Distiller and GrayACSImageDict and MonoImageDict", "<x:xmpmeta>", "<?xml version='1.0'?>", "/ENU (a) /DEU  (b)", "/ENU (a)", "éééééé abc", "abababababab" * 20, "   \n\t   a   ", "1234567890 1234567890 1234567890 !!", "", "xref 12", "short", "BT  /F1",
]
BOTH = f"(SELECT CAST(doc_id AS BIGINT) AS id, text AS t FROM documents UNION ALL SELECT page_id + 1000000000, html FROM pages UNION ALL SELECT 2000000000 + i, text FROM {literal_rows(BAD, 'text')})"


def noisy_texts(spark, sf) -> DataFrame:
    plain = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("id"), F.col("html").alias("t"))
    return plain.union(pages).union(rows(spark, BAD, "t").select((F.col("i") + F.lit(2000000000).cast("long")).alias("id"), "t"))


def _listed_sql(patterns: list[str], label: str, shown: int) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {quote(p)}) THEN {quote(p)} END" for p in patterns) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN '{label} (' || array_to_string(({found})[1:{shown}], ', ') || ')' END"


STRIPPED = "trim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WINDOWS = f"list_transform(range(0, greatest(CAST(floor((length({STRIPPED}) - 11) / 10.0) AS BIGINT), 0) + 1), lambda k: substring({STRIPPED}, k * 10 + 1, 10))"
NOISE_SQL = {
    "noise_hex": "CASE WHEN regexp_matches(t, '<FEFF[0-9A-Fa-f]{4,}') THEN 'hex-unicode-blob (<FEFF...>)' WHEN length(array_to_string(regexp_extract_all(t, '[0-9A-Fa-f]{16,}'), '')) > 0 AND length(array_to_string(regexp_extract_all(t, '[0-9A-Fa-f]{16,}'), '')) / greatest(length(replace(replace(t, ' ', ''), chr(10), '')), 1) > 0.5 THEN 'hex-run (>50% hex chars)' END",
    "noise_pdf": _listed_sql(quality.PDF, "pdf-internals", 3),
    "noise_distiller": _listed_sql(quality.DISTILLER, "distiller-settings", 2),
    "noise_xml": f"CASE WHEN regexp_matches(t, {quote(quality.XMP)}) THEN 'xml-xmp-metadata' WHEN regexp_matches(t, {quote(quality.XML)}) THEN 'xml-declaration' END",
    "noise_locale": f"CASE WHEN len(regexp_extract_all(t, {quote(quality.LOCALES)})) >= 2 THEN 'locale-strings (' || len(regexp_extract_all(t, {quote(quality.LOCALES)})) || ' language blocks)' END",
    "noise_non_ascii": r"CASE WHEN length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) / greatest(length(t), 1) > 0.4 THEN 'high-non-ascii (' || CAST(round(length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) / greatest(length(t), 1) * 100) AS INTEGER) || '% non-ASCII chars)' END",
    "noise_repetitive": f"CASE WHEN length({STRIPPED}) >= 40 AND len(list_distinct({WINDOWS})) / len({WINDOWS}) < 0.2 THEN 'repetitive-content (only ' || CAST(round(len(list_distinct({WINDOWS})) / len({WINDOWS}) * 100) AS INTEGER) || '% unique 10-char windows)' END",
    "noise_whitespace": r"CASE WHEN length(regexp_replace(t, '\s', '', 'g')) / greatest(length(t), 1) < 0.3 THEN 'whitespace-dominated (' || CAST(round(length(regexp_replace(t, '\s', '', 'g')) / greatest(length(t), 1) * 100) AS INTEGER) || '% printable chars)' END",
    "noise_no_words": "CASE WHEN NOT regexp_matches(t, '[a-zA-Z]{3,}') AND length(t) > 30 THEN 'no-words (numeric/symbol only)' END",
}


def _noise(name: str):
    query(name, f"SELECT id, {NOISE_SQL[name]} AS flag FROM {BOTH}")(lambda spark, sf: noisy_texts(spark, sf).select("id", quality.DETECTORS[name](F.col("t")).alias("flag")))


for _name in quality.DETECTORS:
    _noise(_name)

ALL_FLAGS = "list_filter([" + ", ".join(NOISE_SQL.values()) + "], lambda x: x IS NOT NULL)"


@query("noise_breakdown", f"SELECT label, count(*) AS n FROM (SELECT split_part(unnest({ALL_FLAGS}), ' (', 1) AS label FROM {BOTH}) GROUP BY 1")
def noise_breakdown(spark, sf):
    return quality.breakdown(noisy_texts(spark, sf), "t")


@query("noise_level", f"""WITH x AS (SELECT 'f' || (id % 7) AS file, CASE WHEN len({ALL_FLAGS}) > 0 THEN 1 ELSE 0 END AS y FROM {BOTH}) SELECT file, count(*) AS total, CAST(sum(y) AS BIGINT) AS noisy, round(sum(y) / count(*), 6) AS ratio, CASE WHEN sum(y) = 0 THEN 'clean' WHEN sum(y) / count(*) < 0.15 THEN 'low' WHEN sum(y) / count(*) < 0.4 THEN 'medium' ELSE 'high' END AS level FROM x GROUP BY 1""")
def noise_level(spark, sf):
    return quality.file_report(noisy_texts(spark, sf).withColumn("file", F.concat(F.lit("f"), F.col("id") % 7)), "file", "t")


@query("noise_totals", f"WITH x AS (SELECT id % 7 AS file, CASE WHEN len({ALL_FLAGS}) > 0 THEN 1 ELSE 0 END AS y FROM {BOTH}) SELECT count(DISTINCT file) AS files, count(*) AS chunks, CAST(sum(y) AS BIGINT) AS noisy FROM x")
def noise_totals(spark, sf):
    return quality.totals(quality.file_report(noisy_texts(spark, sf).withColumn("file", F.col("id") % 7), "file", "t"))


# ---- reports, images, formats -----------------------------------------------------------------------------------------


def cases(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("case_id"), (F.col("value") * 100 + F.col("event_id") / 1e7).alias("latency_ms"), (F.col("event_type") != "error").alias("passed"), F.when(F.col("event_id") % 100 == 0, 384).otherwise(512).alias("dims"), (F.col("event_id") % 9).alias("chars"))


CASE_ROWS = "c AS (SELECT event_id AS case_id, value * 100 + event_id / 1e7 AS latency_ms, event_type <> 'error' AS passed, CASE WHEN event_id % 100 = 0 THEN 384 ELSE 512 END AS dims, event_id % 9 AS chars FROM events)"


@query("pipeline_summary", f"WITH {CASE_ROWS} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(latency_ms), 4) AS avg_latency_ms, arg_max(case_id, latency_ms) AS slowest, arg_min(case_id, latency_ms) AS fastest, count(*) FILTER (latency_ms > 5000) AS over_threshold, count(*) FILTER (dims <> 512) AS wrong_dims FROM c")
def pipeline_summary(spark, sf):
    return report.summary(cases(spark, sf))


@query("result_validation", f"WITH {CASE_ROWS} SELECT case_id, array_to_string(list_filter([CASE WHEN latency_ms > 5000 THEN 'WARNING: slow' END, CASE WHEN dims <> 512 THEN 'CRITICAL: dimensions' END, CASE WHEN chars = 0 AND case_id % 2 <> 0 THEN 'WARNING: no text' END], lambda x: x IS NOT NULL), '|') AS flags FROM c")
def result_validation(spark, sf):
    return cases(spark, sf).select("case_id", F.array_join(report.validation_flags(F.col("latency_ms"), F.col("dims"), F.col("chars"), F.col("case_id") % 2 == 0, F.lit(False)), "|").alias("flags"))


@query("centre_crop_geometry", "SELECT p_partkey, CAST((w - least(w, h)) // 2 AS INTEGER) AS left_, CAST((h - least(w, h)) // 2 AS INTEGER) AS top_, CAST(least(w, h) AS INTEGER) AS side FROM (SELECT p_partkey, 100 + p_size * 7 AS w, 90 + p_partkey % 400 AS h FROM part)")
def centre_crop_geometry(spark, sf):
    box = images.centre_crop((100 + F.col("p_size") * 7).cast("int"), (90 + F.col("p_partkey") % 400).cast("int"))
    return table(spark, sf, "part").select("p_partkey", box.alias("b")).select("p_partkey", F.col("b.left").alias("left_"), F.col("b.top").alias("top_"), "b.side")


@query("dms_to_decimal", "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (p_size + (p_partkey % 60) / 60.0 + (p_partkey % 50) / 3600.0), 6) AS degrees FROM part")
def dms_to_decimal(spark, sf):
    ref = F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("n")
    return table(spark, sf, "part").select("p_partkey", images.decimal_degrees(F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double"), (F.col("p_partkey") % 50).cast("double"), ref).alias("degrees"))


@query("image_caption", "SELECT p_partkey, 'Image: img' || p_partkey || '.jpg (' || (100 + p_size) || 'x50 pixels, image/jpeg)' || CASE WHEN p_partkey % 2 = 0 THEN ' Camera: ' || p_brand || ' M1.' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' Date: 2024:01:02.' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' Location: ' || printf('%.4f', p_size + 0.25) || '°S, ' || printf('%.4f', p_size + 0.5) || '°E.' ELSE '' END AS caption FROM part")
def image_caption(spark, sf):
    c, key = F.col, F.col("p_partkey")
    size = c("p_size").cast("double")
    text = images.caption(
        F.concat(F.lit("img"), key, F.lit(".jpg")), 100 + c("p_size"), F.lit(50), F.lit("image/jpeg"), F.when(key % 2 == 0, c("p_brand")), F.when(key % 2 == 0, "M1"), F.when(key % 3 == 0, "2024:01:02"),
        F.when(key % 5 == 0, -(size + 0.25)), F.when(key % 5 == 0, size + 0.5), F.lit(""),
    )
    return table(spark, sf, "part").select("p_partkey", text.alias("caption"))


@query("image_validation", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'empty image' WHEN doc_id % 4 = 0 THEN 'unsupported image type' WHEN strlen(text) + [8, 9, 4, 4, 4][CAST(doc_id % 5 AS INTEGER) + 1] > 5000 THEN 'image too large'
  WHEN doc_id % 5 NOT IN (1, 2) THEN 'undecodable image' END AS e FROM documents""")
def image_validation(spark, sf):
    content = F.when(F.col("doc_id") % 9 == 0, F.lit(b"")).otherwise(F.concat(F.unhex(F.expr(_pick(HEADS, "doc_id"))), F.encode("text", "UTF-8")))
    mime = F.when(F.col("doc_id") % 4 == 0, "image/gif").otherwise("image/jpeg")
    return table(spark, sf, "documents").select("doc_id", images.validation_error(content, mime, IngestConfig(max_image_bytes=5000)).alias("e"))


@query("byte_size_format", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS shown FROM (SELECT doc_id, n_chars * (doc_id % 1000) AS n FROM documents)")
def byte_size_format(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.human_size(F.col("n_chars") * (F.col("doc_id") % 1000)).alias("shown"))


@query("percent_format", "SELECT doc_id, CAST(floor(doc_id % 1000 / 1000.0 * 100 + 0.5) AS INTEGER) || '%' AS shown FROM documents")
def percent_format(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.percent(F.col("doc_id") % 1000 / F.lit(1000.0)).alias("shown"))


@query("from_millis", "SELECT event_id, strftime(epoch_ms(event_id * 86400123), '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def from_millis(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.full_time(fx.from_millis(F.col("event_id") * 86400123)).alias("shown"))


@query("short_date", "SELECT event_id, strftime(ts, '%b %-d, %Y') AS shown FROM events")
def short_date(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.short_date(F.col("ts")).alias("shown"))


def _embed_sql(text: str) -> str:
    return f"""WITH w AS (SELECT doc_id, unnest({WORDS % text}) AS word FROM documents), s AS (SELECT doc_id, ('0x' || left(md5(word), 4))::INTEGER % 128 AS slot FROM w),
c AS (SELECT doc_id, slot // 2 AS dim, sum(CASE WHEN slot % 2 = 0 THEN 1 ELSE -1 END) AS x FROM s GROUP BY ALL)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM c WHERE x <> 0"""


def _embedded(spark, sf, most_chars: int | None = None) -> DataFrame:
    """The components of each document's vector that are not 0."""
    from siftline.functions.embed import embed

    found = table(spark, sf, "documents").select("doc_id", F.posexplode(embed(F.col("text"), most_chars=most_chars)).alias("dim", "x"))
    return found.where("x <> 0").select("doc_id", "dim", F.round("x", 6).alias("value"))


@query("embed_text", _embed_sql("text"))
def embed_text(spark, sf):
    return _embedded(spark, sf)


@query("embed_text_legacy", _embed_sql("substring(text, 1, 300)"))
def embed_text_legacy(spark, sf):
    """The legacy service embeds the first 300 characters."""
    return _embedded(spark, sf, 300)


@query("search_engine")
def search_engine(spark, sf):
    from siftline.plans.search import SearchEngine

    engine = SearchEngine(chunks(spark, sf), table(spark, sf, "embeddings"), index=index(spark, sf))
    found = engine.search("pdf files about licensed software", limit=10, now=NOW, query_vector=query_vector(spark, sf))
    return found.hits.select("doc_id", "filename", "bucket", "combined", "rerank_score", "summary")


@query("library_search")
def library_search(spark, sf):
    from siftline.plans.search import SearchEngine

    page, _, _ = SearchEngine(chunks(spark, sf), table(spark, sf, "embeddings"), index=index(spark, sf)).hybrid("licensed the", query_vector(spark, sf), size=10, extension="pdf")
    return page.select("doc_id", "filename", "combined", "snippet")
