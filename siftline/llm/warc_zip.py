"""WARC records packed in ZIP archives: written in parallel, read back by range.

An archive is a ZIP file with stored members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdxj`, a line with offset and length of each record. The reader takes the end of each file, follows
the ZIP64 locator if there is one, parses the central directory, and reads the index lines; a WARC member
that no index names is walked record by record. Then records are dealt out by archive and place and each is
read by its byte range: no member is unpacked as a whole. Digests of payloads are checked on the way.

Of records with equal payloads (SHA-256) that with the least id is a response and the others are revisits that refer to
it. Payloads stay where they are read; only digests meet. Digests that hold a thousandth of the rows, a thousand
at most, always travel by broadcast; the others too while they are few, else by a shuffle without the hot ones.
Files are written under names of their own for each attempt; only those that the committed manifest names are read.

Edge cases: a null payload is empty; very long payloads are slices of their own; a record whose id is null is never
referred to, and equal payloads without any id are all responses; rows that repeat id and payload each get the
same record type; URLs may be null, line ends in them are escaped; other columns are ignored, whatever their names; an
empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import bound_batches, shared_dir, slices, trimmed, write_out

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive whose records one task reads.
RANGE_BYTES = 8 << 20
#: Digests of repeated payloads, 32 bytes and an id each, that may be broadcast: at most some 60 MB.
FEW_DIGESTS = 300_000
#: A digest with one of so many rows is hot; there are at most as many hot ones.
HOT_SHARE = 1000
BLOCK = 1 << 20

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store_of(path: str):
    """File system and path of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(record_id: str | None) -> str:
    return f"<urn:record:{'' if record_id is None else base64.b16encode(record_id.encode()).decode()}>"


def _id(uri: str | None) -> str | None:
    hexed = (uri or "").removeprefix("<urn:record:").removesuffix(">")
    return base64.b16decode(hexed).decode() if hexed else None


def warc_record(record_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of refers_to without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(record_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", REVISIT)]
    head += [("WARC-Payload-Digest", "sha1:" + digest_of(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in lines}


def parse_record(data: bytes) -> dict:
    """record_type, record_id, url, refers_to, payload_bytes, payload_digest and payload (None: a revisit) of one WARC record; a payload that belies its digest is an error."""
    head, ended, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not ended:
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if digest_of(payload) != (digest or digest_of(payload)):
            raise ValueError(f"the payload of {fields.get('warc-record-id')} is damaged")
        digest, size = digest_of(payload), len(payload)
    else:
        payload, size = None, int(_fields(http).get("content-length", 0))
    url = fields.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"record_type": kind, "record_id": _id(fields.get("warc-record-id")), "url": url, "refers_to": _id(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": payload}


class ArchiveWriter:
    """Streams records into the archive of a path; only its index lines are kept."""

    def __init__(self, path: str):
        store, where = store_of(path)
        self.path, self.size, self.lines = path, 0, []
        self.out = store.open_output_stream(where)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)

    def add(self, record: bytes, url: str | None) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"url": url, "filename": "data.warc.gz", "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> int:
        """Bytes of the archive's records."""
        self.member.close()
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(f"- 19700101000000 {line}\n".encode())
        self.zip.close()
        self.out.close()
        return self.size


def central_directory(file, size: int) -> list[dict]:
    """name, method, packed, start (of the member's bytes) of each member of an open ZIP or ZIP64 file."""

    def at(where: int, n: int) -> bytes:
        file.seek(where)
        return file.read(n)

    tail_at = max(0, size - 22 - 0xFFFF)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + (struct.unpack_from("<H", tail, end + 20)[0] if end + 22 <= len(tail) else len(tail)) > len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file")
    entries, length, begin = struct.unpack_from("<HII", tail, end + 10)
    last = tail_at + end
    locator = at(last - 20, 20) if last >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", locator, 8)
        record = at(where, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("a ZIP64 end record is missing")
        entries, length, begin = struct.unpack_from("<QQQ", record, 32)
        last = where
    elif entries == 0xFFFF or 0xFFFFFFFF in (length, begin):
        raise ValueError("a ZIP64 locator is missing")
    shift = last - length - begin  # bytes before the first member
    directory, members, p = at(begin + shift, length), [], 0
    for _ in range(entries):
        mark, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, p)
        if mark != b"PK\x01\x02":
            raise ValueError("a ZIP directory is damaged")
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
            q += 4 + n
        local = at(header + shift, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"the header of {name} is damaged")
        start = header + shift + 30 + sum(struct.unpack_from("<HH", local, 26))
        members.append({"name": name, "method": method, "packed": packed, "start": start})
        p += 46 + n_name + n_extra + n_comment
    return members


def _blocks(file, start: int, length: int) -> Iterator[bytes]:
    for at in range(start, start + length, BLOCK):
        file.seek(at)
        yield file.read(min(BLOCK, start + length - at))


def _lines(file, member: dict) -> Iterator[bytes]:
    """Lines of a stored or deflated, perhaps gzipped, member, block by block."""
    unpackers = [zlib.decompressobj(-15)] * (member["method"] == 8) + [zlib.decompressobj(31)] * member["name"].endswith(".gz")
    held = b""
    for block in _blocks(file, member["start"], member["packed"]):
        for u in unpackers:
            block = u.decompress(block)
        *whole, held = (held + block).split(b"\n")
        yield from whole
    if held:
        yield held


def _walked(file, member: dict) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member of a stored member."""
    at, seen, unpacker = 0, 0, zlib.decompressobj(31)
    for block in _blocks(file, member["start"], member["packed"]):
        while block:
            unpacker.decompress(block)
            used = len(block) - len(unpacker.unused_data)
            seen += used
            block = block[used:]
            if unpacker.eof:
                yield at, seen - at
                at, unpacker = seen, zlib.decompressobj(31)


def located(path: str) -> Iterator[tuple[str, int, int]]:
    """path, place and length of every record of an archive."""
    store, where = store_of(path)
    with store.open_input_file(where) as file:
        members = central_directory(file, file.size())
        warcs = {m["name"].rpartition("/")[2]: m for m in members if m["name"].endswith((".warc.gz", ".warc"))}
        for name, m in warcs.items():
            if m["method"] != 0 or name.endswith(".warc"):
                raise ValueError(f"{name} in {path} is not a stored member of gzipped records")
        named = set()
        for m in members:
            if m["name"].startswith("indexes/") and m["name"].endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
                for line in _lines(file, m):
                    facts = line[line.find(b"{") :]
                    if facts.startswith(b"{"):
                        facts = json.loads(facts)
                        name = str(facts["filename"]).rpartition("/")[2]
                        named.add(name)
                        yield path, warcs[name]["start"] + int(facts["offset"]), int(facts["length"])
        for name, m in warcs.items():
            if name not in named:
                for at, length in _walked(file, m):
                    yield path, m["start"] + at, length


def write_archives(pages: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (id, url, payload string or binary, refers_to; ids are strings) to archives in a shared folder; the written manifest: path, records, bytes."""
    bound_batches(pages.sparkSession)
    rows = pages.select("id", "url", F.col("payload").cast("binary").alias("payload"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([archive.path]), pa.array([len(archive.lines)], pa.int64()), pa.array([archive.close()], pa.int64())], names=["path", "records", "bytes"])

        for batch in slices(batches, 2):
            ids, urls, payloads, refers = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                archive = archive or ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                url = urls[i].as_py()
                archive.add(warc_record(ids[i].as_py(), url, payloads[i].as_py() or b"", refers[i].as_py()), url)
                if archive.size >= most:
                    yield closed()
                    archive = None
        if archive:
            yield closed()

    _make_folder(pages.sparkSession, folder)
    return write_out(rows.mapInArrow(trimmed(run), "path string, records bigint, bytes bigint"), "warc-manifest")


def _make_folder(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


RECORD = "path string, place bigint, length bigint, record_type string, record_id string, url string, refers_to string, payload_bytes bigint, payload_digest string"


def read_archives(archives: DataFrame, payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (path, perhaps bytes), one row each; with `payload` also the payloads (null: a revisit's)."""
    bound_batches(archives.sparkSession)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in located(path):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=["path", "place", "length"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=["path", "place", "length"])

    schema = RECORD + ", payload binary" * payload
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, file = [], 0, None, None
        for batch in batches:
            for path, place, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    if file is not None:
                        file.close()
                    store, where = store_of(path)
                    now, file = path, store.open_input_file(where)
                file.seek(place)
                found = parse_record(gzip.decompress(file.read(length)))
                held.append([path, place, length, *[found[n] for n in names[3:]]])
                size += 200 + (found["payload_bytes"] if payload else 0)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)
                    held, size = [], 0
        if file is not None:
            file.close()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)

    places = archives.select("path").mapInArrow(locate, "path string, place bigint, length bigint")
    # a fixed number of tasks: the places are a few bytes each, and what they point at is not
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if "bytes" in archives.columns:
        tasks = -(-(archives.agg(F.sum("bytes")).first()[0] or 1) // range_bytes)
    dealt = places.repartition(tasks, "path", F.expr(f"place div {range_bytes}")).sortWithinPartitions("path", "place")
    return dealt.mapInArrow(trimmed(read), schema)


def with_referred(pages: DataFrame, least: int = 0, few: int = FEW_DIGESTS) -> DataFrame:
    """pages (id, url, payload) with refers_to: the least id with an equal payload of at least `least` bytes, null for that one itself."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    rows = pages.withColumn("sum", F.when(size >= least, F.unhex(F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256))))
    equal = rows.where("sum IS NOT NULL").groupBy("sum").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    equal = write_out(equal.where("n > 1 AND first IS NOT NULL").select(F.col("sum").alias("known"), "first", "n"), "warc-equal")
    if equal.count() <= few:
        rows = rows.join(F.broadcast(equal.drop("n")), F.col("sum") == F.col("known"), "left")
    else:
        bound = pages.count() / HOT_SHARE
        hot = equal.where(F.col("n") >= bound).select(F.col("known").alias("hot_sum"), F.col("first").alias("hot_first"))
        rows = rows.join(F.broadcast(hot), F.col("sum") == F.col("hot_sum"), "left")
        # rows of hot payloads, and short ones, are dealt by what no key equals
        other = F.unhex(F.sha2(F.concat_ws("|", F.lit("-"), "id", "url"), 224))
        rows = rows.withColumn("sum", F.when(F.col("hot_sum").isNull() & F.col("sum").isNotNull(), F.col("sum")).otherwise(other))
        rows = rows.join(equal.where(F.col("n") < bound), F.col("sum") == F.col("known"), "left").withColumn("first", F.coalesce("hot_first", "first"))
    return rows.select("id", "url", "payload", F.when(~F.equal_null("id", "first"), F.col("first")).alias("refers_to"))


def op12_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    rows = with_referred(pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("payload")))
    rows = rows.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    found = read_archives(write_archives(rows, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
    return found.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP12_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
named AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM rows)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM named
"""
