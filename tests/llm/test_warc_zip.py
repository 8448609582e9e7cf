import base64
import gzip
import hashlib
import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline.llm import warc_zip as m

PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/%0A\r\nWARC-Type: x", None), (4, "u", ""), (5, "u", "é\U0001f600\r\n\r\nWARC/1.1\r\n"), (6, "u", "y" * 3_000_000), (None, "u", "<p>x</p>"), (None, "u", "alone"), (7, "u", "y" * 3_000_000), (4, "u", ""), (-9, "u", "<p>x</p>")]


def brute(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [j for j, _, other in pages if (other or "") == (html or "") and j is not None]
        first = min(ids, default=None)
        kind = "response" if first is None or i == first else "revisit"
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


def table(spark, path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, `a.b` int").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "RANGE_BYTES", 100)
    assert sorted((tuple(r) for r in m.op12_warc_zip(spark, table(spark, tmp_path, PAGES * 2)).collect()), key=str) == brute(PAGES * 2)


@pytest.mark.parametrize("few", [0, 1000])
def test_hot_payloads_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(m, "HOT_SHARE", 5)
    pages = [(i, "u", ["hot", f"twice {i // 2}", ""][i % 3 if i % 4 else 0]) for i in range(200)]
    rows = m.with_referred(spark.createDataFrame(pages, "id long, url string, payload string"), few=few)
    want = {r[0]: r[4] for r in brute(pages)}
    assert {r.id: r.refers_to for r in rows.collect()} == want


def test_least_bytes(spark):
    rows = m.with_referred(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "id long, url string, payload string"), least=3)
    assert {r.id: r.refers_to for r in rows.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_round_trip_of_payloads_over_many_archives(spark, tmp_path):
    pages = [(str(i), f"http://h/{i}", f"<html>{i}</html>" * (1 + i % 50), None) for i in range(500)]
    made = m.write_archives(spark.createDataFrame(pages, "id string, url string, payload string, refers_to string").repartition(3), f"{tmp_path}/out", most=4000)
    assert made.count() > 3
    assert made.agg(F.sum("records")).first()[0] == 500
    got = {(r.record_id, r.url, bytes(r.payload).decode()) for r in m.read_archives(made, payload=True, range_bytes=1000).collect()}
    assert got == {p[:3] for p in pages}
    for row in made.collect():  # other readers take the archives too
        with zipfile.ZipFile(row.path) as z:
            assert z.testzip() is None
            assert gzip.decompress(z.read("archive/data.warc.gz")).count(b"WARC/1.1\r\n") == row.records


def archive_bytes(records, index="indexes/index.cdxj.gz", method=zipfile.ZIP_DEFLATED, comment=b"", before=b"", members=0):
    out, data, lines = io.BytesIO(before), b"", []
    out.seek(len(before))
    for r in records:
        packed = gzip.compress(r)
        lines.append(f'com,h)/ 2024 {{"filename": "x.warc.gz", "offset": "{len(data)}", "length": "{len(packed)}"}}')
        data += packed
    with zipfile.ZipFile(out, "w") as z:
        for i in range(members):
            z.writestr(f"pages/{i}.txt", b"")
        z.writestr("archive/x.warc.gz", data)
        if index:
            body = "\n".join(lines).encode()
            z.writestr(zipfile.ZipInfo(index), gzip.compress(body) if index.endswith(".gz") else body, method)
        z.comment = comment
    return out.getvalue()


RECORDS = [m.warc_record(str(i), "http://h/", b"p%d" % i) for i in range(20)]


@pytest.mark.parametrize(
    "options",
    [{}, {"index": None}, {"index": "indexes/i.cdx", "method": zipfile.ZIP_STORED}, {"comment": b"PK\x05\x06 a comment with the mark"}, {"before": b"#!/bin/sh\n" * 9}, {"members": 70_000}],
)
def test_archives_of_other_writers(tmp_path, options):
    path = tmp_path / "a.zip"
    path.write_bytes(archive_bytes(RECORDS, **options))
    data = path.read_bytes()
    found = [m.parse_record(gzip.decompress(data[at : at + n])) for _, at, n in m.located(str(path))]
    assert [(r["record_id"], r["payload"]) for r in found] == [(str(i), b"p%d" % i) for i in range(20)]


def test_zip64_fields(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    path = tmp_path / "a.zip"
    path.write_bytes(archive_bytes(RECORDS))
    data = path.read_bytes()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert len([m.parse_record(gzip.decompress(data[at : at + n])) for _, at, n in m.located(str(path))]) == 20


def test_damage_is_an_error(tmp_path):
    record = m.warc_record("1", "u", b"payload")
    with pytest.raises(ValueError, match="damaged"):
        m.parse_record(record.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaf"))
    with pytest.raises(ValueError, match="cut short"):
        m.parse_record(record[:-12])
    (tmp_path / "x").write_bytes(b"no archive at all")
    with pytest.raises(ValueError, match="not a ZIP"):
        list(m.located(str(tmp_path / "x")))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(tuple(r) for r in m.op12_warc_zip(spark, sf).collect()) == sorted(con.sql(m.OP12_SQL).fetchall())


def test_empty(spark, tmp_path):
    assert m.op12_warc_zip(spark, table(spark, tmp_path, [])).collect() == []
