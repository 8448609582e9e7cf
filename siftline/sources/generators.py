"""Files made from rows: office documents, PDFs and photos with known contents, for round trips through the readers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftline.operators.documents import PDF, SHEETS, SLIDES, WORD

#: Lines on a page or slide.
LINES = 40


def _office(parts: dict[str, str], facts: dict[str, str], counted: str) -> bytes:
    core = "".join(f"<{tag}>{escape(facts[k])}</{tag}>" for k, tag in (("title", "dc:title"), ("author", "dc:creator"), ("created", "dcterms:created"), ("language", "dc:language")) if facts.get(k))
    parts = parts | {
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="urn:core" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">{core}</cp:coreProperties>',
        "docProps/app.xml": f'<Properties xmlns="urn:app">{counted}</Properties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def _runs(line: str, p: str) -> str:
    """A line as runs; tabs are marks of their own."""
    return f"<{p}:p>" + f"<{p}:r><{p}:tab/></{p}:r>".join(f'<{p}:r><{p}:t xml:space="preserve">{escape(x)}</{p}:t></{p}:r>' for x in line.split("\t")) + f"</{p}:p>"


def word_file(lines: list[str], facts: dict[str, str]) -> bytes:
    body = "".join(_runs(x, "w") for x in lines)
    return _office({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'}, facts, f"<Pages>{1 + len(lines) // LINES}</Pages>")


def slides_file(lines: list[str], facts: dict[str, str]) -> bytes:
    slides = [lines[a : a + LINES] for a in range(0, len(lines), LINES)] or [[]]
    parts = {f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:txBody>{"".join(_runs(x, "a") for x in s)}</a:txBody></p:sld>' for i, s in enumerate(slides, 1)}
    return _office(parts, facts, f"<Slides>{len(slides)}</Slides>")


def sheets_file(lines: list[str], facts: dict[str, str]) -> bytes:
    """Cells between tabs; every other cell is a shared string, the others are inline."""
    shared: dict[str, int] = {}
    rows = []
    for i, line in enumerate(lines):
        cells = []
        for j, x in enumerate(line.split("\t")):
            if (i + j) % 2:
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>')
            else:
                cells.append(f'<c t="s"><v>{shared.setdefault(x, len(shared))}</v></c>')
        rows.append(f"<row>{''.join(cells)}</row>")
    strings = "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in shared)
    parts = {"xl/sharedStrings.xml": f'<sst xmlns="urn:x">{strings}</sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="urn:x"><sheetData>{"".join(rows)}</sheetData></worksheet>'}
    return _office(parts, facts, "")


CMAP = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0000> <D7FF> <0000> <D800> <FFFF> <D800> endbfrange end"


def pdf_file(lines: list[str], facts: dict[str, str], packed: bool = False) -> bytes:
    """Pages of lines in a two-byte font; packed: objects in streams and a cross-reference stream, else a plain table."""
    said = lambda t: b"<" + (b"\xfe\xff" + t.encode("utf-16-be")).hex().encode() + b">"
    pages = [lines[a : a + LINES] for a in range(0, len(lines), LINES)] or [[]]
    flat = lambda data, extra=b"": b"<</Length %d/Filter/FlateDecode%b>>\nstream\n%b\nendstream" % (len(z := zlib.compress(data)), extra, z)
    objects: dict[int, bytes] = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>", 4: flat(CMAP)}
    objects[2] = b"<</Type/Pages/Count %d/Resources<</Font<</F1 3 0 R>>>>/Kids[%b]>>" % (len(pages), b" ".join(b"%d 0 R" % (6 + 2 * i) for i in range(len(pages))))
    objects[5] = b"<<" + b"".join(b"/%b %b" % (tag, said(facts[k])) for k, tag in (("title", b"Title"), ("author", b"Author"), ("created", b"CreationDate")) if facts.get(k)) + b">>"
    for i, page in enumerate(pages):
        shown = b" T*\n".join(b"<%b> Tj" % x.encode("utf-16-be").hex().encode() for x in page)
        objects |= {6 + 2 * i: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (7 + 2 * i), 7 + 2 * i: flat(b"BT /F1 12 Tf 14 TL\n" + shown + b" ET")}
    out, places = bytearray(b"%PDF-1.5\n"), {}
    inside = [n for n, o in sorted(objects.items()) if packed and b"stream" not in o]
    if packed:
        at, head, body = 0, b"", b""
        for n in inside:
            head += b"%d %d " % (n, len(body))
            body += objects.pop(n) + b" "
        box = max(max(objects), *inside) + 1
        objects[box] = flat(head + body, b"/Type/ObjStm/N %d/First %d" % (len(inside), len(head)))
    for n, o in sorted(objects.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, o)
    at, size = len(out), max([*places, *inside]) + 1
    if packed:
        places[size] = at
        rows = b"".join(struct.pack(">BIB", 2, box, inside.index(n)) if n in inside else struct.pack(">BIB", 1, places[n], 0) if n in places else bytes(6) for n in range(size + 1))
        # rows as differences to the row above
        coded = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[i : i + 6], rows[i - 6 : i] if i else bytes(6), strict=True)) for i in range(0, len(rows), 6))
        out += b"%d 0 obj\n%b\nendobj\n" % (size, flat(coded, b"/Type/XRef/Size %d/W[1 4 1]/Root 1 0 R/Info 5 0 R/DecodeParms<</Predictor 12/Columns 6>>" % (size + 1)))
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, size))
        out += b"trailer\n<</Size %d/Root 1 0 R/Info 5 0 R>>\n" % size
    return bytes(out + b"startxref\n%d\n%%%%EOF" % at)


def tiff_block(tags: dict[int, bytes | int | list], exif: dict | None = None, gps: dict | None = None, order: str = "<") -> bytes:
    """A TIFF block of texts, short numbers, and lists of pairs as rationals."""

    def packed(entries: dict, at: int) -> bytes:
        head, extra = struct.pack(order + "H", len(entries)), b""
        behind = at + 2 + 12 * len(entries) + 4
        for tag, v in sorted(entries.items()):
            if isinstance(v, bytes):
                kind, n, body = (1 if len(v) == 1 else 2), len(v), v
            elif isinstance(v, list):
                kind, n, body = 5, len(v), b"".join(struct.pack(order + "II", *p) for p in v)
            else:
                kind, n, body = (4, 1, struct.pack(order + "I", v)) if tag in (34665, 34853) else (3, 1, struct.pack(order + "H", v))
            if len(body) <= 4:
                head += struct.pack(order + "HHI", tag, kind, n) + body.ljust(4, b"\0")
            else:
                head += struct.pack(order + "HHII", tag, kind, n, behind + len(extra))
                extra += body
        return head + bytes(4) + extra

    tags = dict(tags)
    below = [(tag, part) for tag, part in ((34665, exif), (34853, gps)) if part]
    tags |= {tag: 0 for tag, _ in below}
    at, blocks = 8 + len(packed(tags, 8)), b""
    for tag, part in below:
        tags[tag] = at + len(blocks)
        blocks += packed(part, at + len(blocks))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + packed(tags, 8) + blocks


def jpeg_file(width: int, height: int, block: bytes = b"") -> bytes:
    """The segments of a photo: facts and size, no pixels."""
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += segment(0xE1, b"Exif\0\0" + block) if block else b""
    return out + segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + segment(0xDA, b"\1\1\0\0\x3f\0") + b"\0\xff\xd9"


def png_file(width: int, height: int, block: bytes = b"") -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + (chunk(b"eXIf", block) if block else b"") + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


MAKERS = {WORD: word_file, SLIDES: slides_file, SHEETS: sheets_file, PDF: pdf_file}


def office_files(rows: DataFrame) -> DataFrame:
    """rows (text, mime, title, author, created, language) with `content`: a file of that type that holds them."""
    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                r = one.to_pylist()[0]
                made = MAKERS[r["mime"]]((r["text"] or "").split("\n"), {k: r.get(k) or "" for k in ("title", "author", "created", "language")})
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([made], pa.binary())], names=[*names, "content"])

    return rows.mapInArrow(run, schema)


def photos(rows: DataFrame) -> DataFrame:
    """rows (width, height, orientation, make, model, taken, lat, lon: seconds of arc, alt: metres) with `content`: a JPEG whose header says so."""
    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("content", T.BinaryType())])
    angle = lambda s: [(abs(s) // 3600, 1), (abs(s) // 60 % 60, 1), (abs(s) % 60, 1)]

    def made(r: dict) -> bytes:
        tags = {274: r["orientation"]} | {tag: r[k].encode() + b"\0" for tag, k in ((271, "make"), (272, "model")) if r[k]}
        place = {1: b"S\0" if r["lat"] < 0 else b"N\0", 2: angle(r["lat"]), 3: b"W\0" if r["lon"] < 0 else b"E\0", 4: angle(r["lon"]), 5: b"\x01" if r["alt"] < 0 else b"\0", 6: [(abs(r["alt"]), 1)]} if r["lat"] is not None else None
        return jpeg_file(r["width"], r["height"], tiff_block(tags, {36867: r["taken"].encode() + b"\0"} if r["taken"] else None, place, "<" if r["orientation"] % 2 else ">"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([made(r) for r in batch.to_pylist()], pa.binary())], names=[*names, "content"])

    return rows.mapInArrow(run, schema)
