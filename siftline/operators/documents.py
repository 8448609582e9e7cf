"""Text and properties of office and PDF files, read from their bytes where the rows are.

Office files are ZIP containers of XML parts: paragraphs of a text document, of slides in order, rows of sheets. PDF
files are read by their cross-reference tables and streams (or a scan for objects where those are damaged), object
streams, page tree and content streams; codes become characters by each font's ToUnicode map, else as Windows-1252.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unpacked bytes of a part or stream, at most: what claims more is refused.
MOST_BYTES = 256 << 20

WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SLIDES = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
SHEETS = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PDF = "application/pdf"
# Properties of office files and the names that metadata goes by (fixed values).
CORE = {"title": "dc:title", "creator": "dc:creator", "created": "dcterms:created", "language": "language"}
APP = {"Pages": "meta:page-count", "Slides": "meta:page-count"}
INFO = {"Title": "dc:title", "Author": "dc:creator", "CreationDate": "dcterms:created"}


class Unreadable(ValueError):
    """A file that is damaged, encrypted or too large to unpack."""


# ---- office files ------------------------------------------------------------------------------------


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


class _Parts:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise Unreadable("damaged container") from e

    def numbered(self, pattern: str) -> list[str]:
        """Names of parts in order of their number."""
        found = [(int(m[1]), n) for n in self.zip.namelist() if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]

    def tree(self, name: str) -> ElementTree.Element | None:
        if name not in self.zip.namelist():
            return None
        if self.zip.getinfo(name).file_size > MOST_BYTES:
            raise Unreadable("a part is too large")
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error) as e:
            raise Unreadable(f"damaged part {name}") from e


def _paragraphs(root: ElementTree.Element | None) -> Iterator[str]:
    """Texts of the paragraphs of a text document or a slide; tabs and line breaks as such."""
    for p in root.iter() if root is not None else ():
        if _name(p.tag) == "p":
            out = []
            for x in p.iter():
                kind = _name(x.tag)
                out.append(x.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "")
            yield "".join(out)


def _rows(parts: _Parts) -> Iterator[str]:
    """Rows of all sheets in order, cells between tabs."""
    strings = parts.tree("xl/sharedStrings.xml")
    shared = [] if strings is None else ["".join(t.text or "" for t in s.iter() if _name(t.tag) == "t") for s in strings if _name(s.tag) == "si"]
    for name in parts.numbered(r"xl/worksheets/sheet(\d+)\.xml"):
        for row in parts.tree(name).iter():
            if _name(row.tag) == "row":
                cells = []
                for c in (c for c in row if _name(c.tag) == "c"):
                    inside = "".join(t.text or "" for t in c.iter() if _name(t.tag) in ("v", "t"))
                    cells.append(shared[int(inside)] if c.get("t") == "s" and inside else inside)
                yield "\t".join(cells)


def office_text(content: bytes, mime: str) -> tuple[str, dict[str, str]]:
    """Text and properties of a text document, slides or sheets."""
    parts = _Parts(content)
    if mime == WORD:
        if (body := parts.tree("word/document.xml")) is None:
            raise Unreadable("no document part")
        text = "\n".join(_paragraphs(body))
    elif mime == SLIDES:
        text = "\n".join(p for n in parts.numbered(r"ppt/slides/slide(\d+)\.xml") for p in _paragraphs(parts.tree(n)))
    else:
        text = "\n".join(_rows(parts))
    meta = {}
    for part, names in (("docProps/core.xml", CORE), ("docProps/app.xml", APP)):
        tree = parts.tree(part)
        for x in () if tree is None else tree:
            if _name(x.tag) in names and x.text:
                meta[names[_name(x.tag)]] = x.text
    return text, meta


# ---- PDF ---------------------------------------------------------------------------------------------


class Name(str):
    """/Name"""


class Ref(tuple):
    """number, generation"""


TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|.)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c", b"\n": b""}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in round brackets from behind the first one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            c = data[at : at + 1]
            at += 1 + (data[at : at + 2] == b"\r\n")
            out += ESCAPES.get(c, b"" if c == b"\r" else c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _value(data: bytes, at: int):
    """The object at a place, and the place behind it; an operator or a closing mark as bytes."""
    m = TOKEN.match(data, at)
    if not m:
        return None, len(data)
    t, at = m[1], m.end()
    if t == b"(":
        return _string(data, at)
    if t == b"<<" or t == b"[":
        items = []
        while True:
            x, at = _value(data, at)
            if at >= len(data) and x is None or isinstance(x, _Mark) and x in (b">>", b"]"):
                break
            if isinstance(x, _Mark) and x == b"R" and len(items) >= 2:
                items[-2:] = [Ref(items[-2:])]
            else:
                items.append(x)
        return (dict(zip(items[::2], items[1::2], strict=False)) if t == b"<<" else items), at
    if t[:1] == b"<":
        digits = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if t[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1")), at
    if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
        return (float(t) if b"." in t else int(t)), at
    return {b"true": True, b"false": False, b"null": None}.get(t, _Mark(t)), at


class _Mark(bytes):
    """An operator, or a closing bracket."""


class PdfFile:
    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.trailer, self.cache = data, {}, {}, {}, {}
        try:
            self._references()
        except (Unreadable, ValueError, IndexError, KeyError, TypeError, zlib.error):
            self.places = {}
        if "Root" not in self.trailer or not isinstance(self.get(self.trailer["Root"]), dict):
            self._scan()
        if "Encrypt" in self.trailer:
            raise Unreadable("encrypted")

    def _references(self) -> None:
        at, seen = int(re.findall(rb"startxref\s+(\d+)", self.data)[-1]), set()
        waiting = [at]
        while waiting:
            at = waiting.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if m := re.compile(rb"\s*xref\s*").match(self.data, at):
                at = m.end()
                while m := re.compile(rb"(\d+)\s+(\d+)\s*?\r?\n?\s*(?=\d{10} \d{5} [nf])").match(self.data, at):
                    first, count = int(m[1]), int(m[2])
                    at = m.end()
                    for i in range(count):
                        line = re.compile(rb"(\d{10}) (\d{5}) ([nf])\s*").match(self.data, at)
                        if line[3] == b"n":
                            self.places.setdefault(first + i, int(line[1]))
                        at = line.end()
                trailer, _ = _value(self.data, self.data.index(b"trailer", at) + 7)
            else:
                trailer, body = self._object_at(at)
                rows = self._unpacked(trailer, body)
                widths, index = trailer["W"], trailer.get("Index", [0, trailer["Size"]])
                p = 0
                for first, count in zip(index[::2], index[1::2], strict=True):
                    for i in range(count):
                        fields = []
                        for w in widths:
                            fields.append(int.from_bytes(rows[p : p + w], "big") if w else 1)
                            p += w
                        if fields[0] == 1:
                            self.places.setdefault(first + i, fields[1])
                        elif fields[0] == 2 and first + i not in self.places:
                            self.packed.setdefault(first + i, fields[1])
            self.trailer = trailer | self.trailer
            waiting += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _scan(self) -> None:
        """Objects and trailers by their looks; later ones count."""
        self.cache, self.packed = {}, {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b", self.data):
            self.places[int(m[1])] = m.start()
        for m in re.finditer(rb"trailer", self.data):
            found, _ = _value(self.data, m.end())
            self.trailer |= found if isinstance(found, dict) else {}
        for number in list(self.places):
            found = self.get(Ref((number, 0)))
            if isinstance(found, dict) and found.get("Type") == "ObjStm":
                first = self._unpacked(found, self._object_at(self.places[number])[1])[: found["First"]].split()
                self.packed |= {int(n): number for n in first[::2] if int(n) not in self.places}
            if isinstance(found, dict) and found.get("Type") in ("Catalog", "XRef"):
                self.trailer |= {"Root": Ref((number, 0))} if found["Type"] == "Catalog" else {k: v for k, v in found.items() if k in ("Root", "Info", "Encrypt")}
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise Unreadable("no catalogue")

    def _object_at(self, at: int):
        """An object and, if it is a stream, its bytes."""
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not m:
            raise Unreadable("no object where one is said to be")
        found, at = _value(self.data, m.end())
        if isinstance(found, dict) and (m := re.compile(rb"\s*stream\r?\n").match(self.data, at)):
            length = self.get(found.get("Length"))
            end = m.end() + length if isinstance(length, int) else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                end = self.data.index(b"endstream", m.end())
            return found, self.data[m.end() : end]
        return found, None

    def _unpacked(self, facts: dict, body: bytes) -> bytes:
        filters = self.get(facts.get("Filter")) or []
        if isinstance(filters, Name):
            filters = [filters]
        parms = self.get(facts.get("DecodeParms")) or {}
        for f in filters:
            if f == "ASCIIHexDecode":
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body.partition(b">")[0]).decode())
            elif f == "FlateDecode":
                unpacker = zlib.decompressobj()
                body = unpacker.decompress(body, MOST_BYTES)
                if unpacker.unconsumed_tail:
                    raise Unreadable("a stream is too large")
            else:
                raise Unreadable(f"stream filter {f}")
        parms = parms[0] if isinstance(parms, list) and parms else parms
        if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
            body = _unpredicted(body, parms.get("Columns", 1) * parms.get("Colors", 1))
        return body

    def get(self, x):
        """The object behind a reference, or the object itself."""
        if not isinstance(x, Ref):
            return x
        number = x[0]
        if number not in self.cache:
            self.cache[number] = None  # a reference to itself ends here
            if number in self.places:
                self.cache[number] = self._object_at(self.places[number])[0]
            elif number in self.packed:
                facts, body = self._object_at(self.places[self.packed[number]])
                body = self._unpacked(facts, body)
                head = list(map(int, body[: facts["First"]].split()))
                for n, at in zip(head[::2], head[1::2], strict=True):
                    if self.packed.get(n) == self.packed[number]:
                        self.cache[n] = _value(body, facts["First"] + at)[0]
        return self.cache[number]

    def stream(self, x) -> bytes:
        if not isinstance(x, Ref) or x[0] not in self.places:
            return b""
        facts, body = self._object_at(self.places[x[0]])
        return self._unpacked(facts, body) if body is not None else b""

    def pages(self) -> Iterator[dict]:
        """Page objects in order, with the resources that they inherit."""
        waiting, seen = [(self.get(self.trailer["Root"]).get("Pages"), {})], set()
        while waiting:
            ref, above = waiting.pop(0)
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else id(ref))
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            kids = self.get(node.get("Kids"))
            if kids is not None:
                waiting = [(k, own) for k in kids] + waiting
            else:
                yield own | node

    def decoder(self, font) -> tuple[int, Codes]:
        """Bytes of a code and the characters of codes of a font."""
        font = self.get(font) or {}
        codes = to_unicode(self.stream(font.get("ToUnicode"))) if "ToUnicode" in font else Codes({})
        return 2 if font.get("Subtype") == "Type0" else 1, codes

    def page_text(self, page: dict) -> str:
        contents = page.get("Contents")
        parts = self.get(contents)
        data = b"\n".join(self.stream(p) for p in parts) if isinstance(parts, list) else self.stream(contents)
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        decoders = {name: self.decoder(font) for name, font in fonts.items()}
        return "".join(_shown(data, decoders))

    def text(self) -> tuple[str, dict[str, str]]:
        pages = [self.page_text(p) for p in self.pages()]
        info = self.get(self.trailer.get("Info")) or {}
        meta = {INFO[k]: plain(self.get(v)) for k, v in info.items() if k in INFO and isinstance(self.get(v), bytes)}
        return "\n".join(pages), meta | {"xmpTPg:NPages": str(len(pages))}


def plain(text: bytes) -> str:
    """A string of a PDF's facts."""
    return text[2:].decode("utf-16-be", "replace") if text[:2] == b"\xfe\xff" else text.decode("cp1252", "replace")


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of PNG predictors undone, for rows of one byte a column."""
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 4:
                guess = left + up - corner
                best = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                best = (0, left, up, (left + up) // 2)[kind]
            row[i] = (row[i] + best) & 255
        out += row
        above = bytes(row) + bytes(columns - len(row))
    return bytes(out)


class Codes:
    """Characters of codes. Ranges stay ranges until one of their codes is asked for: a map of all 65,536 codes is a single line of a file."""

    def __init__(self, single: dict[int, str]):
        self.single, self.ranges, self.known = single, [], {}

    def add(self, first: int, last: int, char: Callable[[int], str]) -> None:
        """Codes from first to last, char(i) being that of first + i; what was added later counts."""
        self.ranges.append((first, last, char))

    def __bool__(self) -> bool:
        return bool(self.single or self.ranges)

    def get(self, code: int, default: str | None = None) -> str | None:
        if code not in self.known:
            found = next((char(code - first) for first, last, char in reversed(self.ranges) if first <= code <= last), None)
            self.known[code] = self.single.get(code) if found is None else found
        found = self.known[code]
        return default if found is None else found


def to_unicode(data: bytes) -> Codes:
    """Characters of codes, from a ToUnicode map."""
    hexed = lambda h: int(h, 16)
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    single: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        single |= {hexed(a): text(b) for a, b in re.findall(rb"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f\s]+)\s*>", part)}
    out = Codes(single)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c, each in re.findall(rb"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*(?:<\s*([0-9A-Fa-f]+)\s*>|\[(.*?)\])", part, re.S):
            first = hexed(a)
            last = min(hexed(b), first + 0xFFFF)
            if each:
                listed = [text(h) for h in re.findall(rb"<([0-9A-Fa-f\s]+)>", each)]
                out.add(first, min(last, first + len(listed) - 1), listed.__getitem__)
            elif c and len(c) <= 4:  # the last unit counts up; halves of pairs stay halves until they are joined
                out.add(first, last, lambda i, start=hexed(c): chr(start + i))
            elif c:
                out.add(first, last, lambda i, start=text(c): start[:-1] + chr(ord(start[-1]) + i))
    return out


def _shown(data: bytes, decoders: dict[str, tuple[int, Codes]]) -> Iterator[str]:
    """What a content stream shows; moves to another line are line ends, wide gaps are blanks."""
    width, codes = 1, {}
    stack: list = []
    at, height = 0, None

    def said(raw: bytes) -> str:
        if not codes and width == 1:
            return raw.decode("cp1252", "replace")
        out = "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
        return out.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")

    # line ends wait for the text behind them: moves before the first and behind the last show nothing
    begun, ends = False, 0
    while at < len(data):
        x, at = _value(data, at)
        if not isinstance(x, _Mark):
            stack.append(x)
            continue
        last = stack[-1] if stack else None
        if x == b"Tf" and len(stack) >= 2:
            width, codes = decoders.get(stack[-2], (1, {}))
        elif x == b"T*" or x in (b"Td", b"TD") and len(stack) >= 2 and last:
            ends += 1
        elif x == b"Tm" and len(stack) >= 6:
            ends += height is not None and last != height
            height = last
        elif x in (b"Tj", b"'", b'"', b"TJ") and isinstance(last, (bytes, list)):
            ends += x in (b"'", b'"')
            yield "\n" * ends * begun
            begun, ends = True, 0
            for part in last if isinstance(last, list) else [last]:
                yield said(part) if isinstance(part, bytes) else " " if isinstance(part, (int, float)) and part < -200 else ""
        elif x == b"ID":  # an image inside the stream
            m = re.compile(rb"\sEI\s").search(data, at)
            at = m.end() if m else len(data)
        stack = []


def pdf_text(content: bytes) -> tuple[str, dict[str, str]]:
    return PdfFile(content).text()


# ---- rows --------------------------------------------------------------------------------------------

READERS = {WORD, SLIDES, SHEETS, PDF}
#: What the parts of a damaged file may raise.
DAMAGE = (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError, NotImplementedError, RuntimeError, EOFError, OSError, OverflowError, struct.error, zlib.error, lzma.LZMAError, zipfile.BadZipFile, ElementTree.ParseError)


def read_file(content: bytes, mime: str) -> tuple[str | None, str | None, dict[str, str]]:
    """Text, error and properties of an office or PDF file."""
    try:
        text, meta = pdf_text(content) if mime == PDF else office_text(content, mime)
        return text, None, meta
    except Unreadable as e:
        return None, str(e), {}
    except DAMAGE as e:
        return None, f"damaged file ({type(e).__name__})", {}


def extract_files(rows: DataFrame, content: str = "content", mime: str = "mime") -> DataFrame:
    """rows with `found`: struct(text, error, meta) of office and PDF files, null for others. A file is read by itself, so a batch needs no more memory than its files."""
    names = rows.columns
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
    schema = T.StructType([*rows.schema, T.StructField("found", kind)])
    arrow = pa.struct([("text", pa.string()), ("error", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, kinds = batch.column(names.index(content)), batch.column(names.index(mime))
            for i in range(batch.num_rows):
                found = None
                if kinds[i].as_py() in READERS and data[i].as_py():
                    text, error, meta = read_file(data[i].as_py(), kinds[i].as_py())
                    found = {"text": text, "error": error, "meta": list(meta.items())}
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([found], arrow)], names=[*names, "found"])

    return rows.mapInArrow(run, schema)


def extracted(rows: DataFrame, plain_result) -> DataFrame:
    """rows (content, mime) with `r`: struct(text, success, error) and `meta` of any type: office and PDF files by their readers, others as plain_result (such a struct) says."""
    out = extract_files(rows)
    error = F.coalesce("found.error", F.when(F.trim(F.coalesce("found.text", F.lit(""))) == "", F.lit(None).cast("string")))
    own = F.struct(F.when(error.isNull(), F.trim("found.text")).alias("text"), error.isNull().alias("success"), error.alias("error"))
    return out.withColumn("r", F.when(F.col("found").isNotNull(), own).otherwise(plain_result)).withColumn("meta", F.coalesce("found.meta", F.create_map().cast("map<string,string>"))).drop("found")
