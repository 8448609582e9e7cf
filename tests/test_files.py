"""Office, PDF and image files: exact text and facts of generated files, odd and damaged ones."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftline.operators import documents as d
from siftline.operators import exif, ingest
from siftline.sources import generators as g

FACTS = {"title": "Übersicht <1>", "author": "A & B", "created": "2024-01-02T03:04:05Z", "language": "de"}


def texts():
    rng = random.Random(4)
    letters = "abc  \t&<>()\\é€ß漢\U0001f600'\"]["
    for n in (0, 1, 2, g.LINES, g.LINES + 1, 130):
        yield ["".join(rng.choices(letters, k=rng.randrange(0, 60))).strip() + "." for _ in range(n)]


@pytest.mark.parametrize("mime", [d.WORD, d.SLIDES, d.SHEETS, d.PDF])
def test_text_and_properties_come_back(mime):
    for lines in texts():
        for packed in (False, True) if mime == d.PDF else (None,):
            made = g.MAKERS[mime](lines, FACTS) if packed is None else g.pdf_file(lines, FACTS, packed)
            text, error, meta = d.read_file(made, mime)
            assert (text, error) == ("\n".join(lines), None)
            assert meta["dc:title"] == FACTS["title"] and meta["dc:creator"] == FACTS["author"] and meta["dcterms:created"] == FACTS["created"]
            if mime == d.PDF:
                assert meta["xmpTPg:NPages"] == str(max(1, -(-len(lines) // g.LINES)))
    assert d.read_file(g.word_file(["x"], {}), d.WORD)[2] == {"meta:page-count": "1"}


def pdf(body, font=b"<</Type/Font/Subtype/Type1>>", extra=b""):
    """A file without a cross-reference table, as damaged ones are."""
    return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]>>endobj 3 0 obj<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>endobj\n4 0 obj<</Length 6 0 R>>stream\n%b\nendstream endobj 5 0 obj%bendobj 6 0 obj %d endobj\n%b" % (body, font, len(body), extra)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (rb"BT /F1 9 Tf (a\(b\)\\ \101\tc(d)) Tj ET", "a(b)\\ A\tc(d)"),
        (b"BT /F1 9 Tf [(ker) -20 (ning) -300 (gap)] TJ 0 -12 Td (next) Tj (last) ' ET", "kerning gap\nnext\nlast"),
        (b"BT /F1 9 Tf 1 0 0 1 0 90 Tm (one) Tj 1 0 0 1 50 90 Tm ( same) Tj 1 0 0 1 0 80 Tm (two) Tj ET", "one same\ntwo"),
        (b"BT /F1 9 Tf <80 e9 2E> Tj ET % (no) Tj\nBI /W 1 ID \x00(x) Tj EI BT (after) Tj ET", "€é.after"),
        (b"", ""),
    ],
)
def test_content_streams(body, want):
    assert d.read_file(pdf(body), d.PDF)[:2] == (want, None)


def test_font_maps_and_later_objects():
    cmap = b"2 beginbfchar <01> <00480069> <02> <D83DDE00> endbfchar 1 beginbfrange <10> <12> [<0041> <0042> <0043>] <20> <22> <0061> endbfrange"
    extra = b"7 0 obj<</Length %d>>stream\n%b\nendstream endobj" % (len(cmap), cmap)
    made = pdf(b"BT /F1 9 Tf <0102101112202122> Tj ET", b"<</Type/Font/Subtype/Type1/ToUnicode 7 0 R>>", extra)
    assert d.read_file(made, d.PDF)[0] == "Hi\U0001f600ABCabc"
    newer = made + b"\n4 0 obj<</Length 26>>stream\nBT /F1 9 Tf <01> Tj ET    \nendstream endobj"
    assert d.read_file(newer, d.PDF)[0] == "Hi"


@pytest.mark.parametrize("mime", [d.WORD, d.SLIDES, d.SHEETS, d.PDF])
def test_damage_is_an_error_and_no_crash(mime):
    whole = g.MAKERS[mime](["some text here"] * 50, FACTS)
    rng = random.Random(6)
    for cut in (b"", b"x", whole[: len(whole) // 2], *(bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in whole) for _ in range(60))):
        text, error, meta = d.read_file(cut, mime)
        assert (text is None) == (error is not None) and isinstance(meta, dict)


def test_refused_files():
    assert d.read_file(pdf(b"", extra=b"trailer<</Root 1 0 R/Encrypt 5 0 R>>"), d.PDF)[1] == "encrypted"
    loop = b"1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[2 0 R 2 0 R]>>endobj"
    assert d.read_file(loop, d.PDF)[:2] == ("", None)


def test_a_packed_stream_that_claims_too_much_is_refused(monkeypatch):
    monkeypatch.setattr(d, "MOST_BYTES", 1000)
    big = zlib.compress(b" " * 5000)
    made = pdf(b"").replace(b"4 0 obj<</Length 6 0 R>>stream\n\nendstream", b"4 0 obj<</Length %d/Filter/FlateDecode>>stream\n%b\nendstream" % (len(big), big))
    assert d.read_file(made, d.PDF)[1] == "a stream is too large"
    assert "too large" in d.read_file(g.word_file(["long text"] * 500, {}), d.WORD)[1]


PHOTO = {271: b"Maker\0", 272: b"M 1\0", 274: 6, 306: b"2024:01:02 03:04:05\0"}
MORE = {36867: b"2023:12:31 00:00:01\0", 36868: b"2023:12:31 00:00:02\0", 37386: [(505, 10)], 37510: b"ASCII\0\0\0a note\0"}
PLACE = {1: b"S\0", 2: [(33, 1), (51, 1), (3540, 100)], 3: b"E\0", 4: [(151, 1), (12, 1), (40, 1)], 5: b"\x01", 6: [(25, 2)]}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("made", [g.jpeg_file, g.png_file])
def test_image_facts(order, made):
    got = exif.image_facts(made(640, 480, g.tiff_block(PHOTO, MORE, PLACE, order)))
    assert got == {
        "camera_make": "Maker", "camera_model": "M 1", "datetime": "2024:01:02 03:04:05", "capture_date": "2023:12:31 00:00:01", "digitised_date": "2023:12:31 00:00:02", "focal_length": "50.5", "user_comment": "a note",
        "orientation": 6, "gps_lat": round(-(33 + 51 / 60 + 35.4 / 3600), 6), "gps_lon": round(151 + 12 / 60 + 40 / 3600, 6), "gps_alt_m": -12.5, "width": 640, "height": 480,
    }


def test_odd_images():
    whole = g.jpeg_file(64, 48, g.tiff_block(PHOTO, MORE, PLACE))
    assert exif.image_facts(g.jpeg_file(64, 48)) == {"width": 64, "height": 48}
    assert exif.image_facts(b"\xff\xd8\xff\xe0")["error"] == exif.image_facts(b"GIF89a")["error"] == "undecodable image"
    zero = g.jpeg_file(5, 5, g.tiff_block(PHOTO, None, PLACE | {2: [(1, 0), (1, 1), (1, 1)]}))
    assert "gps_lat" not in exif.image_facts(zero) and exif.image_facts(zero)["gps_alt_m"] == -12.5
    rng = random.Random(8)
    for i in range(300):
        bad = bytes(b if rng.random() > 0.03 else rng.randrange(256) for b in whole[: len(whole) - i % 40])
        assert isinstance(exif.image_facts(bad), dict)


def test_files_as_rows(spark):
    rows = [(1, g.word_file(["hello"], FACTS), d.WORD), (2, g.pdf_file(["hi", "there"], {}), d.PDF), (3, b"PK nothing", d.SHEETS), (4, b"<p>page</p>", "text/html"), (5, None, d.PDF), (6, b"", d.WORD), (7, g.slides_file(["  "], {}), d.SLIDES)]
    frame = spark.createDataFrame(rows, "i int, content binary, mime string")
    found = d.extracted(frame, ingest.extract(F.col("content"), F.col("mime")))
    got = {r.i: (r.r.text, r.r.success, r.r.error) for r in found.collect()}
    assert got == {1: ("hello", True, None), 2: ("hi\nthere", True, None), 3: (None, False, "damaged container"), 4: ("page", True, None), 5: (None, False, "unsupported type"), 6: (None, False, "empty content"), 7: ("", True, None)}
    named = found.where("i = 1").withColumns(ingest.metadata_columns(F.col("meta"), F.lit("f.docx"))).first()
    assert (named.title, named.author, named.created, named.page_count) == (FACTS["title"], FACTS["author"], FACTS["created"], 1)
    facts = exif.with_image_facts(spark.createDataFrame([(1, g.png_file(3, 4)), (2, None)], "i int, content binary")).collect()
    assert facts[0].image.width == 3 and facts[0].image.error is None and facts[1].image is None


def test_ranges_of_codes_are_not_spelled_out():
    codes = d.to_unicode(b"2 beginbfchar <0041> <0061> <FFFF> <0078> endbfchar 4 beginbfrange <0000> <D7FF> <0000> <0010> <0012> [<0062> <0063>] <0041> <0043> <00410042> <0050> <0050> <0051> endbfrange")
    assert [codes.get(c) for c in (0x30, 0x10, 0x11, 0x12, 0x41, 0x43, 0x50, 0xD7FF, 0xFFFF, 0xD800)] == ["0", "b", "c", "\x12", "AB", "AD", "Q", "\ud7ff", "x", None]
    assert len(codes.known) <= 10 and codes and not d.Codes({})
