"""Facts of images from their headers: size, orientation, camera, dates and place, without decoding pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tags of the directories and the names that go by them (fixed values).
TAGS = {271: "camera_make", 272: "camera_model", 306: "datetime", 36867: "capture_date", 36868: "digitised_date", 37386: "focal_length", 37510: "user_comment"}
ORIENTATION, EXIF, GPS = 274, 34665, 34853
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
FACTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in TAGS.values()]
    + [T.StructField(n, T.IntegerType()) for n in ("width", "height", "orientation")]
    + [T.StructField(n, T.DoubleType()) for n in ("gps_lat", "gps_lon", "gps_alt_m")]
    + [T.StructField("error", T.StringType())]
)


def directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """Tags and values of a TIFF directory: texts as bytes, numbers and rationals as lists. What points outside is left out."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        p = at + 2 + 12 * i
        if p + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, p)
        size = SIZES.get(kind, 0) * count
        where = p + 8 if size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
        if not size or where + size > len(data):
            continue
        if kind in (1, 2, 7):
            out[tag] = data[where : where + size]
        elif kind in (5, 10):
            pairs = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, where)
            out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack_from(f"{order}{count}{FORMATS[kind]}", data, where))
    return out


def _said(value) -> str | None:
    if isinstance(value, bytes):
        value = value[8:] if value[:8] in (b"ASCII\0\0\0", b"UNICODE\0", bytes(8)) else value
        return value.decode("utf-8", "replace").strip("\0").strip() or None
    return None if not value or value[0] is None else str(value[0])


def _degrees(value, ref, negative: bytes) -> float | None:
    if not isinstance(value, list) or len(value) < 3 or None in value[:3]:
        return None
    out = value[0] + value[1] / 60 + value[2] / 3600
    return round(-out if isinstance(ref, bytes) and ref[:1].upper() == negative else out, 6)


def tiff_facts(data: bytes) -> dict:
    """Facts of a TIFF block as it stands in an image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return {}
    first = directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
    below = lambda tag: directory(data, first[tag][0], order) if isinstance(first.get(tag), list) else {}
    tags = first | below(EXIF)
    out = {name: _said(tags[tag]) for tag, name in TAGS.items() if tag in tags}
    if isinstance(first.get(ORIENTATION), list):
        out["orientation"] = first[ORIENTATION][0]
    place = below(GPS)
    lat, lon = _degrees(place.get(2), place.get(1), b"S"), _degrees(place.get(4), place.get(3), b"W")
    if lat is not None and lon is not None:
        out |= {"gps_lat": lat, "gps_lon": lon}
    if isinstance(place.get(6), list) and place[6][0] is not None:
        out["gps_alt_m"] = round(-place[6][0] if place.get(5, b"\0")[:1] == b"\x01" else place[6][0], 2)
    return out


def image_facts(data: bytes) -> dict:
    """Facts of a JPEG by its segments or a PNG by its chunks; `error` if the size can't be found."""
    out: dict = {}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"IHDR" and at + 16 <= len(data):
                out["width"], out["height"] = struct.unpack_from(">II", data, at + 8)
            elif kind == b"eXIf":
                out |= tiff_facts(data[at + 8 : at + 8 + size])
            at += 12 + size
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # fill bytes and marks without a body
                at += 1 if kind == 0xFF else 2
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if kind == 0xE1 and body[:6] == b"Exif\0\0":
                out |= tiff_facts(body[6:])
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            if kind in (0xDA, 0xD9):
                break
            at += 2 + size
    if not out.get("width") or not out.get("height"):
        out["error"] = "undecodable image"
    return out


def with_image_facts(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with `image`: struct of the facts of each image's bytes (null: no bytes)."""
    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("image", FACTS)])
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}
    arrow = pa.struct([(f.name, kinds[f.dataType]) for f in FACTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if not x.as_py() else image_facts(x.as_py()) for x in batch.column(names.index(content))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*names, "image"])

    return rows.mapInArrow(run, schema)
