"""Image checks, geometry, places and captions as columns; pixel work is optional."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.config import IngestConfig


def validation_error(content: Column, mime: Column, config: IngestConfig = IngestConfig()) -> Column:
    """The first thing wrong with an image, or null."""
    n = F.length(content)
    head = F.hex(F.substring(content, 1, 8))
    return F.when(n.isNull() | (n == 0), "empty image").when(~mime.isin("image/jpeg", "image/png"), "unsupported image type").when(n > config.max_image_bytes, "image too large").when(~(head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A")), "undecodable image")


def centre_crop(width: Column, height: Column) -> Column:
    """struct(left, top, side) of the middle square."""
    side = F.least(width, height)
    return F.struct(F.floor((width - side) / 2).cast("int").alias("left"), F.floor((height - side) / 2).cast("int").alias("top"), side.cast("int").alias("side"))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.round(F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value), 6)


def caption(filename: Column, width: Column, height: Column, mime: Column, make: Column, model: Column, date: Column, lat: Column, lon: Column, comment: Column) -> Column:
    """The searchable sentence of an image; parts without data are left out."""
    camera = F.trim(F.concat_ws(" ", F.nullif(make, F.lit("")), F.nullif(model, F.lit(""))))
    place = F.format_string("Location: %.4f°%s, %.4f°%s.", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))
    said = lambda c: c.isNotNull() & (c != "")
    return F.concat_ws(
        " ",
        F.concat(F.lit("Image: "), filename, F.lit(" ("), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" pixels, "), mime, F.lit(")")),
        F.when(camera != "", F.concat(F.lit("Camera: "), camera, F.lit("."))),
        F.when(said(date), F.concat(F.lit("Date: "), date, F.lit("."))),
        F.when(lat.isNotNull() & lon.isNotNull(), place),
        F.when(said(comment), F.concat(F.lit("Comment: "), comment, F.lit("."))),
    )
