"""Filter strings and builder arguments as predicates over the chunk table; clauses combine by AND."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import size_bytes

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WINDOWS = {"last_week": 7, "last_month": 30, "last_year": 365, "yesterday": 1, "today": 1}


def date_range(key: str, now: datetime) -> tuple[datetime, datetime]:
    """Days before now up to now; unknown keys mean a week."""
    return now - timedelta(days=WINDOWS.get(key, 7)), now


def of_type(name: str) -> Column:
    mime, extension = F.col("mime_type"), F.col("extension")
    match name:
        case "pdf":
            return extension == "pdf"
        case "document":
            return mime.startswith("application/")
        case "presentation":
            return extension.isin("ppt", "pptx") | mime.startswith("application/vnd.ms-powerpoint")
        case "spreadsheet":
            return extension.isin("xls", "xlsx", "csv") | mime.startswith("application/vnd.ms-excel")
        case "image":
            return mime.startswith("image/")
        case _:
            return mime.startswith(name)


def on_day(text: str, zone: str) -> Column:
    """One calendar day in a zone, half open; nothing for a day that doesn't exist; an unknown month is January."""
    month, day, year = (text.split("_") + ["", ""])[:3]
    number = MONTHS.index(month[:3]) + 1 if month[:3] in MONTHS else 1
    try:
        start = datetime(int(year), number, int(day))
    except ValueError:
        return F.lit(False)
    at = lambda t: F.to_utc_timestamp(F.lit(t), zone)
    return (F.col("uploaded_at") >= at(start)) & (F.col("uploaded_at") < at(start + timedelta(days=1)))


def clause(text: str, now: datetime, zone: str = "UTC") -> Column | None:
    """The predicate of one filter string, or None where it asks for nothing."""
    kind, _, value = text.partition(":")
    if kind == "extension":
        return F.col("extension") == value
    if kind == "type":
        return of_type(value)
    if kind == "size":
        way, _, literal = value.partition(":")
        limit = size_bytes(F.lit(literal))
        if way not in ("size_gt", "size_lt"):
            return None
        compared = F.col("size_bytes") > limit if way == "size_gt" else F.col("size_bytes") < limit
        return F.coalesce(compared, F.lit(True))
    if kind == "date":
        start, end = date_range(value, now)
        return F.col("uploaded_at").between(F.lit(start), F.lit(end))
    if kind == "exact_date":
        return on_day(value, zone)
    return None


def all_of(filters: list[str], now: datetime, zone: str = "UTC") -> Column:
    out = F.lit(True)
    for text in filters:
        found = clause(text, now, zone)
        if found is not None:
            out = out & found
    return out


def builder_filter(extension: str | None = None, bucket: str | None = None, owner: str | None = None, tags: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, buckets: list[str] | None = None) -> Column:
    """The keyword arguments of a library search; without any, everything. `buckets` limits to what a caller may read."""
    out = F.lit(True)
    if extension:
        out = out & (F.col("extension") == extension.lower().lstrip("."))
    if bucket:
        out = out & (F.col("bucket") == bucket)
    if owner:
        out = out & (F.col("owner") == owner)
    if tags:
        out = out & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if date_from:
        out = out & (F.col("uploaded_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        out = out & (F.col("uploaded_at") <= F.lit(date_to).cast("timestamp"))
    if buckets is not None:
        out = out & F.col("bucket").isin(*buckets)
    return out


def exact(**values: str) -> Column:
    """Rows whose fields equal the values as they stand: no analysis, no case folding."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def project(hits: DataFrame, include: list[str] | None = None, exclude: list[str] = ("embedding",)) -> DataFrame:
    """hits with the wanted fields that they have, without the excluded ones; by default all but vectors."""
    names = [c for c in hits.columns if (include is None or c in include) and c not in exclude]
    return hits.select(*names)
