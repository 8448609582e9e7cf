"""Natural-language queries as columns: filters, intent text and keywords, for one query or a log of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, extensions and words of the query language (fixed values).
EXACT_DATE = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b"
DATES = [
    (r"\blast\s+week\b", "last_week"),
    (r"\blast\s+month\b", "last_month"),
    (r"\blast\s+year\b", "last_year"),
    (r"\byesterday\b", "yesterday"),
    (r"\btoday\b", "today"),
]
MONTHS = [r"\bfrom\s+(\w+)\b", r"\bin\s+(\w+)\b"]
SIZES = [
    (r"greater\s+than\s+(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_gt"),
    (r"bigger\s+than\s+(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_gt"),
    (r"larger\s+than\s+(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_gt"),
    (r">\s*(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_gt"),
    (r"smaller\s+than\s+(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_lt"),
    (r"less\s+than\s+(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_lt"),
    (r"<\s*(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)", "size_lt"),
]
TYPES = [
    (r"\b(images?|pictures?|photos?)\b", "image"),
    (r"\b(videos?|movies?)\b", "video"),
    (r"\b(documents?|docs?|word\s+files?)\b", "document"),
    (r"\b(audio|music|songs?)\b", "audio"),
    (r"\b(archives?|compressed)\b", "archive"),
    (r"\b(powerpoints?|slides?|presentations?)\b", "presentation"),
    (r"\b(excel|spreadsheets?)\b", "spreadsheet"),
]
EXTENSIONS = "png jpg jpeg gif svg webp pdf csv txt rtf zip rar tar gz 7z docx xlsx pptx ppt xls mp3 wav mp4 mkv avi mov".split()
FILLER = [
    r"\b(show|get|find|search|give|bring)\s+(me|us)\b",
    r"\b(get|find|show|search)\b",
    r"\b(files?|documents?|objects?)\s+(related\s+to|about|on|for)\b",
    r"\b(related\s+to|about|on|for)\b",
]
STOPWORDS = """the a an all some any every each i me my we our you your find get show display list retrieve
files file documents document objects object that which what where when how why can could would should may
might must want need like love hate please kindly thanks thank""".split()

KNOWN = r"\b(" + "|".join(EXTENSIONS) + r")s?\b"
DOTTED = r"\.(\w+)\b"


def _compact(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def date_filters(query: Column, year: int) -> Column:
    """exact_date of the first calendar day, date: of each relative period, month: of each 'from' or 'in' word."""
    pattern = "(?i)" + EXACT_DATE
    part = lambda g: F.regexp_extract(query, pattern, g)
    exact = F.when(part(1) != "", F.concat(F.lit("exact_date:"), F.concat_ws("_", F.lower(part(1)), part(2), F.coalesce(F.nullif(part(3), F.lit("")), F.lit(str(year))))))
    relative = [F.when(query.rlike("(?i)" + p), F.lit(f"date:{name}")) for p, name in DATES]
    months = [F.when(F.regexp_extract(query, "(?i)" + p, 1) != "", F.concat(F.lit("month:"), F.lower(F.regexp_extract(query, "(?i)" + p, 1)))) for p in MONTHS]
    return _compact(exact, *relative, *months)


def size_filters(query: Column) -> Column:
    return _compact(*[F.when(query.rlike("(?i)" + p), F.concat(F.lit(f"size:{way}:"), F.regexp_extract(query, "(?i)" + p, 1), F.upper(F.regexp_extract(query, "(?i)" + p, 2)))) for p, way in SIZES])


def type_filters(query: Column) -> Column:
    return _compact(*[F.when(query.rlike("(?i)" + p), F.lit(f"type:{name}")) for p, name in TYPES])


def extension_filters(query: Column) -> Column:
    found = F.concat(F.regexp_extract_all(query, F.lit("(?i)" + KNOWN), F.lit(1)), F.regexp_extract_all(query, F.lit(DOTTED), F.lit(1)))
    return F.transform(found, lambda x: F.concat(F.lit("extension:"), F.lower(x)))


def intent_text(query: Column) -> Column:
    """What is left without filter phrases, filler and stop words."""
    text = query
    for pattern in [EXACT_DATE, *[p for p, _ in DATES], *MONTHS, *[p for p, _ in SIZES], *[p for p, _ in TYPES], KNOWN, DOTTED]:
        text = F.regexp_replace(text, "(?i)" + pattern, " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern in FILLER:
        text = F.regexp_replace(text, "(?i)" + pattern, " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: (w != "") & ~F.lower(w).isin(STOPWORDS))
    return F.array_join(words, " ")


def parse(queries: DataFrame, year: int, column: str = "query") -> DataFrame:
    """queries with intent_text, keywords (longer than two characters) and filters (distinct; types and extensions sorted)."""
    clean = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    out = queries.withColumn("intent_text", intent_text(clean))
    kinds = F.array_sort(F.array_distinct(F.concat(type_filters(clean), extension_filters(clean))))
    return out.withColumns({"keywords": F.filter(F.split("intent_text", " "), lambda w: F.length(w) > 2), "filters": F.concat(date_filters(clean, year), size_filters(clean), kinds)})
