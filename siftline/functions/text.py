"""Column functions shared by index and query side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters, digits and underscores.
BREAKS = r"[^\p{L}\p{N}_]+"
# English stop words of the file-name analyzer (fixed values).
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def analyze(text: Column, analyzer: str = "standard") -> Column:
    """Terms of a text: lower-cased words; the file-name analyzer also folds accents and drops stop words."""
    words = F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")
    if analyzer == "filename":
        plain, accented = "aaaaaaceeeeiiiinooooouuuuyy", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
        words = F.filter(F.transform(words, lambda w: F.translate(w, accented, plain)), lambda w: ~w.isin(STOP))
    return words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    # the array and its length are bound once, not made again for each component
    def unit(bound: Column) -> Column:
        scaled = lambda v, length: F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
        return F.transform(F.array(norm(bound)), lambda length: scaled(bound, length))[0]

    return F.transform(F.array(a), unit)[0]


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def size_bytes(literal: Column) -> Column:
    """Bytes of '2.5MB', '10 KB' or '512'; null for anything else."""
    text = F.upper(F.trim(literal))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)?$", 1)
    unit = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB)?$", 2)
    factor = F.when(unit == "KB", 1024).when(unit == "MB", 1024**2).when(unit == "GB", 1024**3).when(unit == "TB", 1024**4).otherwise(1)
    bare = (unit == "") & number.contains(".")
    return F.when((number != "") & ~bare, F.floor(number.cast("double") * factor).cast("long"))


def human_size(n: Column) -> Column:
    """B, KB or MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", n / F.lit(1024.0))).otherwise(F.format_string("%.1f MB", n / F.lit(1048576.0)))


def from_millis(n: Column) -> Column:
    """The time so many milliseconds after 1970."""
    return F.timestamp_millis(n)


def year_of(at: Column) -> Column:
    """A year in four digits, or in as many as it has beyond them, without a plus sign."""
    year = F.year(at)
    return F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))


def full_time(at: Column) -> Column:
    """A time as '2024-01-05 09:30:00'."""
    return F.concat(year_of(at), F.date_format(at, "-MM-dd HH:mm:ss"))


def short_date(at: Column) -> Column:
    """A day as 'Jan 5, 2024'."""
    return F.concat(F.date_format(at, "MMM d, "), year_of(at))


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("int").cast("string"), F.lit("%"))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
