"""Text-quality detectors as array columns of flags, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of leaked file internals (fixed values).
PDF = [
    r"/IncludeSlug", r"/OmitPlacedBitmaps", r"/OmitPlacedEPS", r"/OmitPlacedPDF", r"/DestinationProfileSelector", r"/PDFXOutputIntentProfileSelector", r"/PreserveEditing",
    r"/UntaggedCMYKHandling", r"/UntaggedRGBHandling", r"/SimulateOverprint", r"/Downsample16BitImages", r"/FlattenerPreset", r"/PresetSelector", r"/Namespace\s*\[",
    r"endstream", r"endobj", r"xref\s+\d+", r"%%EOF", r"BT\s+/F\d+", r"Tf\s+\d+\s+Td",
]
DISTILLER = [
    "Acrobat Distiller", "GrayACSImageDict", "ColorACSImageDict", "MonoImageDict", "AntiAliasColorImages", "AutoFilterColorImages", "ColorImageDownsampleType", "GrayImageDownsampleType",
    "PreserveCopyPage", "PreserveEPSInfo", "PreserveHalftoneInfo",
]
XMP = r"<x:xmpmeta|<rdf:RDF|xmlns:|xpacket"
XML = r"<\?xml version"
LOCALES = r"/(ENU|DEU|FRA|NLD|ITA|ESP|PTB|DAN|NOR|SVE|FIN|PLK|CSY|HUN|TRK|RUS|ELL|ARA|HEB|JPN|KOR|CHS|CHT)\s+\("


def hex_unicode(t: Column) -> Column:
    runs = F.aggregate(F.regexp_extract_all(t, F.lit("([0-9A-Fa-f]{16,})"), F.lit(1)), F.lit(0), lambda n, r: n + F.length(r))
    shown = F.length(F.regexp_replace(t, "[ \n]+", ""))
    return F.when(t.rlike("<FEFF[0-9A-Fa-f]{4,}"), F.lit("hex-unicode-blob (<FEFF...>)")).when((runs > 0) & (runs / F.greatest(shown, F.lit(1)) > 0.5), F.lit("hex-run (>50% hex chars)"))


def _listed(t: Column, patterns: list[str], label: str, shown: int) -> Column:
    found = F.filter(F.array(*[F.when(t.rlike(p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit(label + " ("), F.array_join(F.slice(found, 1, shown), ", "), F.lit(")")))


def pdf_internals(t: Column) -> Column:
    return _listed(t, PDF, "pdf-internals", 3)


def distiller_settings(t: Column) -> Column:
    return _listed(t, DISTILLER, "distiller-settings", 2)


def xml_metadata(t: Column) -> Column:
    return F.when(t.rlike(XMP), F.lit("xml-xmp-metadata")).when(t.rlike(XML), F.lit("xml-declaration"))


def locale_strings(t: Column) -> Column:
    n = F.regexp_count(t, F.lit(LOCALES))
    return F.when(n >= 2, F.concat(F.lit("locale-strings ("), n.cast("string"), F.lit(" language blocks)")))


def non_ascii(t: Column) -> Column:
    share = F.length(F.regexp_replace(t, r"[\x00-\x7F]+", "")) / F.greatest(F.length(t), F.lit(1))
    return F.when(share > 0.4, F.concat(F.lit("high-non-ascii ("), F.round(share * 100, 0).cast("int").cast("string"), F.lit("% non-ASCII chars)")))


def repetitive(t: Column) -> Column:
    # one pass cuts all windows; they are bound once, and the text's tail holds no window of its own
    once = lambda value, then: F.transform(F.array(value), then)[0]
    every = lambda s: F.when(F.length(s) >= 40, F.slice(F.regexp_extract_all(s, F.lit("(?s)(.{10})"), F.lit(1)), 1, F.floor((F.length(s) - 11) / 10).cast("int") + 1))
    share = once(once(F.trim(t, F.lit(" \t\r\n\x0b\x0c")), every), lambda w: F.size(F.array_distinct(w)) / F.size(w))
    return F.when(share < 0.2, F.concat(F.lit("repetitive-content (only "), F.round(share * 100, 0).cast("int").cast("string"), F.lit("% unique 10-char windows)")))


def whitespace_dominated(t: Column) -> Column:
    share = F.length(F.regexp_replace(t, r"\s+", "")) / F.greatest(F.length(t), F.lit(1))
    return F.when(share < 0.3, F.concat(F.lit("whitespace-dominated ("), F.round(share * 100, 0).cast("int").cast("string"), F.lit("% printable chars)")))


def no_words(t: Column) -> Column:
    return F.when(~t.rlike("[a-zA-Z]{3,}") & (F.length(t) > 30), F.lit("no-words (numeric/symbol only)"))


DETECTORS = {
    "noise_hex": hex_unicode, "noise_pdf": pdf_internals, "noise_distiller": distiller_settings, "noise_xml": xml_metadata, "noise_locale": locale_strings,
    "noise_non_ascii": non_ascii, "noise_repetitive": repetitive, "noise_whitespace": whitespace_dominated, "noise_no_words": no_words,
}


def flags(text: Column) -> Column:
    return F.filter(F.array(*[d(text) for d in DETECTORS.values()]), lambda x: x.isNotNull())


def noisy(text: Column) -> Column:
    """Whether any detector flags the text; the first that does ends the search."""
    return F.coalesce(*[d(text) for d in DETECTORS.values()]).isNotNull()


def level(ratio: Column) -> Column:
    return F.when(ratio == 0, "clean").when(ratio < 0.15, "low").when(ratio < 0.40, "medium").otherwise("high")


def file_report(chunks: DataFrame, file: str, text: str) -> DataFrame:
    """Per file: chunks, noisy chunks, ratio and level."""
    marked = chunks.select(F.col(file).alias("file"), noisy(F.col(text)).cast("int").alias("noisy"))
    out = marked.groupBy("file").agg(F.count("*").alias("total"), F.sum("noisy").alias("noisy"))
    return out.withColumn("ratio", F.round(F.col("noisy") / F.col("total"), 6)).withColumn("level", level(F.col("noisy") / F.col("total")))


def breakdown(chunks: DataFrame, text: str) -> DataFrame:
    """Counts by the label of a flag, without its detail."""
    rows = chunks.select(F.explode(flags(F.col(text))).alias("flag")).select(F.split_part("flag", F.lit(" ("), F.lit(1)).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("files"), F.sum("total").alias("chunks"), F.sum("noisy").alias("noisy"))
