"""A persisted inverted index: posting blocks with score bounds, and a sorted dictionary, in which fuzzy terms are looked up too.

Documents are dealt into blocks of about `WIDTH` by a hash of their key, so a posting list, however long, is spread over
blocks that no task has to hold together. A row of `postings` has one term's documents of one block: keys and lengths,
term frequencies, and from the greatest frequency and the least length a bound of its scores under any average length.
Rows are sorted by field and term, so a lookup reads the row groups of its terms only. Texts are dealt by block before
they are cut into terms: a block's terms are counted together, and what moves is the texts and the finished rows.

A search adds up the bounds of its terms block by block, from narrow columns; it scores the blocks with the greatest
bounds first, and then only those whose bound reaches the k-th score found so far. What a bound rules out could not have
entered the result, so it is that of scoring everything.

An index is made of segments; `add` writes one more, whole or not at all, under a number of its own.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import SearchConfig
from siftline.functions.text import analyze
from siftline.sources.readers import exists, folders, remove

#: Documents of a block, on average.
WIDTH = 1024
#: Blocks that a task cuts into terms.
BLOCKS_PER_TASK = 8
#: Blocks that are scored before bounds rule out others.
FIRST = 32
#: Rows of block numbers that may be broadcast: 16 bytes each.
FEW_BLOCKS = 1_000_000


def field_terms(field: str) -> Column:
    """Terms of a field; keyword fields are one term each."""
    if field in ("chunk_text", "author", "title"):
        return analyze(F.col(field))
    if field == "filename":
        return analyze(F.col(field), "filename")
    if field == "tags":
        return F.transform(F.col(field), lambda t: F.lower(t))
    return F.array(F.lower(F.col(field)))


def osa(term: Column, asked: str) -> Column:
    """Edits between a column and a fixed string, a swap of neighbours as one: row by row of the edit table, in SQL functions."""
    b = F.array(*[F.lit(c) for c in asked]) if asked else F.array().cast("array<string>")
    n = len(asked)
    at = lambda row, j: F.element_at(row, j + 1)
    first = F.sequence(F.lit(0), F.lit(n))

    def step(state: Column, x: Column) -> Column:
        older, before, last = state["older"], state["before"], state["last"]
        i = at(before, F.lit(0)) + 1

        def cell(row: Column, j: Column) -> Column:
            same = x == F.element_at(b, j)
            value = F.least(at(before, j) + 1, F.element_at(row, -1) + 1, at(before, j - 1) + F.when(same, 0).otherwise(1))
            swapped = (i > 1) & (j > 1) & (x == F.element_at(b, F.greatest(j - 1, F.lit(1)))) & (last == F.element_at(b, j))
            value = F.when(swapped, F.least(value, at(older, F.greatest(j - 2, F.lit(0))) + 1)).otherwise(value)
            return F.concat(row, F.array(value))

        row = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(i), cell) if n else F.array(i)
        return F.struct(before.alias("older"), row.alias("before"), x.alias("last"))

    letters = F.filter(F.split(term, ""), lambda c: c != "")
    start = F.struct(first.alias("older"), first.alias("before"), F.lit("").alias("last"))
    return F.aggregate(letters, start, step, lambda s: F.element_at(s["before"], -1))


@dataclass(frozen=True)
class Stats:
    n: int
    avgdl: dict[str, float]
    df: dict[tuple[str, str], int]

    def idf(self, field: str, term: str) -> float:
        df = self.df.get((field, term), 0)
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))


class InvertedIndex:
    """An index in a folder: segments `s-<number>` with tables postings, terms and fields."""

    def __init__(self, spark: SparkSession, path: str, config: SearchConfig = SearchConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    # ---- writing -------------------------------------------------------------------------------------

    def segments(self) -> list[str]:
        """Names of the whole segments: those whose last table was committed."""
        return sorted(n for n in folders(self.spark, self.path) if n.startswith("s-") and exists(self.spark, f"{self.path}/{n}/fields/_SUCCESS"))

    def add(self, chunks: DataFrame, fields: list[str], key: str = "doc_id", partitions: int | None = None) -> None:
        """Indexes the fields of chunks, one document per key, as a new segment."""
        place = f"{self.path}/s-{len(self.segments()):06d}-{uuid.uuid4().hex[:12]}"
        split = partitions or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = max(1, -(-chunks.count() // WIDTH))
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")
        named = [F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
        dealt = chunks.select(F.col(key).alias("key"), block, *named).repartition(max(split, -(-blocks // BLOCKS_PER_TASK)), "block").sortWithinPartitions("block")
        docs = dealt.select("key", "block", *[F.col(f"f{i}").alias(f) for i, f in enumerate(fields)]).select("key", "block", *[field_terms(f).alias(f"f{i}") for i, f in enumerate(fields)])
        rows = posting_rows(docs, fields)
        # borders of a range are found by a pass of its own over the rows: they are written first, lest the texts be cut twice
        rows.write.parquet(f"{place}/unsorted")
        sort = ["field", "term", "block"]
        self.spark.read.parquet(f"{place}/unsorted").repartitionByRange(split, *sort).sortWithinPartitions(*sort).write.parquet(f"{place}/postings")
        remove(self.spark, f"{place}/unsorted")
        terms = self.spark.read.parquet(f"{place}/postings").groupBy("field", "term").agg(F.sum("n").alias("df"))
        terms.repartitionByRange(split, "field", "term").sortWithinPartitions("field", "term").write.parquet(f"{place}/terms")
        # a document without a field takes no part in the field's mean length
        facts = chunks.select(*[field_terms(f).alias(f) for f in fields]).agg(F.count("*").alias("n"), *[F.struct(F.coalesce(F.sum(F.size(f)), F.lit(0)).alias("length"), F.count(F.col(f)).alias("docs")).alias(f) for f in fields])
        facts.select("n", F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]).alias("lengths")).coalesce(1).write.parquet(f"{place}/fields")

    # ---- reading -------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """Rows of all segments, with the segment's name."""
        names = self.segments()
        if not names:
            raise ValueError(f"no index in {self.path}")
        parts = [self.spark.read.parquet(f"{self.path}/{s}/{name}").withColumn("segment", F.lit(i)) for i, s in enumerate(names)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def stats(self, terms: list[str], fields: list[str]) -> Stats:
        """Documents, mean lengths and document frequencies of a few terms."""
        rows = self.table("fields").collect()
        n = sum(r["n"] for r in rows)
        facts = {f: [r["lengths"][f] for r in rows if f in r["lengths"]] for f in fields}
        mean = {f: sum(x["length"] for x in parts) / max(1, sum(x["docs"] for x in parts)) for f, parts in facts.items()}
        found = self.table("terms").where(F.col("field").isin(fields) & F.col("term").isin(terms)).groupBy("field", "term").agg(F.sum("df").alias("df")).collect()
        return Stats(n, {f: x or 1.0 for f, x in mean.items()}, {(r["field"], r["term"]): r["df"] for r in found})

    def _weights(self, terms: list[str], fields: dict[str, float], stats: Stats) -> Column:
        """boost * idf * (k1 + 1) of a row's field and term."""
        pairs = [(f, t) for f in fields for t in terms if (f, t) in stats.df]
        name = F.concat("field", F.lit("\x00"), "term")
        known = F.create_map(*[x for f, t in pairs for x in (F.lit(f"{f}\x00{t}"), F.lit(fields[f] * stats.idf(f, t) * (self.config.k1 + 1)))])
        return F.element_at(known, name)

    def _part(self, weight: Column, tf: Column, dl: Column, stats: Stats) -> Column:
        mean = F.element_at(F.create_map(*[x for f, v in stats.avgdl.items() for x in (F.lit(f), F.lit(float(v)))]), F.col("field"))
        return weight * tf / (tf + self.config.k1 * (1 - self.config.b + self.config.b * dl / mean))

    def _rows(self, terms: list[str], fields: dict[str, float], stats: Stats) -> DataFrame:
        return self.table("postings").where(F.col("field").isin(*fields) & F.col("term").isin(*terms)).withColumn("weight", self._weights(terms, fields, stats))

    def bounds(self, terms: list[str], fields: dict[str, float], stats: Stats) -> DataFrame:
        """segment, block, bound: no document of the block scores more."""
        rows = self._rows(terms, fields, stats)
        part = self._part(F.col("weight"), F.col("max_tf"), F.col("min_dl"), stats)
        by_field = rows.groupBy("segment", "block", "field").agg(F.sum(part).alias("bound"))
        return by_field.groupBy("segment", "block").agg(F.max("bound").alias("bound"))

    def _scores(self, rows: DataFrame, stats: Stats, allowed: DataFrame | None) -> DataFrame:
        each = unpacked(rows)
        if allowed is not None:
            each = each.join(allowed.toDF("_allowed"), F.col("key") == F.col("_allowed"), "left_semi")
        part = self._part(F.col("weight"), F.col("tf"), F.col("dl"), stats)
        by_field = each.groupBy("key", "field").agg(F.sum(part).alias("s"))
        return by_field.groupBy("key").agg(F.max("s").alias("bm25")).where("bm25 > 0")

    def matches(self, terms: list[str], fields: dict[str, float], allowed: DataFrame | None = None) -> DataFrame:
        """key, bm25 of every document that has a term: the best field's boosted score. Statistics ignore `allowed` (one column of keys)."""
        terms = list(dict.fromkeys(terms))
        stats = self.stats(terms, list(fields))
        if not stats.df:
            return self._none()
        return self._scores(self._rows(terms, fields, stats), stats, allowed)

    def search(self, terms: list[str], fields: dict[str, float], k: int, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """The k best of `matches` (ties: least key), by blocks whose bounds can reach them."""
        terms = list(dict.fromkeys(terms))
        stats = self.stats(terms, list(fields))
        if not stats.df:
            return self._none()
        rows, bounds = self._rows(terms, fields, stats), self.bounds(terms, fields, stats)
        best = bounds.orderBy(F.desc("bound"), "segment", "block").limit(first).select("segment", "block")
        found = self._scores(rows.join(F.broadcast(best), ["segment", "block"], "left_semi"), stats, allowed)
        reached = found.select(F.round("bm25", 9).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.count("*").alias("n"), F.min("s").alias("s")).first()
        if reached["n"] == k:
            # a hair below the k-th score, for sums in another order
            alive = bounds.where(F.col("bound") >= reached["s"] * (1 - 1e-9) - 1e-8).select("segment", "block")
            alive = F.broadcast(alive) if alive.count() <= FEW_BLOCKS else alive
            rows = rows.join(alive, ["segment", "block"], "left_semi")
        return self._scores(rows, stats, allowed).orderBy(F.desc(F.round("bm25", 9)), "key").limit(k)

    def _none(self) -> DataFrame:
        kind = unpacked_type(self.table("postings"))
        return self.spark.createDataFrame([], f"key {kind}, bm25 double")

    # ---- fuzzy terms ----------------------------------------------------------------------------------

    def near_terms(self, term: str, most: int) -> DataFrame:
        """term, df, edits: terms of the dictionary within `most` edits that share the fixed prefix; the dictionary is sorted, so only the row groups of that prefix are read."""
        prefix = self.config.fuzzy_prefix
        rows = self.table("terms").where(F.col("term").startswith(term[:prefix]) & (F.length("term") > prefix))
        return within(rows.groupBy("term").agg(F.sum("df").alias("df")), term, most)

    def expand(self, terms: list[str], edits) -> list[str]:
        """The terms and the dictionary's terms within their allowed edits, nearest and most frequent first, at most `fuzzy_expansions` for each."""
        out = list(dict.fromkeys(terms))
        for t in dict.fromkeys(terms):
            if edits(t) and len(t) > self.config.fuzzy_prefix:
                found = self.near_terms(t, edits(t)).orderBy("edits", F.desc("df"), "term").limit(self.config.fuzzy_expansions).collect()
                out += [r["term"] for r in found if r["term"] not in out]
        return out


def within(terms: DataFrame, term: str, most: int) -> DataFrame:
    """The rows (term, ...) within `most` edits of one term, with `edits`; plain edit distance, twice the bound, rules out most before the exact count."""
    close = terms.where((F.abs(F.length("term") - len(term)) <= most) & (F.levenshtein("term", F.lit(term)) <= 2 * most))
    return close.withColumn("edits", osa(F.col("term"), term)).where(F.col("edits") <= most)


def posting_rows(docs: DataFrame, fields: list[str]) -> DataFrame:
    """The posting rows of docs (key, block, and f0, f1, ...: the terms of each field), a block of about WIDTH documents at a time."""
    kind = docs.schema["key"].dataType
    number = kind.typeName() in ("long", "integer", "short")
    keys = "least long, above array<long>" if number else f"keys array<{kind.simpleString()}>"
    names = ["field", "term", "block", "n", "max_tf", "min_dl", *(["least", "above"] if number else ["keys"]), "tfs", "dls"]

    def run(group: tuple, table: pa.Table) -> pa.Table:
        block, parts = group[0].as_py(), []
        for i, field in enumerate(fields):
            lists = table.column(f"f{i}").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(dl)), dl)
            known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            term = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, tf = np.unique(term[known] * len(dl) + doc[known], return_counts=True)
            if not len(pairs):
                continue
            term, doc = np.divmod(pairs, len(dl))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            ends = np.append(first, len(term))
            listed = lambda values, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            own = table.column("key").combine_chunks().take(pa.array(doc))
            if number:
                # rows without a key stay without one
                key = pc.fill_null(own, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                least = np.minimum.reduceat(key, first)
                kept = [pa.array(least, pa.int64()), listed(pa.array(key - np.repeat(least, np.diff(ends)), pa.int64(), mask=own.is_null().to_numpy(zero_copy_only=False)))]
            else:
                kept = [listed(own)]
            rows = [
                pa.array([field] * len(first), pa.string()), coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array(np.full(len(first), block), pa.int64()), pa.array(np.diff(ends), pa.int32()),
                pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(dl[doc], first), pa.int32()), *kept, listed(pa.array(tf, pa.int32())), listed(pa.array(dl[doc], pa.int32())),
            ]
            parts.append(pa.table(rows, names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in empty], names=names)

    texts, ints = pa.string(), pa.int32()
    own = {"string": pa.string(), "long": pa.int64()}
    empty = [texts, texts, pa.int64(), ints, ints, ints, *([pa.int64(), pa.list_(pa.int64())] if number else [pa.list_(own.get(kind.typeName(), pa.string()))]), pa.list_(ints), pa.list_(ints)]
    return docs.groupBy("block").applyInArrow(run, f"field string, term string, block long, n int, max_tf int, min_dl int, {keys}, tfs array<int>, dls array<int>")


def unpacked(rows: DataFrame) -> DataFrame:
    """field, weight, key, tf, dl of the documents of posting rows."""
    number = "above" in rows.columns
    zipped = F.arrays_zip(F.col("above" if number else "keys").alias("key"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
    each = rows.select("field", "weight", *["least"] * number, F.explode(zipped).alias("p"))
    return each.select("field", "weight", (F.col("least") + F.col("p.key") if number else F.col("p.key")).alias("key"), "p.tf", "p.dl")


def unpacked_type(rows: DataFrame) -> str:
    return "bigint" if "above" in rows.columns else rows.schema["keys"].dataType.elementType.simpleString()
