"""Connected components and candidate links over bucketed signatures, as joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, among, drop_out, mix, release, slices, text_array, trimmed, write_out

#: Edges that a task of a star step takes.
EDGES_PER_TASK = 200_000
#: Further rounds of comparisons with a centre, after the first.
ROUNDS = 2
#: Rows of a bucket from which on it is split by size, and how many times the ratio of similar sizes spans a size class.
SMALL = 16
SPAN = 3
#: Frequent tokens that come last in the order of a prefix filter, and how many of a slice of texts are looked at for them.
COMMON = 65_536
COMMON_OF_SLICE = 4_096


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id that an edge (a, b) touches; root is the least id of its component.

    Alternating large-star and small-star steps until nothing changes; each step is an aggregate with
    map-side minima and an equi-join, so a hub of any degree is spread, and each result is a written table.
    """
    spark = edges.sparkSession
    now = write_out(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    # few edges need few tasks and files; steps never make more edges than about two a node
    tasks = 4 + now.count() // EDGES_PER_TASK
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        large = write_out(large.distinct().coalesce(tasks), "large-star")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        pairs = large.join(low, F.col("a") == F.col("u"))
        small = pairs.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = write_out(small.where(F.col("a") != F.col("b")).distinct().coalesce(tasks), "small-star")
        seen = after.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        drop_out(spark, now, large)
        del both, least, large, low, pairs, small
        release(spark)
        now = after
        if (seen["n"], seen["x"]) == state:
            break
        state = (seen["n"], seen["x"])
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    out = write_out(roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()).coalesce(2 * tasks), "components")
    drop_out(spark, now)
    return out


def shared_buckets(members: DataFrame, name: str) -> DataFrame:
    """Written rows (key, id, size, n) of keys that at least two different ids have, n being the bucket's rows; members (key, id, size) is a written table.

    One aggregate finds the keys; the members are then filtered by them (see `among`), so they are dealt by key once.
    """
    shared = members.groupBy(F.col("key").alias("shared_key")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("shared_key", "n")
    shared = write_out(shared, f"{name}-keys")
    out = write_out(among(members, "key", shared, "shared_key", "inner").select("key", "id", "size", "n"), f"{name}-shared")
    drop_out(members.sparkSession, shared)
    return out


def by_size(buckets: DataFrame, ratio: float, small: int = SMALL) -> DataFrame:
    """Splits buckets of more than `small` rows by size class, each row in its class and, if sizes up to the ratio above its own reach it, the next.

    Of two ids whose sizes differ by no more than the ratio, the smaller one is in the class of the larger, so no
    link is lost; a class spans SPAN times the ratio, so one row of SPAN is in two classes.
    """
    wide, size = ratio * 1.01, F.greatest(F.col("size"), F.lit(1)).cast("double")
    rank = lambda up: F.floor(F.log(size * F.lit(up)) / F.log(F.lit(wide**SPAN)))
    key = F.when(F.col("n") <= small, F.array("key")).otherwise(F.array_distinct(F.array(F.xxhash64("key", rank(1.0)), F.xxhash64("key", rank(wide)))))
    return buckets.select(F.explode(key).alias("key"), "id").distinct()


def linked_components(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], prefix: Callable[[DataFrame], DataFrame], name: str, least: float, need: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Components (id, root) of all verified links between ids that share a bucket (key, id, size, n), without all pairs of a bucket.

    Similar ids must not differ in size by more than 1 / least: wide buckets are split by size class. Each
    round compares the members of every bucket that still spans several components with one centre of the
    bucket: the id that lies in the most buckets (ties: the least under a salt), then `ROUNDS` further ones. A centre has then been compared with
    its whole bucket and leaves it. Buckets whose other members are inside one component need no more and leave
    before the next round. Small buckets that still span several are compared pair by pair, members of
    wide ones by prefix filter: similar ids have so many tokens in common that in any one order of all tokens
    they share one of their first ones, with enough tokens behind it on both sides. So no candidate link is
    left out, and no pair is compared twice, nor one whose ids are in one component by then.

    prefix: for a table (id, root), (id, root, token, place, all) of the first tokens of each text, in an order
    that is the same for all texts and has frequent tokens last; place counts from 1, all is the number of the text's
    tokens, and places go to one more than the tokens that the smaller of two similar texts may lack. Different
    elements of one text are different tokens. need: the tokens that similar texts of so many tokens have in
    common at least; by default those of a Jaccard similarity of `least`.
    """
    spark = buckets.sparkSession
    rest = write_out(by_size(buckets, 1 / least), f"{name}-keyed")
    # ids that lie in the most buckets come first as centres: near copies share more with what they were made of than with each other
    often = rest.groupBy(F.col("id").alias("counted")).agg(F.count("*").cast("int").alias("often"))
    keyed, rest = rest, write_out(rest.join(often, F.col("id") == F.col("counted")).select("key", "id", "often"), f"{name}-buckets")
    drop_out(spark, keyed)
    tried, links, roots, used = None, None, None, []
    for turn in range(ROUNDS + 2):
        rows = rest
        if roots is not None:
            rows = rest.join(roots.withColumnRenamed("id", "known"), F.col("id") == F.col("known"), "left").select("key", "id", "often", F.coalesce("root", "id").alias("root"))
            # buckets of the same members have the same pairs and centres: one of them stays
            members = [F.bit_xor(F.xxhash64("id", F.lit(salt))).alias(f"set{salt}") for salt in (0, 1)]
            spans = rows.groupBy(F.col("key").alias("open")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), *members).where("lo < hi")
            spans = spans.groupBy("n", "set0", "set1").agg(F.min("open").alias("open")).select("open", "n")
            rows = write_out(rows.join(spans, F.col("key") == F.col("open")).select("key", "id", "often", "root", "n"), f"{name}-open")
            drop_out(spark, rest)
        if turn > ROUNDS:
            small = rows.where(F.col("n") <= SMALL).select("key", "id", "root")
            wide = rows.where(F.col("n") > SMALL).select("id", "root").distinct()
            pairs = _cross_pairs(small).union(_prefix_pairs(wide, prefix, name, need or (lambda n, m: least / (1 + least) * (n + m)))).distinct()
        else:
            rest = write_out(_with_centres(rows, (turn * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF), f"{name}-rest")
            pairs = rest.where("NOT joined").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
        pairs = write_out(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"{name}-pairs")
        drop_out(spark, rows)
        used.append(pairs)
        if roots is not None and pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = write_out(verify(pairs), f"{name}-links")
        used.append(found)
        if roots is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            if roots is not None:
                drop_out(spark, roots)
            roots = components(links)
        release(spark)
    drop_out(spark, *used)
    return roots


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (key, id, root) with one key and two roots."""
    other = rows.select(F.col("key").alias("k2"), F.col("id").alias("id2"), F.col("root").alias("root2"))
    return rows.join(other, (F.col("key") == F.col("k2")) & (F.col("root") < F.col("root2"))).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def _prefix_pairs(members: DataFrame, prefix: Callable[[DataFrame], DataFrame], name: str, need: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of members (id, root) of two components that share one of their first tokens and can still have enough in common behind it."""
    first = write_out(prefix(write_out(members, f"{name}-wide")), f"{name}-prefix")
    other = first.select(*[F.col(c).alias(f"{c}2") for c in first.columns])
    behind = 1 + F.least(F.col("all") - F.col("place"), F.col("all2") - F.col("place2"))
    near = first.join(other, (F.col("token") == F.col("token2")) & (F.col("root") < F.col("root2")) & (behind >= need(F.col("all"), F.col("all2")) - 1e-6))
    return near.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def _with_centres(rows: DataFrame, salt: int) -> DataFrame:
    """(key, id, often, c, joined) of the members of buckets other than the centre c of their bucket: that which lies in the most buckets, then the least id under the salt. joined: both are in one component already."""
    if "root" not in rows.columns:
        rows = rows.withColumn("root", F.col("id"))
    centre = F.min(F.struct((-F.col("often")).alias("o"), F.col("id").bitwiseXOR(F.lit(salt)).alias("c"), "root")).alias("c")
    centres = rows.groupBy(F.col("key").alias("at_key")).agg(centre)
    met = rows.join(centres, F.col("key") == F.col("at_key")).withColumn("joined", F.col("root") == F.col("c.root"))
    return met.select("key", "id", "often", F.col("c.c").bitwiseXOR(F.lit(salt)).alias("c"), "joined").where("id <> c")


def frequent_tokens(texts: DataFrame, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """About the COMMON most frequent tokens of texts (id, text), the rarest first: the sums of each slice's most frequent ones. Any list keeps a prefix filter exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            found, n = np.unique(tokens(text_array(batch.column(1)))[0], return_counts=True)
            top = np.argsort(-n, kind="stable")[:COMMON_OF_SLICE]
            top = top[n[top] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(found[top].view(np.int64)), pa.array(n[top])], names=["token", "n"])

    found = texts.select("id", "text").mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def first_tokens(texts: DataFrame, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], spare: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, root, token, place, all) of the first tokens of texts (id, text, root) as `linked_components` takes them: by hash, frequent tokens last.

    tokens: for an array of texts, their tokens as (values, offsets); equal ones of a text count once. spare: how
    many of so many tokens a similar text of no more tokens may lack.
    """
    common = frequent_tokens(texts, tokens)
    by_value = np.argsort(common)
    ordered = common[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            values, offsets = tokens(text_array(batch.column(1)))
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            rank = mix(values + np.uint64(1)) >> np.uint64(1)
            if len(ordered) and len(values):
                at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
                rank = np.where(ordered[at] == values, by_value[at].astype(np.uint64) | np.uint64(1 << 63), rank)
            order = np.lexsort((values, rank, text))
            values, text = values[order], text[order]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
            values, text = values[fresh], text[fresh]
            all_ = np.bincount(text, minlength=len(offsets) - 1)
            place = np.arange(len(values)) - np.repeat(np.cumsum(all_) - all_, all_) + 1
            first = place <= spare(all_)[text] + 1
            ids, roots = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            out = [pa.array(ids[text[first]], pa.int64()), pa.array(roots[text[first]], pa.int64()), pa.array(values[first].view(np.int64)), pa.array(place[first], pa.int32()), pa.array(all_[text[first]], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "root", "token", "place", "all"])

    return texts.select("id", "text", "root").mapInArrow(trimmed(run), "id long, root long, token long, place int, all int")
