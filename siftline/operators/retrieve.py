"""Keyword and vector retrieval, score fusion, and what follows them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import SearchConfig
from siftline.functions.text import analyze, cosine, vector
from siftline.operators.inverted import InvertedIndex, field_terms, within

# Fields and boosts of the two keyword searches (fixed values).
LIVE_FIELDS = {"filename": 3.0, "object_key": 2.0, "chunk_text": 1.0, "extension": 1.0, "bucket": 1.0, "mime_type": 1.0}
BUILDER_FIELDS = {"chunk_text": 3.0, "filename": 2.0, "tags": 1.0}


def postings(chunks: DataFrame, text: str = "chunk_text", key: str = "doc_id") -> DataFrame:
    """term, key, tf, dl: an inverted index; write it sorted by term so that lookups prune row groups."""
    terms = chunks.select(key, analyze(F.col(text)).alias("terms"))
    rows = terms.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class FieldStats:
    n: int
    avgdl: float
    df: dict[str, int]


def field_stats(chunks: DataFrame, fields: list[str], terms: list[str]) -> dict[str, FieldStats]:
    """Corpus size, mean length and document frequencies of a query's terms, in one aggregate over the unfiltered corpus."""
    arrays = chunks.select(*[field_terms(f).alias(f) for f in fields])
    parts: list[Column] = [F.count("*").alias("n")]
    for f in fields:
        parts.append(F.coalesce(F.avg(F.size(f)), F.lit(0.0)).alias(f"{f}|avgdl"))
        parts += [F.count_if(F.array_contains(f, t)).alias(f"{f}|df|{t}") for t in terms]
    row = arrays.agg(*parts).first()
    return {f: FieldStats(row["n"], row[f"{f}|avgdl"] or 1.0, {t: row[f"{f}|df|{t}"] for t in terms}) for f in fields}


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25(terms: Column, query: list[str], stats: FieldStats, config: SearchConfig = SearchConfig()) -> Column:
    """Score of an array of terms; one projection, no explosion of the text."""
    length = config.k1 * (1 - config.b + config.b * F.size(terms) / F.lit(float(stats.avgdl or 1.0)))
    out = F.lit(0.0)
    for t in query:
        idf = math.log(1 + (stats.n - stats.df[t] + 0.5) / (stats.df[t] + 0.5))
        tf = F.size(F.filter(terms, _is(t)))
        out = out + F.lit(idf * (config.k1 + 1)) * tf / (tf + length)
    return out


def keyword_search(chunks: DataFrame, query: list[str], fields: dict[str, float], where: Column | None = None, fuzzy: bool = False, config: SearchConfig = SearchConfig()) -> DataFrame:
    """chunks that match any term in any field, with `bm25`: the best field's boosted score. Statistics ignore `where`."""
    names = list(fields)
    terms = expand_terms(chunks, names, query, config) if fuzzy and query else query
    if not terms:
        rows = chunks if where is None else chunks.where(where)
        return rows.withColumn("bm25", F.lit(1.0))
    stats = field_stats(chunks, names, terms)
    scores = [F.lit(boost) * bm25(field_terms(f), terms, stats[f], config) for f, boost in fields.items()]
    rows = chunks if where is None else chunks.where(where)
    return rows.withColumn("bm25", F.greatest(*scores, F.lit(0.0))).where("bm25 > 0")


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def expand_terms(chunks: DataFrame, fields: list[str], query: list[str], config: SearchConfig = SearchConfig()) -> list[str]:
    """The query's terms and the index terms within their allowed edits, at most `fuzzy_expansions` for each."""
    words = chunks.select(F.explode(F.flatten(F.array(*[field_terms(f) for f in fields]))).alias("term"))
    starts = {t[: config.fuzzy_prefix] for t in query}
    near = words.where(F.substring("term", 1, config.fuzzy_prefix).isin(*starts)).groupBy("term").agg(F.count("*").alias("n"))
    out = list(dict.fromkeys(query))
    for t in dict.fromkeys(query):
        if edits_allowed(t):
            found = fuzzy_terms(near, t, config).orderBy("edits", F.desc("n"), "term").limit(config.fuzzy_expansions).collect()
            out += [r["term"] for r in found if r["term"] not in out]
    return out


def fuzzy_terms(vocabulary: DataFrame, term: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Terms of a vocabulary within the allowed edits of one term that share its first characters, with `edits`: a scan, where no index has the terms."""
    return within(vocabulary.where(F.substring("term", 1, config.fuzzy_prefix) == term[: config.fuzzy_prefix]), term, edits_allowed(term))


def indexed_search(index: InvertedIndex, chunks: DataFrame, query: list[str], fields: dict[str, float], k: int, where: Column | None = None, fuzzy: bool = False, key: str = "doc_id") -> DataFrame:
    """The k best chunks with `bm25`, found in an index instead of the texts; chunks are read by key for the hits alone, and by `where` for the keys it allows."""
    terms = index.expand(query, edits_allowed) if fuzzy else query
    if not terms:
        return top(keyword_search(chunks, [], fields, where), "bm25", k, key)
    allowed = None if where is None else chunks.where(where).select(key)
    best = index.search(terms, fields, k, allowed)
    return chunks.join(F.broadcast(best.withColumnRenamed("key", "_hit")), F.col(key) == F.col("_hit")).drop("_hit")


def indexed_matches(index: InvertedIndex, chunks: DataFrame, query: list[str], fields: dict[str, float], where: Column | None = None, fuzzy: bool = False, key: str = "doc_id") -> DataFrame:
    """All chunks that match, with `bm25`, found in an index."""
    terms = index.expand(query, edits_allowed) if fuzzy else query
    if not terms:
        return keyword_search(chunks, [], fields, where)
    rows = chunks if where is None else chunks.where(where)
    return rows.join(index.matches(terms, fields).withColumnRenamed("key", "_hit"), F.col(key) == F.col("_hit")).drop("_hit")


def knn_search(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest by cosine with `cosine` and `knn` = 1 / (2 - cosine); exact, one scan and a top-k. `where` filters first."""
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where(F.size("embedding") == len(query)).withColumn("cosine", cosine(F.col("embedding"), vector(query)))
    return rows.withColumn("knn", 1 / (2 - F.col("cosine"))).orderBy(F.desc(F.round("knn", 9)), key).limit(k)


def min_max(score: str, over: Column | None = None) -> Column:
    """Scores of retrieved hits on 0.001 to 1; equal scores become 1. The window spans the hits of one arm, k rows at most."""
    everything = Window.partitionBy(F.lit(0))
    low, high = F.min(score).over(everything), F.max(score).over(everything)
    return F.when(high == low, F.lit(1.0)).otherwise(F.greatest((F.col(score) - low) / (high - low), F.lit(0.001)))


def fuse(knn: DataFrame, bm25_hits: DataFrame, key: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """key, knn_norm, bm25_norm, combined: weighted mean of normalised arms, an absent arm counts 0."""
    a = knn.select(F.col(key), min_max("knn").alias("knn_norm"))
    b = bm25_hits.select(F.col(key), min_max("bm25").alias("bm25_norm"))
    both = a.join(b, key, "full")
    return both.withColumn("combined", F.round(config.knn_weight * F.coalesce("knn_norm", F.lit(0.0)) + config.bm25_weight * F.coalesce("bm25_norm", F.lit(0.0)), 4))


def top(hits: DataFrame, score: str, k: int, key: str) -> DataFrame:
    return hits.orderBy(F.desc(F.round(score, 9)), key).limit(k)


def clamp_limit(limit: int | str | None, config: SearchConfig = SearchConfig()) -> int:
    """Non-numbers and limits below one mean the default; nothing above the maximum."""
    try:
        n = int(limit) if limit is not None else 0
    except ValueError:
        n = 0
    return min(n, config.max_limit) if n > 0 else config.default_limit


def clamped(limit: Column, config: SearchConfig = SearchConfig()) -> Column:
    """clamp_limit of a column of texts."""
    n = limit.try_cast("int")
    return F.when(n > 0, F.least(n, F.lit(config.max_limit))).otherwise(F.lit(config.default_limit)).cast("int")


def pool_size(limit: int, config: SearchConfig = SearchConfig()) -> int:
    return max(2 * max(limit, config.rerank_pool), 50)


def rerank(hits: DataFrame, query: list[str], text: str = "chunk_text", score: str = "combined", config: SearchConfig = SearchConfig(), nearness: float = 0.0) -> DataFrame:
    """hits with rerank_score: the share of query terms in the first 1000 characters, `nearness` of it by how close together they stand. A clear winner keeps the fused order."""
    words = analyze(F.substring(text, 1, 1000))
    share = F.size(F.array_intersect(words, F.array(*map(F.lit, query)))) / F.lit(max(1, len(set(query)))) if query else F.lit(0.0)
    if nearness and query:
        share = (1 - nearness) * share + nearness * proximity(F.substring(text, 1, 1000), query)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), "doc_id")
    rows = hits.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order))
    clear = F.max(F.when((F.col("_rank") == 1) & (F.col(score) >= config.fast_path_score) & (F.col(score) - F.coalesce("_next", F.lit(0.0)) >= config.fast_path_gap), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("fast_path", clear == 1).withColumn("rerank_score", F.when(F.col("fast_path"), F.col(score)).otherwise(share)).drop("_rank", "_next")


def passages(text: Column, terms: list[str], size: int = 200, fragments: int = 3, weights: dict[str, float] | None = None) -> Column:
    """array of (score, start, text) of the best passages of `size` characters that hold a term, best first (ties: the earlier).

    A passage scores as BM25 does without lengths, which are alike: for each term weight * tf / (tf + 1.2), the weight being its idf, or 1.
    """
    found = F.array().cast("array<struct<score:double,start:int,text:string>>")
    if not terms:
        return found
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int"))

    def scored(piece: Column, i: Column) -> Column:
        words = analyze(piece)

        def total(bound: Column) -> Column:
            out = F.lit(0.0)
            for t in dict.fromkeys(terms):
                tf = F.size(F.filter(bound, _is(t)))
                out = out + F.lit(float((weights or {}).get(t, 1.0))) * tf / (tf + 1.2)
            return out

        # the words are bound once
        score = F.transform(F.array(words), total)[0]
        return F.struct(F.round(score, 9).alias("score"), (-i * size).alias("start"), piece.alias("text"))

    each = F.transform(starts, lambda i: scored(F.substring(text, i * size + 1, F.lit(size)), i))
    best = F.slice(F.reverse(F.array_sort(F.filter(each, lambda p: p["score"] > 0))), 1, fragments)
    return F.transform(best, lambda p: F.struct(p["score"].alias("score"), (-p["start"]).alias("start"), p["text"].alias("text")))


def highlight(text: Column, terms: list[str], size: int = 200, fragments: int = 3, no_match: int = 150, weights: dict[str, float] | None = None) -> Column:
    """The best passages with marked terms; the head of the text where nothing matches."""
    head = F.array(F.substring(text, 1, no_match))
    if not terms:
        return head
    pattern = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(terms) + r")(?![\p{L}\p{N}_])"
    marked = F.transform(passages(text, terms, size, fragments, weights), lambda p: F.regexp_replace(p["text"], pattern, "<mark>$1</mark>"))
    return F.when(F.size(marked) > 0, marked).otherwise(head)


def covering_window(words: Column, terms: list[str]) -> Column:
    """Words in the shortest stretch of an array that holds every term; null if some term is missing. One pass with the last place of each term."""
    terms = list(dict.fromkeys(terms))
    start = F.struct(F.lit(0).alias("i"), F.array(*[F.lit(-1)] * len(terms)).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, word: Column) -> Column:
        last = F.array(*[F.when(word == F.lit(t), state["i"]).otherwise(state["last"][n]) for n, t in enumerate(terms)])
        # a term that is missing yet has place -1
        whole = F.array_min(last) >= 0
        return F.struct((state["i"] + 1).alias("i"), last.alias("last"), F.when(whole, F.least(F.coalesce(state["best"], state["i"] + 1), state["i"] - F.array_min(last) + 1)).otherwise(state["best"]).alias("best"))

    return F.aggregate(words, start, step, lambda s: s["best"])


def proximity(text: Column, terms: list[str]) -> Column:
    """1 where the terms stand side by side, less the farther apart they are, 0 where some term is missing."""
    distinct = len(set(terms))
    if not distinct:
        return F.lit(0.0)
    return F.coalesce(distinct / covering_window(analyze(text), terms), F.lit(0.0))


def suggest(chunks: DataFrame, prefix: str, size: int = 5) -> DataFrame:
    """File names by a scan; `operators.suggest` keeps them in a table."""
    return chunks.where(F.lower("filename").startswith(prefix.lower())).select("filename").distinct().orderBy("filename").limit(size)
