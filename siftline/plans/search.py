"""Search from a natural-language query to ranked files, as one plan over chunks and vectors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import SearchConfig
from siftline.functions.embed import embed
from siftline.functions.text import analyze
from siftline.operators import parse, predicates, results, retrieve
from siftline.operators.inverted import InvertedIndex


@dataclass
class SearchResult:
    hits: DataFrame
    intent_text: str
    keywords: list[str]
    filters: list[str]
    meta: dict = field(default_factory=dict)
    total: DataFrame | None = None  # one row: total, the hits before the limit


class SearchEngine:
    """Chunks (doc_id, filename, chunk_text, ...) and vectors (vec_id, embedding) with one document per id; an index of the chunks spares the scans of their texts."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, config: SearchConfig = SearchConfig(), index: InvertedIndex | None = None):
        self.chunks, self.vectors, self.config, self.index = chunks, vectors, config, index
        self.spark: SparkSession = chunks.sparkSession

    @classmethod
    def over(cls, table: DataFrame, config: SearchConfig = SearchConfig()) -> SearchEngine:
        """An engine over the chunk table: every chunk is a hit of its own until the files are deduplicated."""
        chunks = table.withColumn("doc_id", F.col("_id"))
        return cls(chunks, chunks.where("embedding IS NOT NULL").select(F.col("_id").alias("vec_id"), "embedding"), config)

    def parse(self, query: str, now: datetime) -> tuple[str, list[str], list[str]]:
        row = parse.parse(self.spark.createDataFrame([(query,)], "query string"), now.year).first()
        return row["intent_text"], list(row["keywords"]), list(row["filters"])

    def embed_query(self, text: str) -> list[float]:
        row = self.spark.createDataFrame([(text,)], "t string").select(embed(F.col("t")).alias("e"), analyze(F.col("t")).alias("w")).first()
        return list(row["e"])

    def search(self, query: str, limit: int | str | None = None, now: datetime | None = None, query_vector: list[float] | None = None, order_by: str = "combined") -> SearchResult:
        """The live search: parse, two arms, fusion, threshold, one hit per file, rerank, top k."""
        now = now or datetime.now()
        limit = retrieve.clamp_limit(limit, self.config)
        intent, keywords, filters = self.parse(query, now)
        where = predicates.all_of(filters, now, self.config.time_zone)
        hits = self.hybrid_hits(keywords, where, query_vector if query_vector is not None else self.embed_query(intent), bool(intent.strip()), retrieve.LIVE_FIELDS, limit, fuzzy=True)
        ranked = retrieve.rerank(hits, keywords, config=self.config) if self.config.rerank else hits.withColumn("rerank_score", F.col("combined"))
        ranked = results.gateway_dedup(ranked)
        order = [F.desc("rerank_score"), F.desc("combined")] if order_by == "rerank" else [F.desc("combined")]
        top = ranked.orderBy(*order, "bucket", "filename", "doc_id").limit(limit)
        top = top.withColumn("summary", F.when(F.col("combined") == F.max("combined").over(results.Window.partitionBy(F.lit(0))), F.trim(F.substring("chunk_text", 1, 200))))
        return SearchResult(top, intent, keywords, filters, {"limit": limit}, ranked.agg(F.count("*").alias("total")))

    def hybrid_hits(self, keywords: list[str], where, query_vector: list[float], use_intent: bool, fields: dict[str, float], limit: int, fuzzy: bool = False) -> DataFrame:
        """One hit per file above the threshold, with combined, semantic_score and keyword_score."""
        pool = retrieve.pool_size(limit, self.config)
        if self.index:
            words = retrieve.indexed_search(self.index, self.chunks, keywords, fields, pool, where, fuzzy)
        else:
            words = retrieve.top(retrieve.keyword_search(self.chunks, keywords, fields, where, fuzzy, self.config), "bm25", pool, "doc_id")
        use_knn = use_intent and self.vectors is not None and any(query_vector)
        if not use_knn:
            hits = words.withColumn("combined", F.round("bm25", 4)).withColumn("semantic_score", F.lit(0.0)).withColumn("keyword_score", F.col("combined"))
            return results.worker_dedup(hits)
        vectors = self.vectors
        if self.config.filter_scope == "both":
            vectors = vectors.join(self.chunks.where(where).select(F.col("doc_id").alias("_d")), F.col("vec_id") == F.col("_d"), "left_semi")
        near = retrieve.knn_search(vectors, query_vector, self.config.knn_k).withColumnRenamed("vec_id", "doc_id")
        fused = retrieve.fuse(near, words, "doc_id", self.config)
        if use_intent:
            fused = fused.where(F.col("combined") >= self.config.threshold)
        # fused holds two pools at most, so it is the small side whatever the corpus
        hits = self.chunks.join(F.broadcast(fused), "doc_id")
        hits = hits.withColumn("semantic_score", F.col("combined")).withColumn("keyword_score", F.lit(0.0))
        return results.worker_dedup(hits)

    def hybrid(self, query_text: str, query_vector: list[float], *, size: int = 10, from_: int = 0, **filters) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
        """The library search: filters on both arms; returns a page of hits, facets and the total size."""
        where = predicates.builder_filter(**filters)
        terms = [r for r in self.spark.createDataFrame([(query_text,)], "t string").select(analyze(F.col("t")).alias("w")).first()["w"]]
        fields = {f: b for f, b in retrieve.BUILDER_FIELDS.items() if f in self.chunks.columns}
        asked = list(dict.fromkeys(terms))
        if self.index:
            matches = retrieve.indexed_matches(self.index, self.chunks, asked, fields, where, True)
        else:
            matches = retrieve.keyword_search(self.chunks, asked, fields, where, True, self.config)
        words = retrieve.top(matches, "bm25", max(size + from_, self.config.knn_k), "doc_id")
        hits = words.withColumn("combined", F.round("bm25", 4))
        if self.vectors is not None and any(query_vector):
            allowed = self.chunks.where(where).select(F.col("doc_id").alias("_d"))
            near = retrieve.knn_search(self.vectors.join(allowed, F.col("vec_id") == F.col("_d"), "left_semi"), query_vector, self.config.knn_k).withColumnRenamed("vec_id", "doc_id")
            hits = self.chunks.join(F.broadcast(retrieve.fuse(near, words, "doc_id", self.config)), "doc_id")
        hits = hits.withColumn("highlights", retrieve.highlight(F.col("chunk_text"), terms)).withColumn("snippet", F.coalesce(F.element_at("highlights", 1), F.substring("chunk_text", 1, 200)))
        one = results.gateway_dedup(hits)
        return results.page(one, [F.desc("combined"), "bucket", "filename"], size, from_), results.facets(matches, self.config.facet_sizes), results.total_size(matches)

    def suggest(self, prefix: str, size: int = 5) -> DataFrame:
        return retrieve.suggest(self.chunks, prefix, size)
