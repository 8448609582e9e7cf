"""Settings of the search and ingestion engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    knn_k: int = 50
    knn_weight: float = 0.6
    bm25_weight: float = 0.4
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.45
    default_limit: int = 10
    max_limit: int = 50
    rerank_pool: int = 15
    rerank: bool = True
    fast_path_score: float = 0.95
    fast_path_gap: float = 0.2
    time_zone: str = "+05:30"
    filter_scope: str = "bm25"  # or "both"
    facet_sizes: tuple[tuple[str, int], ...] = (("extension", 20), ("bucket", 10), ("owner", 20))
    fuzzy_prefix: int = 2
    fuzzy_expansions: int = 50


@dataclass(frozen=True)
class IngestConfig:
    chunk_size: int = 600
    chunk_overlap: int = 60
    min_chunk: int = 20
    max_file_bytes: int = 100 * 1024 * 1024
    max_image_bytes: int = 50 * 1024 * 1024
    image_side: int = 224
    bulk_batch: int = 200
    public_url: str = "http://localhost:9000"
    retries: int = 5
    retry_base_seconds: float = 1.0
    retry_cap_seconds: float = 30.0


@dataclass(frozen=True)
class CachePolicy:
    """seconds to live; promotion at `popular_at` hits. at_read: promote while reading, else while writing."""

    default_ttl: int = 300
    filtered_ttl: int = 600
    popular_ttl: int = 1800
    popular_at: int = 10
    at_read: bool = True


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 3
    schedule: tuple[int, ...] = (60, 300, 900)
