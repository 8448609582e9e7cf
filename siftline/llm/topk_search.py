"""Exact top-k by inner product over integer vectors: columnar branch and bound.

Queries are cut into blocks and candidates into chunks; a task holds one of each. Inside it the chunk
lies in vertical layout (a matrix per block of dimensions). Scores of a query accumulate block by block,
heaviest blocks first; a candidate whose partial score plus the most that its remaining blocks can add
(product of the remaining lengths) is below the k-th best partial score minus its own remaining mass
cannot reach the result, and survivors are compacted. Local results merge by a second top-k.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of
different lengths are never compared; equal scores rank by smaller id; repeated ids are separate
candidates, but a query never meets a row of its own id; a query row that is repeated gives one result, an id
with several vectors one for each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CHUNK = 8192
BLOCK_DIMS = 8
SCALE = 64.0


def search_chunk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one chunk for each query, as (query number, candidate number, score)."""
    n, dims = vectors.shape
    cuts = list(range(0, dims, BLOCK_DIMS))
    columns = [np.ascontiguousarray(vectors[:, a : a + BLOCK_DIMS]) for a in cuts]
    mass = np.stack([np.einsum("ij,ij->i", c, c) for c in columns])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole = mass.mean(axis=1)
    for row, (qid, query) in enumerate(zip(query_ids, queries, strict=True)):
        parts = [query[a : a + BLOCK_DIMS] for a in cuts]
        weight = np.array([p @ p for p in parts])
        order = np.argsort(-weight * whole, kind="stable")
        alive = np.flatnonzero(ids != qid)
        partial = np.zeros(len(alive))
        left_query = weight.sum()
        left = mass[:, alive].sum(axis=0)
        for step, b in enumerate(order):
            partial += columns[b][alive] @ parts[b]
            left_query = max(left_query - weight[b], 0.0)
            left = np.maximum(left - mass[b, alive], 0.0)
            if len(alive) > k and step + 1 < len(order):
                rest = np.sqrt(left_query * left) * (1 + 1e-9) + 1e-6
                least = np.partition(partial - rest, len(alive) - k)[len(alive) - k]
                keep = partial + rest >= least
                if keep.sum() < 0.8 * len(alive):
                    alive, partial, left = alive[keep], partial[keep], left[keep]
        best = np.lexsort((ids[alive], -partial))[:k]
        found.append((np.full(len(best), row), alive[best], partial[best]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, int),) * 3


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: float = SCALE, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query with the other rows.

    Scores are exact while sums of products stay below 2**53 (components below 2**23 at 64 dimensions).
    """
    whole = (
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(embedding).alias("raw"))
        .where(F.col("vec_id").isNotNull() & (F.size("raw") > 0) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))))
        .drop("raw")
    )
    sizes = whole.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    chunks, blocks = max(1, -(-sizes["n"] // CHUNK)), max(1, -(-sizes["q"] // QUERY_BLOCK))
    spread = F.xxhash64("vec_id", "v")
    candidates = whole.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.size("v").alias("dims"), F.pmod(spread, F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # rows that repeat a query are one query; an id with two vectors asks twice
    asked = whole.where("is_query").select("vec_id", "v").distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.xxhash64("v").alias("query_key"), F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []})
        query_ids, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        q, c, s = search_chunk(query_ids, np.stack(left["query"].to_numpy()), ids, np.stack(right["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": query_ids[q], "query_key": left["query_key"].to_numpy()[q], "vec_id": ids[c], "score": np.rint(s).astype(np.int64)})

    near = asked.groupBy("block", "chunk", "dims").cogroup(candidates.groupBy("block", "chunk", "dims")).applyInPandas(local, "query_id long, query_key long, vec_id long, score long")
    best = near.groupBy("query_id", "query_key").applyInArrow(lambda table: _merge(table, k), "query_id long, rank int, vec_id long, score long")
    return best


def _merge(table, k: int):
    import pyarrow as pa

    table = table.sort_by([("score", "descending"), ("vec_id", "ascending")]).slice(0, k)
    return table.select(["query_id"]).append_column("rank", pa.array(range(1, table.num_rows + 1), pa.int32())).append_column("vec_id", table["vec_id"]).append_column("score", table["score"])


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS query, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
