"""An approximate vector index: inverted-file lists around trained centroids, product-quantised residuals, exact re-scoring.

Centroids and code books are trained on a sample of at most SAMPLE vectors, chosen by hash; every vector is indexed. A
row has its list, its code (one byte for each part of the residual) and the vector itself. Rows are written by range of
(list, id): a list, however full, is spread over files, and a search reads the row groups of the probed lists only. Codes
give approximate scores; the best of each task, `REFINE` times k, are scored exactly by their vectors.

Vectors are compared by cosine. Those that are null, of another dimension, without length, or with null or non-finite
components take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.sources.readers import exists

#: Vectors that centroids and code books are trained on, at most: 128 MB at 512 dimensions in single precision.
SAMPLE = 65_536
#: Lists of an index, at most; by default as many as the square root of the vectors.
MOST_LISTS = 4096
#: Components of a vector that one code byte stands for.
PART = 4
CODES = 256
#: Candidates, in multiples of k, whose vectors are compared exactly.
REFINE = 8
#: Rows of a list, and queries, that meet in one group.
ROWS, QUERIES = 20_000, 1_000


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k centroids by Lloyd's rounds from k different points; an empty one moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = points[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and its squared distance."""
    own, best = np.empty(len(points), np.int64), np.empty(len(points))
    size = (centres**2).sum(axis=1)
    for a in range(0, len(points), 4096):
        d = size - 2 * points[a : a + 4096] @ centres.T
        own[a : a + 4096] = d.argmin(axis=1)
        best[a : a + 4096] = d.min(axis=1) + (points[a : a + 4096] ** 2).sum(axis=1)
    return own, best


class Model:
    """Centroids and code books of an index."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray):
        self.centroids, self.books = centroids, books  # lists x dim; parts x CODES x PART

    @classmethod
    def train(cls, unit: np.ndarray, lists: int, seed: int = 0) -> Model:
        centroids = kmeans(unit, lists, seed=seed)
        rest = cls._parts(unit - centroids[nearest(unit, centroids)[0]])
        books = np.zeros((rest.shape[1], CODES, PART), np.float32)
        for p in range(rest.shape[1]):
            found = kmeans(rest[:, p], CODES, 8, seed)
            books[p, : len(found)] = found
            books[p, len(found) :] = found[0]
        return cls(centroids.astype(np.float32), books)

    @staticmethod
    def _parts(rows: np.ndarray) -> np.ndarray:
        short = -rows.shape[1] % PART
        return np.pad(rows, ((0, 0), (0, short))).reshape(len(rows), -1, PART)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of each vector."""
        own = nearest(unit, self.centroids)[0]
        rest = self._parts(unit - self.centroids[own])
        return own, np.stack([nearest(rest[:, p], self.books[p])[0] for p in range(rest.shape[1])], axis=1).astype(np.uint8)

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each query."""
        d = (self.centroids**2).sum(axis=1) - 2 * unit @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def scores(self, query: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate dot products of a query with coded vectors: that with the list's centroid, and one table look-up a part."""
        tables = np.einsum("pcd,pd->pc", self.books, self._parts(query[None])[0])
        out = self.centroids[lists] @ query
        for p in range(codes.shape[1]):
            out = out + tables[p][codes[:, p]]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def unit_vectors(vectors: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """key, unit (array<float>) of the vectors that take part."""
    rows = vectors.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    # the sum of squares is null or not finite if a component is
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = rows.where((F.col("length") > 0) & (F.col("length") < float("inf")) & ~F.isnan("length"))
    if dim is not None:
        rows = rows.where(F.size("v") == dim)
    # bound once: the length is not made again for each component
    unit = F.transform(F.arrays_zip("v", F.array_repeat("length", F.size("v")).alias("n")), lambda x: (x["v"] / x["n"]).cast("float"))
    return rows.select("key", unit.alias("unit"))


class VectorIndex:
    """An index in a folder: `model` and `rows`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/rows/_SUCCESS")

    def build(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 0) -> None:
        """Trains on a sample and indexes every vector. The dimension is that which most of the sample have."""
        rows = unit_vectors(vectors, key, vector)
        n = rows.count()
        chosen = [r["unit"] for r in rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample).select("unit").collect()]
        sizes = [len(v) for v in chosen]
        dim = max(set(sizes), key=sizes.count) if sizes else 1
        train = np.array([v for v in chosen if len(v) == dim], np.float32).reshape(-1, dim)
        model = Model.train(train, lists or int(np.clip(round(n**0.5), 1, MOST_LISTS)), seed) if len(train) else Model(np.zeros((1, dim), np.float32), np.zeros((-(-dim // PART), CODES, PART), np.float32))
        facts = [(dim, len(model.centroids), model.centroids.tobytes(), model.books.tobytes())]
        self.spark.createDataFrame(facts, "dim int, lists int, centroids binary, books binary").coalesce(1).write.parquet(f"{self.path}/model")
        kind = rows.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, codes = model.encode(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["list", "key", "code", "unit"])

        coded = unit_vectors(vectors, key, vector, dim).mapInArrow(run, f"list int, key {kind}, code binary, unit array<float>")
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        coded.repartitionByRange(tasks, "list", "key").sortWithinPartitions("list", "key").write.parquet(f"{self.path}/rows")

    def model(self) -> Model:
        r = self.spark.read.parquet(f"{self.path}/model").first()
        return Model(np.frombuffer(r["centroids"], np.float32).reshape(r["lists"], r["dim"]), np.frombuffer(r["books"], np.float32).reshape(-1, CODES, PART))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, query: list[float], k: int, probe: int, refine: int = REFINE) -> DataFrame:
        """key, cosine of about the k nearest of one vector (ties: least key): one scan of the probed lists."""
        model = self.model()
        dim = model.centroids.shape[1]
        q = np.asarray(query, np.float32)
        length = float(np.sqrt((q.astype(float) ** 2).sum()))
        rows = self.rows()
        kind = f"key {rows.schema['key'].dataType.simpleString()}, cosine double"
        if len(q) != dim or not length or not np.isfinite(length):
            return self.spark.createDataFrame([], kind)
        q = q / np.float32(length)
        probed = [int(x) for x in model.probes(q[None], probe)[0]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.array([np.frombuffer(c, np.uint8) for c in batch.column(2).to_pylist()]).reshape(batch.num_rows, -1)
                keep = _best(model.scores(q, batch.column(0).to_numpy(), codes), refine * k)
                exact = _matrix(batch.column(3).take(pa.array(keep)), dim).astype(float) @ q.astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep)), pa.array(exact)], names=["key", "cosine"])

        found = rows.where(F.col("list").isin(probed)).select("list", "key", "code", "unit").mapInArrow(run, kind)
        return found.orderBy(F.desc(F.round("cosine", 9)), "key").limit(k)

    def search_all(self, queries: DataFrame, k: int, probe: int, refine: int = REFINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, key, cosine of about the k nearest of each row of queries, other than itself. Queries meet the chunks of their lists, so no group holds more than ROWS rows and QUERIES queries."""
        model = self.model()
        dim = model.centroids.shape[1]
        rows = self.rows()
        kind = rows.schema["key"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = model.probes(_matrix(batch.column(1), dim), probe)
                at = np.repeat(np.arange(batch.num_rows), lists.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["list", "query_id", "q"])

        asked = unit_vectors(queries, key, vector, dim).mapInArrow(place, f"list int, query_id {kind}, q array<float>")
        # chunks and blocks are dealt by hash, as many as each list needs
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("chunks"))
        blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        plan = F.broadcast(sizes.join(blocks, "list"))  # one row a list, MOST_LISTS at most
        left = rows.join(plan, "list").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        by = ["list", "chunk", "block"]

        def meet(these: pa.Table, those: pa.Table) -> pa.Table:
            out = []
            if these.num_rows and those.num_rows:
                own = these.column("list").to_numpy()
                codes = np.array([np.frombuffer(c, np.uint8) for c in these.column("code").to_pylist()]).reshape(len(own), -1)
                units = _matrix(these.column("unit").combine_chunks(), dim).astype(float)
                keys = these.column("key")
                for i, q in enumerate(_matrix(those.column("q").combine_chunks(), dim)):
                    best = _best(model.scores(q, own, codes), refine * k)
                    exact = units[best] @ q.astype(float)
                    best, exact = best[order := _best(exact, k + 1)], exact[order]
                    out.append(pa.table({"query_id": those.column("query_id").slice(i, 1).combine_chunks().take(pa.array(np.zeros(len(best), np.int64))), "key": keys.take(pa.array(best)).combine_chunks(), "cosine": exact}))
            return pa.concat_tables(out) if out else pa.table({"query_id": these.column("key").slice(0, 0), "key": these.column("key").slice(0, 0), "cosine": pa.array([], pa.float64())})

        met = left.select(*by, "key", "code", "unit").groupBy(*by).cogroup(right.select(*by, "query_id", "q").groupBy(*by)).applyInArrow(meet, f"query_id {kind}, key {kind}, cosine double")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "key")
        return met.where(F.col("key") != F.col("query_id")).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "key", "cosine")


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores, in order of place."""
    return np.arange(len(scores)) if len(scores) <= n else np.sort(np.argpartition(-scores, n - 1)[:n])
