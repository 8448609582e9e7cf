"""Helpers of the corpus operators: checkpoints, bounded Arrow slices, words as dictionary codes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once in a Python worker.
SLICE_BYTES = 8 << 20
#: The same where a word takes a hundred bytes and more of arrays meanwhile.
SMALL_SLICE = 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without one takes its warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return where.rstrip("/")


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: the lineage ends here and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_out(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by write_out that no later plan reads."""
    for frame in frames:
        for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Lets shuffle files of finished tables go: Spark deletes them when the driver's garbage is collected, else up to half an hour later."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of keys, 8 to 16 bytes each, that may be broadcast: at most 32 MB. More are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def among(df: DataFrame, column: str, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose column is a key of the written table keys; the keys travel to the rows if they are counted to be few, else both are shuffled."""
    few = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, F.col(column) == F.col(key), how)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in upper or lower case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of doc_id and text, and that column's name: rows without doc_id, or that repeat one with another text, have keys of their own."""
    name = fresh_name(docs, "row_key")
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))), name


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: dict[str, str] | None = None) -> DataFrame:
    """df.mapInArrow(run) for a df with columns of any names: inside they are c0, c1, ...; `added` names and types what run adds behind them."""
    added = added or {}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*plain.schema, *[T.StructField(f"a{i}", T._parse_datatype_string(kind)) for i, kind in enumerate(added.values())]])
    return plain.mapInArrow(trimmed(run), schema).toDF(*df.columns, *added)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which the worker, which stays for later tasks, gives its free memory back to the system."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return inside


#: Bytes of an Arrow batch between the executor and its worker.
BATCH_BYTES = 6 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session by bytes: 10,000 rows of long texts would take hundreds of MB on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_array(column: pa.Array) -> pa.Array:
    """The texts as large strings, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `most` bytes of text; a longer single text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = (np.cumsum(lengths) - lengths) // most
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space as (codes, offsets, distinct words): text i has codes[offsets[i]:offsets[i + 1]]."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary
    blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py() if len(distinct) else -1
    if blank >= 0:
        keep = codes != blank
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets]
    return codes, offsets, distinct


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of each text as (values, offsets); a text of 1 to k - 1 words is one shingle."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(out[-1]) - out[text] + offsets[text]
    end = offsets[text + 1]
    value = np.full(out[-1], 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        here = at + j
        word = hashes[np.minimum(here, len(hashes) - 1)]
        value = mix(value * np.uint64(0x100000001B3) + np.where(here < end, word, np.uint64(j + 1)))
    return value, out


def minimum_of(values: np.ndarray, offsets: np.ndarray, fill: int) -> np.ndarray:
    """The minimum of each run; runs without values get fill."""
    out = np.full(len(offsets) - 1, fill, values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, offsets[:-1][full])
    return out


def sum_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each run."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
