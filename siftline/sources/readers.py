"""Sources and sinks: message topics, files, versions of small tables. The chunk table is in `chunk_store`."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPIC, DEAD_TOPIC = "file-upload-events", "file-upload-events-dlq"
#: Columns of a message; a resent one also has how often it was tried again.
MESSAGE = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
# Types by file suffix (fixed values).
SUFFIXES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def kafka_stream(spark: SparkSession, servers: str, topic: str = TOPIC, most: int | None = None) -> DataFrame:
    """Events from the earliest offset on; offsets live in the query's checkpoint. Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return (reader.option("maxOffsetsPerTrigger", most) if most else reader).load()


def kafka_table(spark: SparkSession, servers: str, topic: str = DEAD_TOPIC) -> DataFrame:
    """A topic's messages for inspection."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select("topic", "partition", "offset", "timestamp", F.col("key").cast("string"), F.col("value").cast("string"))


def file_stream(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Messages as JSON lines in a folder: the same columns without a broker."""
    reader = spark.readStream.schema(MESSAGE + ", retry_count int").option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", most) if most else reader).json(path)


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, filename, content, size, content_type by suffix."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    kinds = F.create_map(*[F.lit(v) for pair in SUFFIXES.items() for v in pair])
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("size"), F.coalesce(F.element_at(kinds, suffix), F.lit("application/octet-stream")).alias("content_type"))


def fetch(records: DataFrame, root: str, key: str = "object_key") -> DataFrame:
    """records with content and fetch_error of the object root/key, read where the records are; a file that can't be read has an error."""
    names = records.columns
    schema = T.StructType([*records.schema, T.StructField("content", T.BinaryType()), T.StructField("fetch_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for i, path in enumerate(batch.column(names.index(key)).to_pylist()):
                content = error = None
                try:
                    if ".." in path.split("/"):
                        raise OSError("a path outside the store")
                    with store.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        content = stream.read()
                except (OSError, pa.ArrowException) as e:
                    error = type(e).__name__ + ": " + str(e)[:200]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*names, "content", "fetch_error"])

    return records.mapInArrow(run, schema)


def put_objects(rows: DataFrame, root: str) -> DataFrame:
    """Writes objects (bucket, key, content, content_type) to root/bucket/key where the rows are; the events of their creation as messages (key, value, topic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                place, content = f"{r['bucket']}/{r['key']}", r["content"] or b""
                if ".." in place.split("/"):
                    raise ValueError("a path outside the store")
                store.create_dir(f"{base.rstrip('/')}/{place}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base.rstrip('/')}/{place}") as stream:
                    stream.write(content)
                event = {"eventName": "s3:ObjectCreated:Put", "s3": {"bucket": {"name": r["bucket"]}, "object": {"key": quote(r["key"], safe="/"), "size": len(content), "contentType": r["content_type"]}}}
                out.append((place, json.dumps({"Records": [event]}), TOPIC))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, names=["key", "value", "topic"])

    return rows.select("bucket", "key", "content", "content_type").mapInArrow(run, "key string, value string, topic string")


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _files(spark, path)
    fs.delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _files(spark, path)
    return fs.exists(jpath)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    jpath, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without one takes its warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return where.rstrip("/")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a table's whole versions (folders v-<number> whose write was committed), in order."""
    return sorted(int(n[2:]) for n in folders(spark, path) if n.startswith("v-") and n[2:].isdigit() and exists(spark, f"{path}/{n}/_SUCCESS"))


def point_get(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("_id") == key)


def swap_in(df: DataFrame, path: str) -> None:
    """Writes the next version of a table: a single writer's copy-on-write.

    A version counts once its write is committed, so a crash at any point leaves a whole table. The version
    before stays for readers that still use it; older ones go.
    """
    spark = df.sparkSession
    now = versions(spark, path)
    after = now[-1] + 1 if now else 0
    df.write.mode("overwrite").parquet(f"{path}/v-{after}")
    for old in now[:-1]:
        jpath, fs = _files(spark, f"{path}/v-{old}")
        fs.delete(jpath, True)


def append_json(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds rows to a topic's folder; those of a named batch are written once, however often the batch is repeated.

    Names are for a folder and all time: a stream's batches carry its query's id, which a new checkpoint changes.
    """
    if batch is None:
        df.write.mode("append").json(path)
    elif not exists(df.sparkSession, f"{path}/batch={batch}/_SUCCESS"):
        df.write.mode("overwrite").json(f"{path}/batch={batch}")
