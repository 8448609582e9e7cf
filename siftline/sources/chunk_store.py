"""The chunk table, merged on reading: a bucketed base, delta files, tombstones and a commit log.

A commit writes only its own rows: upserts, and tombstones of files. It counts once its entry `_log/<number>.json` stands,
which is written aside and renamed to a name that must not exist, so a crash at any point leaves a whole table and of two
writers one tries the next number. A batch of a query that is repeated changes nothing: entries carry the query and
number of their batch.

Reading takes base rows that no delta touches as they are; only touched rows and the deltas meet by key. Of a key's rows in
order of commits those count that no later tombstone of their file has cut off, and each column has its last value that is
not null. A tombstone `delete` cuts off all older rows of a file, `replace` those that its own commit doesn't write again.
Compaction writes the merged table as a new base, in folders by bucket of the key, so a look-up by key reads one bucket.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.schema import CHUNK
from siftline.sources.readers import folders

#: Keys or files of deltas, counted in the log, that may be broadcast: some 100 bytes each.
FEW = 500_000
BUCKETS = 16
#: Deltas after which a commit compacts the table.
COMPACT_AFTER = 20


@dataclass(frozen=True)
class Outcome:
    """What became of a batch: rows written, rows refused by reason, and the commit (None: the batch was in already)."""

    success: int
    failed: int
    reasons: dict[str, int]
    version: int | None


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = CHUNK, key: str = "_id", file: str = "object_key", buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.schema, self.key, self.file, self.buckets, self.compact_after = spark, path.rstrip("/"), schema, key, file, buckets, compact_after

    # ---- the log -------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, number: int) -> dict:
        jpath, fs = self._fs(f"{self.path}/_log/{number:09d}.json")
        stream = fs.open(jpath)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in folders(self.spark, f"{self.path}/_log") if n.endswith(".json"))

    def log(self) -> list[dict]:
        """The entries that the table is made of: the last base and what came after."""
        out = []
        for number in reversed(self.versions()):
            out.append(self._entry(number) | {"version": number})
            if out[-1]["kind"] == "base":
                break
        return out[::-1]

    def _commit(self, entry: dict, number: int) -> bool:
        """Whether the entry got the number."""
        aside, fs = self._fs(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{number:09d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(place), none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(aside, False)
            return False
        return True

    def _add(self, entry: dict) -> int:
        while True:
            number = (self.versions() or [-1])[-1] + 1
            if self._commit(entry, number):
                return number

    def create(self) -> None:
        """An empty table, unless there is one."""
        if not self.versions():
            self._commit({"kind": "base", "folder": None, "rows": 0, "batches": {}}, 0)

    # ---- writing -------------------------------------------------------------------------------------

    def commit(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None, replaced: DataFrame | None = None, batch: tuple[str, int] | None = None, order: Column | None = None, check: Column | None = None) -> Outcome:
        """Adds a batch: upserts (some columns of the table; nulls keep old values), deleted and replaced files (one column each).

        Rows without key, and those that `check` names a reason for, are refused: they stay in the delta with the reason (see
        `refused`), and counted by reason while it is written, in the same pass. Of rows that share a key the last by
        `order` counts (default: the greatest).
        """
        self.create()
        log = self.log()
        last = {q: n for e in log for q, n in e.get("batches", {}).items()}
        if batch and last.get(batch[0], -1) >= batch[1]:
            return Outcome(0, 0, {}, None)
        parts = []
        kinds = {"_error": T.StringType()} | {f.name: f.dataType for f in self.schema}

        def whole(df: DataFrame, op: str) -> DataFrame:
            return df.select(F.lit(op).alias("_op"), *[(F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])

        if upserts is not None:
            names = [c for c in upserts.columns if c in self.schema.names]
            reason = F.when(F.col(self.key).isNull(), F.lit("no key"))
            marked = upserts.withColumn("_error", reason if check is None else F.coalesce(reason, check))
            row = F.struct(*names, "_error")
            good = marked.where("_error IS NULL").groupBy(F.col(self.key).alias("_k")).agg(F.max_by(row, F.struct(*names) if order is None else order).alias("r")).select("r.*")
            parts += [whole(good, "upsert"), whole(marked.where("_error IS NOT NULL").select(*names, "_error"), "refused")]
        for op, files in (("delete", deleted), ("replace", replaced)):
            if files is not None:
                parts.append(whole(files.toDF(self.file).where(F.col(self.file).isNotNull()).distinct(), op))
        if not parts:
            return Outcome(0, 0, {}, None)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        folder = f"delta-{uuid.uuid4().hex}"
        seen = Observation()
        counts = [F.count_if(F.col("_op") == op).alias(op) for op in ("upsert", "refused", "delete", "replace")]
        rows.observe(seen, *counts).write.parquet(f"{self.path}/{folder}")
        n = seen.get
        by_reason = {}
        if n["refused"]:
            by_reason = {r["_error"]: r["n"] for r in self._delta(folder).where("_op = 'refused'").groupBy("_error").agg(F.count("*").alias("n")).collect()}
        entry = {"kind": "delta", "folder": folder, "upserts": n["upsert"], "tombstones": n["delete"] + n["replace"], "refused": n["refused"], "batches": {batch[0]: batch[1]} if batch else {}}
        version = self._add(entry)
        if sum(e["kind"] == "delta" for e in log) + 1 >= self.compact_after:
            self.compact()
        return Outcome(n["upsert"], n["refused"], by_reason, version)

    def refused(self, version: int) -> DataFrame:
        """The rows that a commit refused, with `_error`."""
        entry = self._entry(version)
        return self._delta(entry["folder"]).where("_op = 'refused'").drop("_op")

    def _delta(self, folder: str) -> DataFrame:
        kinds = T.StructType([T.StructField("_op", T.StringType()), T.StructField("_error", T.StringType()), *self.schema])
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{folder}")

    # ---- reading -------------------------------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _base(self, entry: dict) -> DataFrame:
        if entry["folder"] is None:
            return self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())]))
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.path}/{entry['folder']}")

    def read(self, log: list[dict] | None = None, where_key: str | None = None) -> DataFrame:
        """The table as the log has it; with where_key the row of one key, from its bucket."""
        log = log or self.log()
        if not log:
            raise ValueError(f"no chunk table in {self.path}")
        base = self._base(log[0])
        if where_key is not None:
            base = base.where((F.col("_bucket") == self._bucket(F.lit(where_key))) & (F.col(self.key) == where_key))
        base = base.select(*self.schema.names)
        deltas = [e for e in log if e["kind"] == "delta"]
        if not deltas:
            return base
        rows = None
        for e in deltas:
            part = self._delta(e["folder"]).where("_op <> 'refused'").drop("_error").withColumn("_seq", F.lit(e["version"]))
            rows = part if rows is None else rows.unionByName(part)
        upserts, stones = rows.where("_op = 'upsert'").drop("_op"), rows.where("_op <> 'upsert'").select("_op", self.file, "_seq")
        if where_key is not None:
            upserts = upserts.where(F.col(self.key) == where_key)
        hint = lambda df, name: F.broadcast(df) if sum(e[name] for e in deltas) <= FEW else df
        keys = hint(upserts.select(F.col(self.key).alias("_k")).distinct(), "upserts")
        # what each file's tombstones are: the last commit that deletes it, and those that replace it
        cuts = stones.groupBy(F.col(self.file).alias("_f")).agg(F.max(F.when(F.col("_op") == "delete", F.col("_seq"))).alias("_deleted"), F.collect_set(F.when(F.col("_op") == "replace", F.col("_seq"))).alias("_replaced"))
        cuts = hint(cuts, "tombstones")
        marked = base.join(keys, F.col(self.key) == F.col("_k"), "left").join(cuts.select(F.col("_f").alias("_cut")), F.col(self.file) == F.col("_cut"), "left")
        untouched = marked.where("_k IS NULL AND _cut IS NULL").select(*self.schema.names)
        touched = marked.where("_k IS NOT NULL OR _cut IS NOT NULL").select(*self.schema.names).withColumn("_seq", F.lit(-1))
        return untouched.unionByName(self._merged(touched.unionByName(upserts), cuts))

    def _merged(self, rows: DataFrame, cuts: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key]
        with_cuts = rows.join(cuts, F.col(self.file) == F.col("_f"), "left")
        # a key has one row for each commit since the last compaction at most, and its file's tombstones are as few
        each = F.struct("_seq", *rest)
        found = with_cuts.groupBy(self.key).agg(F.sort_array(F.collect_list(each)).alias("r"), F.max("_deleted").alias("_deleted"), F.flatten(F.collect_set(F.coalesce("_replaced", F.array().cast("array<int>")))).alias("_replaced"))
        written = F.transform("r", lambda x: x["_seq"])
        missed = F.array_max(F.filter("_replaced", lambda v: ~F.array_contains(F.col("written"), v)))
        found = found.withColumn("written", written).withColumn("cut", F.greatest(F.coalesce("_deleted", F.lit(-2)), F.coalesce(missed, F.lit(-2))))
        # a row that its own commit deletes can't be: a batch has one last event a file
        found = found.withColumn("r", F.reverse(F.filter("r", lambda x: x["_seq"] >= F.col("cut")))).where(F.size("r") > 0)
        last = lambda c: F.try_element_at(F.filter(F.transform("r", lambda x: x[c]), lambda v: v.isNotNull()), F.lit(1))
        kinds = {f.name: f.dataType for f in self.schema}
        return found.select(*[F.col(self.key) if c == self.key else last(c).cast(kinds[c]).alias(c) for c in self.schema.names])

    def get(self, key: str) -> DataFrame:
        return self.read(where_key=key)

    # ---- upkeep --------------------------------------------------------------------------------------

    def compact(self) -> bool:
        """Writes the table as a new base; False if a commit came meanwhile, which then stays with the old one."""
        log = self.log()
        if len(log) == 1:
            return True
        folder = f"base-{uuid.uuid4().hex}"
        rows = self.read(log).withColumn("_bucket", self._bucket(F.col(self.key)))
        rows.repartition(self.buckets, "_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        batches: dict[str, int] = {}
        for e in log:
            batches |= e.get("batches", {})
        empty = not any(n.startswith("_bucket=") for n in folders(self.spark, f"{self.path}/{folder}"))
        return self._commit({"kind": "base", "folder": None if empty else folder, "batches": batches}, log[-1]["version"] + 1)

    def vacuum(self) -> list[str]:
        """Deletes folders and entries that the table is no longer made of; readers that began before the last compaction must have ended."""
        log = self.log()
        used = {e["folder"] for e in log}
        gone = [n for n in folders(self.spark, self.path) if n.startswith(("base-", "delta-")) and n not in used]
        gone += [f"_log/{v:09d}.json" for v in self.versions() if v < log[0]["version"]]
        for name in gone:
            jpath, fs = self._fs(f"{self.path}/{name}")
            fs.delete(jpath, True)
        return gone


class Alias:
    """A name that stands for one of several tables: the last entry of its own log, so that readers go over in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = ChunkStore(spark, path)

    def target(self) -> str | None:
        """The folder of the table; None if the path is no alias."""
        numbers = self.log.versions()
        return self.log._entry(numbers[-1]).get("target") if numbers else None

    def switch(self, target: str) -> None:
        self.log._add({"kind": "alias", "target": target})


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of a folder, or of an alias of that name."""
    return ChunkStore(spark, Alias(spark, path).target() or path).read()


def create_chunk_table(spark: SparkSession, path: str) -> None:
    """An empty table with the declared schema, unless there is one."""
    ChunkStore(spark, path).create()
