"""The merge-on-read chunk table: merges, crashes, writers, look-ups, reindexing, retries in state."""

import json
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.config import RetryPolicy
from siftline.sources import chunk_store, readers
from siftline.sources.chunk_store import Alias, ChunkStore
from siftline.streaming import ingestion, retry

SCHEMA = "_id string, object_key string, size_bytes long, author string"


def store(spark, path, **options):
    kinds = spark.createDataFrame([], SCHEMA).schema
    return ChunkStore(spark, str(path), kinds, **options)


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def files(spark, names):
    return spark.createDataFrame([(n,) for n in names], "object_key string")


class Model:
    """The table as a dict, commit by commit."""

    def __init__(self):
        self.now = {}

    def commit(self, upserts, deleted, replaced):
        written = {r[0] for r in upserts}
        self.now = {k: v for k, v in self.now.items() if v[1] not in deleted and not (v[1] in replaced and k not in written)}
        for r in upserts:
            old = self.now.get(r[0], (None,) * 4)
            self.now[r[0]] = tuple(n if n is not None else o for n, o in zip(r, old, strict=True))


@pytest.mark.parametrize("few", [0, 500_000])
def test_against_a_model(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(chunk_store, "FEW", few)
    rng, table, model = random.Random(few), store(spark, tmp_path / "t", buckets=3, compact_after=4), Model()
    for turn in range(7):
        gone = {f"f{rng.randrange(6)}" for _ in range(rng.randrange(2))}
        anew = {f"f{rng.randrange(6)}" for _ in range(rng.randrange(3))} - gone
        new = {}
        for _ in range(rng.randrange(1, 12)):
            f = f"f{rng.randrange(6)}"
            if f not in gone:
                key = f"{f}#{rng.randrange(4)}"
                new[key] = (key, f, rng.choice([None, turn]), rng.choice([None, f"a{turn}"]))
        table.commit(spark.createDataFrame(list(new.values()), SCHEMA), files(spark, gone), files(spark, anew), ("q", turn))
        model.commit(list(new.values()), gone, anew)
        assert rows(table.read()) == sorted(model.now.values(), key=str)
        some = next(iter(model.now), "none")
        assert rows(table.get(some)) == [model.now[some]] if some in model.now else rows(table.get(some)) == []
    kinds = [e["kind"] for e in table.log()]
    assert kinds[0] == "base" and len(kinds) < 6
    table.vacuum()
    assert rows(table.read()) == sorted(model.now.values(), key=str)


def test_a_batch_writes_its_own_rows_once(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    table.commit(spark.createDataFrame([(f"a#{i}", "a", i, "x") for i in range(1000)], SCHEMA), batch=("q", 0))
    table.compact()
    before = set(readers.folders(spark, f"{tmp_path}/t"))
    done = table.commit(spark.createDataFrame([("a#1", "a", 7, None), (None, "a", 1, "x"), ("b#0", "b", -1, "x")], SCHEMA), batch=("q", 1), check=F.when(F.col("size_bytes") < 0, F.concat(F.lit("size "), F.col("size_bytes"))))
    assert (done.success, done.failed, done.reasons) == (1, 2, {"no key": 1, "size -1": 1})
    assert sorted(r._error for r in table.refused(done.version).collect()) == ["no key", "size -1"]
    (delta,) = set(readers.folders(spark, f"{tmp_path}/t")) - before
    assert spark.read.parquet(f"{tmp_path}/t/{delta}").count() == 3
    again = table.commit(spark.createDataFrame([("a#1", "a", 8, None)], SCHEMA), batch=("q", 1))
    assert again.version is None and table.get("a#1").first().size_bytes == 7 and table.read().count() == 1000
    assert "PartitionFilters: [isnotnull(_bucket" in table.get("a#1")._jdf.queryExecution().toString()


def test_a_crash_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    table = store(spark, tmp_path / "t")
    table.commit(spark.createDataFrame([("a#0", "a", 1, "x")], SCHEMA), batch=("q", 0))
    want, batch = rows(table.read()), spark.createDataFrame([("a#0", "a", 2, "y"), ("b#0", "b", 1, "z")], SCHEMA)

    def lost(*_):
        raise RuntimeError("lost")

    # the delta is written, the entry is not
    monkeypatch.setattr(ChunkStore, "_add", lost)
    with pytest.raises(RuntimeError):
        table.commit(batch, batch=("q", 1))
    monkeypatch.undo()
    assert rows(table.read()) == want
    # the entry was written aside and not renamed; the delta is half written
    (tmp_path / "t" / "_log" / ".half").write_text('{"kind": "del')
    (tmp_path / "t" / "delta-half").mkdir()
    (tmp_path / "t" / "delta-half" / "part-0.parquet").write_bytes(b"PAR1")
    assert rows(table.read()) == want
    # the batch comes again and is in; then it comes once more
    assert table.commit(batch, batch=("q", 1)).success == 2
    want = rows(table.read())
    assert want == [("a#0", "a", 2, "y"), ("b#0", "b", 1, "z")] and table.commit(batch, batch=("q", 1)).version is None
    # compaction writes its base and dies before its entry
    monkeypatch.setattr(ChunkStore, "_commit", lost)
    with pytest.raises(RuntimeError):
        table.compact()
    monkeypatch.undo()
    assert rows(table.read()) == want and table.compact() and rows(table.read()) == want
    assert table.commit(batch, batch=("q", 1)).version is None  # a base keeps what is in
    gone = table.vacuum()
    assert {"delta-half"} < set(gone) and rows(table.read()) == want


def test_two_writers_take_different_numbers(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    table.create()
    assert table._commit({"kind": "delta", "folder": "x"}, 1) and not table._commit({"kind": "delta", "folder": "y"}, 1)
    assert [e["folder"] for e in table.log()[1:]] == ["x"]
    # a commit that comes while the table is compacted stays with the old base
    other = store(spark, tmp_path / "u")
    other.commit(spark.createDataFrame([("a", "f", 1, "x")], SCHEMA))
    log = other.log
    other.log = lambda: (found := log(), store(spark, tmp_path / "u").commit(spark.createDataFrame([("b", "f", 1, "x")], SCHEMA)))[0]
    assert not other.compact()
    other.log = log
    assert [r[0] for r in rows(other.read())] == ["a", "b"]


def record(name, key):
    return f'{{"Records":[{{"eventName":"s3:{name}","s3":{{"bucket":{{"name":"u"}},"object":{{"key":"{key}","size":10,"contentType":"text/plain"}}}}}}]}}'


def test_reindexing_behind_an_alias(spark, tmp_path, monkeypatch):
    """Readers see the old table or the whole new one, also when events come while it is built."""
    (tmp_path / "store" / "u").mkdir(parents=True)
    send = lambda names, at: spark.createDataFrame([("k", record("ObjectCreated:Put", n), "t", 0, at, datetime(2024, 1, 1, 0, 0, at)) for n in names], readers.MESSAGE).write.mode("append").json(f"{tmp_path}/in")
    for n in "abc":
        (tmp_path / "store" / "u" / n).write_text(f"text of {n} " * 10)
    send("ab", 1)
    alias, stream = f"{tmp_path}/alias", lambda: readers.file_stream(spark, f"{tmp_path}/in")
    Alias(spark, alias).switch(f"{tmp_path}/one")
    ingestion.start(stream(), alias, f"{tmp_path}/dead", f"{tmp_path}/ck", store=f"{tmp_path}/store").awaitTermination(120)
    names = lambda: sorted({r.filename for r in chunk_store.chunk_table(spark, alias).collect()})
    assert names() == ["a", "b"]
    seen, start = [], ingestion.start

    def watched(*args, **kwargs):
        seen.append(names())
        if len(seen) == 2:
            send("c", 2)
        return start(*args, **kwargs)

    monkeypatch.setattr(ingestion, "start", watched)
    ingestion.reindex(spark, stream(), alias, f"{tmp_path}/two", f"{tmp_path}/dead", f"{tmp_path}/ck2", store=f"{tmp_path}/store")
    assert all(s in (["a", "b"], ["a", "b", "c"]) for s in seen) and names() == ["a", "b", "c"]
    assert Alias(spark, alias).target() == f"{tmp_path}/two"


def test_letters_wait_in_state_until_no_attempt_is_left(spark, tmp_path):
    """Three waits and exhaustion; while a letter waits nothing is written."""
    policy = RetryPolicy(max_attempts=3, schedule=(2, 3, 4))
    payload, at = record("ObjectCreated:Put", "gone"), lambda: datetime.now().astimezone().isoformat(timespec="milliseconds")
    text = lambda where, kinds: spark.read.option("recursiveFileLookup", "true").schema(kinds).json(f"{tmp_path}/{where}").collect()

    def fail(count):
        letter = json.dumps({"original_payload": payload, "error": "e", "bucket": "u", "key": "gone", "failed_at": at(), "retry_count": count})
        spark.createDataFrame([(letter,), (letter,), ("no letter",)], "value string").coalesce(1).write.mode("append").json(f"{tmp_path}/dead")
        return time.time()

    for folder in ("dead", "main", "log"):
        (tmp_path / folder).mkdir()
    letters = spark.readStream.schema("value string").json(f"{tmp_path}/dead")
    query = retry.start_waiting(letters, f"{tmp_path}/main", f"{tmp_path}/log", f"{tmp_path}/ck", policy, "500 milliseconds")
    try:
        for count, wait in enumerate(policy.schedule):
            began = fail(count)
            while len(text("main", "value string, retry_count int")) <= count and time.time() < began + 90:
                time.sleep(0.3)
            assert time.time() - began >= wait
            assert sorted((r.value, r.retry_count) for r in text("main", "value string, retry_count int")) == [(payload, n + 1) for n in range(count + 1)]
        began = fail(3)
        while not text("log", "value string") and time.time() < began + 90:
            time.sleep(0.3)
        (spent,) = text("log", "value string")
        assert json.loads(spent.value)["retry_count"] == 3 and json.loads(spent.value)["permanently_failed_at"]
        assert len(text("main", "value string")) == 3 and len(text("dead", "value string")) == 12
    finally:
        query.stop()
