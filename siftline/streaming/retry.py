"""Dead letters that wait in keyed state: a timer for each letter, nothing written until it is due.

A letter's state is its payload and count; a processing-time timer fires when its wait is over, then the payload goes to
the main topic with its count. Spent letters go to the permanent log at once. State that no timer took away ends by
its time to live. Needs the RocksDB state store (set on the session where it isn't).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from siftline.config import RetryPolicy
from siftline.operators import dead_letters
from siftline.sources.readers import append_json
from siftline.streaming.ingestion import batch_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "kind string, value string, retry_count int"


class Waiting(StatefulProcessor):
    """One letter by key: resent when its timer fires. The same letter, delivered again, waits once."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.letter = handle.getValueState("letter", "value string, retry_count int", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = next((r for frame in rows for r in frame.itertuples()), None)
        if first is None or self.letter.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if first.action == "permanent":
            yield pd.DataFrame({"kind": ["permanent"], "value": [first.value], "retry_count": [first.retry_count]})
        elif first.due_ms <= now:
            yield pd.DataFrame({"kind": ["resend"], "value": [first.payload], "retry_count": [first.next_count]})
        else:
            self.letter.update((first.payload, int(first.next_count)))
            self.handle.registerTimer(int(first.due_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.letter.exists():
            value, count = self.letter.get()
            self.letter.clear()
            yield pd.DataFrame({"kind": ["resend"], "value": [value], "retry_count": [count]})

    def close(self) -> None:
        pass


def waiting(letters: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """kind (resend, permanent), value and retry_count of a stream of letters (value), each when its wait is over; what is no letter is left out."""
    moved = dead_letters.transition(letters, policy=policy).where("action <> 'skip'")
    # a letter whose time can't be read is due
    due = F.coalesce(F.unix_millis(dead_letters.due_at(F.col("letter.failed_at"))), F.lit(0))
    rows = moved.select(
        F.sha2("value", 256).alias("id"), "value", F.col("action"), F.col("letter.original_payload").alias("payload"), F.col("retry_count"),
        F.coalesce("next_count", F.lit(0)).alias("next_count"), F.coalesce(due, F.lit(0)).alias("due_ms"),
    )
    keep = 1000 * (2 * max(policy.schedule) + 86_400)
    return rows.groupBy("id").transformWithStateInPandas(Waiting(keep), OUT, "Update", "ProcessingTime")


def hand_on(rows: DataFrame, main_path: str, permanent_path: str, batch: str) -> None:
    """Resent payloads to the main topic, spent letters with the time to the permanent log; a repeated batch writes nothing twice."""
    now = F.current_timestamp()
    resent = rows.where("kind = 'resend'").select("value", "retry_count", now.alias("timestamp"))
    spent = rows.where("kind = 'permanent'").withColumn("letter", F.from_json("value", dead_letters.ENVELOPE))
    text = F.to_json(F.struct("letter.original_payload", "letter.error", "letter.bucket", "letter.key", "letter.failed_at", "letter.retry_count", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("permanently_failed_at")))
    for out, path in ((resent, main_path), (spent.select(text.alias("value")), permanent_path)):
        if not out.isEmpty():
            append_json(out, path, batch)


def start_waiting(letters: DataFrame, main_path: str, permanent_path: str, checkpoint: str, policy: RetryPolicy = RetryPolicy(), every: str = "10 seconds") -> StreamingQuery:
    """Runs until stopped: timers need batches, which come every so often without new letters too."""
    spark: SparkSession = letters.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(df: DataFrame, number: int) -> None:
        # timers and state move on by batch, so its rows are taken once
        df.persist()
        try:
            hand_on(df, main_path, permanent_path, "{}-{}".format(*batch_of(df, "waited", number)))
        finally:
            df.unpersist()

    return waiting(letters, policy).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
