"""Dead letters: envelopes, retry schedule and the next state of each envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import RetryPolicy
from siftline.schema import ENVELOPE


def envelope(payload: Column, error: Column, bucket: Column, key: Column, failed_at: Column, retry_count: Column | None = None) -> Column:
    """A letter as JSON; retry_count says how often its payload was tried again before this failure."""
    count = F.lit(0) if retry_count is None else F.coalesce(retry_count, F.lit(0))
    return F.to_json(F.struct(payload.alias("original_payload"), error.alias("error"), bucket.alias("bucket"), key.alias("key"), failed_at.alias("failed_at"), count.alias("retry_count")))


def backoff(count: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """Seconds before the attempt after `count` earlier ones; the last wait repeats."""
    waits = F.array(*map(F.lit, policy.schedule))
    return F.element_at(waits, F.least(F.greatest(count, F.lit(0)) + 1, F.lit(len(policy.schedule))).cast("int"))


def transition(letters: DataFrame, value: str = "value", policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """letters with retry_count, action (skip, permanent, retry), next_count and wait_seconds."""
    text = F.col(value).cast("string")
    out = letters.withColumn("_ok", F.try_parse_json(text).isNotNull()).withColumn("letter", F.from_json(text, ENVELOPE))
    count = F.coalesce("letter.retry_count", F.lit(0))
    action = F.when(~F.coalesce("_ok", F.lit(False)), "skip").when(count >= policy.max_attempts, "permanent").when(F.coalesce("letter.original_payload", F.lit("")) == "", "permanent").otherwise("retry")
    out = out.withColumn("retry_count", count).withColumn("action", action)
    retry = F.col("action") == "retry"
    return out.withColumn("next_count", F.when(retry, F.col("retry_count") + 1)).withColumn("wait_seconds", F.when(retry, backoff(F.col("retry_count"), policy))).drop("_ok")


def due_at(failed_at: Column) -> Column:
    """When a letter's wait is over; null if its time can't be read."""
    return failed_at.try_cast("timestamp") + F.make_interval(secs=F.col("wait_seconds"))


def due(letters: DataFrame, now: Column, failed_at: str = "failed_at") -> DataFrame:
    """Letters whose wait is over, with due_at."""
    return letters.withColumn("due_at", due_at(F.col(failed_at))).where((F.col("action") == "retry") & (F.col("due_at") <= now))
