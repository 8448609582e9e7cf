"""Calls of outside services from tasks: a bounded number at once, errors by class, doubling waits."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftline.config import IngestConfig
from siftline.operators.ingest import backoff_seconds

#: Calls of one task at a time; an executor makes as many times its tasks.
AT_ONCE = 4


class Refused(Exception):
    """An answer that another attempt would not change."""


class Unavailable(Exception):
    """No answer, or one that another attempt may change."""


def http_put(url: str, timeout: float = 60.0, headers: dict[str, str] | None = None) -> Callable[[bytes], str]:
    """A call that sends bytes and returns the answer's text: 4xx is refused; 5xx, time-outs and broken connections are unavailable."""

    def call(body: bytes) -> str:
        request = urllib.request.Request(url, data=body, headers=headers or {}, method="PUT")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise (Refused if e.code < 500 else Unavailable)(f"HTTP {e.code}") from e
        except OSError as e:  # time-outs and connection errors
            raise Unavailable(type(e).__name__) from e

    return call


def attempted(call: Callable[[bytes], str], body: bytes, waits: list[float], pause: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """Answer, error and number of attempts; waits lie between attempts."""
    for n in range(len(waits) + 1):
        try:
            return call(body), None, n + 1
        except Refused as e:
            return None, str(e), n + 1
        except Unavailable as e:
            error = str(e)
        if n < len(waits):
            pause(waits[n])
    return None, error, len(waits) + 1


def call_out(rows: DataFrame, column: str, call: Callable[[bytes], str], at_once: int = AT_ONCE, config: IngestConfig = IngestConfig()) -> DataFrame:
    """rows with answer, call_error and attempts of a call with each row's bytes (null: no call). Rows keep their order; a batch waits for its slowest call."""
    names, waits = rows.columns, backoff_seconds(config)
    schema = T.StructType([*rows.schema, T.StructField("answer", T.StringType()), T.StructField("call_error", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                bodies = batch.column(names.index(column)).to_pylist()
                found = list(pool.map(lambda b: (None, None, 0) if b is None else attempted(call, bytes(b) if not isinstance(b, str) else b.encode(), waits), bodies))
                parts = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*names, "answer", "call_error", "attempts"])

    return rows.mapInArrow(run, schema)
