"""Periodic runs of words: stretches that repeat with a period, and texts with the repeats taken out.

A run is a maximal stretch of words whose smallest period is q, of at least max(6, 4 q) words. At lag q such a
stretch is an island of at least max(6 - q, 3 q) neighbouring matches (word i equals word i + q), so a lag with
fewer matches in the whole text holds none. Matches of all lags are counted at once: a frequent word by the
autocorrelation of its places (FFT, rounded: counts below 2^40 come out exact), a rare one by the differences of
its places. A lag with enough matches is probed at every need-th place, which each island covers, and only texts
with a probe inside a row of three matches are scanned. A found run explains the matches of the multiples of its
period, which are taken off before those lags are looked at: islands inside it are the run itself.

Work is done slice by slice over all texts of a slice together; nothing is shuffled.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text; very long texts are slices of
their own; a null doc_id is kept, and its text is never folded; repeated rows give repeated results; other columns
are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, bound_batches, slices, text_array, trimmed, words_of

#: Runs have at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: Pairs of places whose differences are counted at once.
PAIRS = 2_000_000


def needed(lag: np.ndarray | int) -> np.ndarray:
    """Neighbouring matches of the shortest run of a period."""
    return np.maximum(LEAST - lag, (POWER - 1) * lag)


def fold_tails(codes: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The words of each chosen text from place a = g % n on repeat those at a, a + 1, ... with period 1 + (n - a) // (3 + g % 8)."""
    n = np.diff(offsets)
    chosen = chosen & (n > 0)
    a = np.where(chosen, g % np.maximum(n, 1), 0)
    p = 1 + (n - a) // (3 + g % 8)
    text = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(codes)) - offsets[text]
    source = np.where(chosen[text] & (i >= a[text]), a[text] + (i - a[text]) % p[text], i)
    return codes[offsets[text] + source]


def count_matches(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of every lag up to n // POWER of each text as (counts, bases, longest lags): lag q of text i is counts[bases[i] + q - 1]."""
    n = np.diff(offsets)
    most = np.where(n >= LEAST, n // POWER, 0)
    base = np.concatenate([[0], np.cumsum(most)])
    counts = np.zeros(base[-1], np.int64)
    if not len(counts):
        return counts, base, most
    text = np.repeat(np.arange(len(n)), n)
    inside = most[text] > 0
    at, text = np.flatnonzero(inside), text[inside]
    key = text * (int(codes.max()) + 1) + codes[at]
    order = np.argsort(key, kind="stable")
    key, place, text = key[order], at[order], text[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(np.append(begin, len(key)))
    heavy = size > np.maximum(16, np.sqrt(n * np.log2(n + 2)))[text[begin]]
    for doc in np.unique(text[begin[heavy]]):
        of = np.flatnonzero(heavy & (text[begin] == doc))
        length = 1 << int(n[doc] + most[doc]).bit_length()
        power = np.zeros(length // 2 + 1)
        for w in of:
            here = np.zeros(length)
            here[place[begin[w] : begin[w] + size[w]] - offsets[doc]] = 1
            f = np.fft.rfft(here)
            power += f.real**2 + f.imag**2
        counts[base[doc] : base[doc + 1]] += np.rint(np.fft.irfft(power, length)[1 : most[doc] + 1]).astype(np.int64)
    light = np.repeat(~heavy, size)
    key, place, text = key[light], place[light], text[light]
    here, waiting, held = np.arange(len(key)), [], 0
    step = 0
    while len(here):  # the differences grow with the step, so a place that left stays out
        step += 1
        here = here[here + step < len(key)]
        there = here + step
        lag = place[there] - place[here]
        near = (key[there] == key[here]) & (lag <= most[text[here]])
        here, lag = here[near], lag[near]
        waiting.append(base[text[here]] + lag - 1)
        held += len(here)
        if held > PAIRS or not len(here):
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
            waiting, held = [], 0
    return counts, base, most


def islands(match: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal rows of at least `least` true values."""
    edge = np.diff(np.concatenate([[0], match.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], (end - start)[long]


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The runs of all texts as rows (text, start, length, period), in this order; equal codes of a text are equal words."""
    counts, base, most = count_matches(codes, offsets)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], most) + 1
    enough = np.flatnonzero(counts >= needed(lag))
    owner = np.repeat(np.arange(len(most)), most)[enough]
    order = np.argsort(lag[enough], kind="stable")
    lags, owner = lag[enough][order], owner[order]
    starts = np.flatnonzero(np.diff(lags, prepend=0))
    found: list[tuple[int, int, int, int]] = []
    known: dict[int, set[tuple[int, int]]] = {}
    for a, b in zip(starts, [*starts[1:], len(lags)], strict=True):
        q = int(lags[a])
        least = int(needed(q))
        docs = owner[a:b]
        docs = docs[counts[base[docs] + q - 1] >= least]
        if not len(docs):
            continue
        low, high = offsets[docs], offsets[docs + 1] - q
        n_probes = (high - low - 1) // least + 1
        which = np.repeat(np.arange(len(docs)), n_probes)
        probe = low[which] + least * (np.arange(len(which)) - np.repeat(np.cumsum(n_probes) - n_probes, n_probes))
        hit = codes[probe] == codes[probe + q]
        which, probe = which[hit], probe[hit]
        # of an island of five and more one side of any place has two more matches
        sides = []
        for sign in (1, -1):
            side = np.ones(len(probe), bool)
            for far in (1, 2):
                there = probe + sign * far
                fits = (there >= low[which]) & (there < high[which])
                there = np.where(fits, there, probe)
                side &= fits & (codes[there] == codes[there + q])
            sides.append(side)
        for i in np.unique(which[sides[0] | sides[1]]):
            doc = int(docs[i])
            words = codes[offsets[doc] : offsets[doc + 1]]
            for start, matches in zip(*islands(words[:-q] == words[q:], least), strict=True):
                start, length = int(start), int(matches) + q
                if (start, length) in known.setdefault(doc, set()):
                    continue  # the same stretch has a smaller period, which divides q
                known[doc].add((start, length))
                found.append((doc, start, length, q))
                multiples = np.arange(q, min(length - 1, int(most[doc])) + 1, q)
                counts[base[doc] + multiples - 1] -= length - multiples
    return np.array(sorted((d, s, p, length) for d, s, length, p in found), np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def repeats(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run behind its first period."""
    change = np.zeros(offsets[-1] + 1, np.int64)
    first = offsets[runs[:, 0]] + runs[:, 1]
    np.add.at(change, first + runs[:, 3], 1)
    np.add.at(change, first + runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, folded: Column | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, runs (by start, then period) and collapsed: the words without repeats, joined by one space.

    folded: a whole number h for each row (null: none); where h % 10 is 0, the tail of the text is made periodic by fold_tails with
    h // 10 before runs are looked for.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"), (F.lit(None) if folded is None else folded).cast("long").alias("folded"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SMALL_SLICE):
            codes, offsets, distinct = words_of(text_array(batch.column(1)))
            h = pc.fill_null(batch.column(2), 1).to_numpy(zero_copy_only=False)
            if len(codes):
                codes = fold_tails(codes, offsets, h % 10 == 0, h // 10)
            runs = find_runs(codes, offsets)
            kept = ~repeats(runs, offsets)
            before = np.concatenate([[0], np.cumsum(kept)])[offsets]
            words = pa.LargeListArray.from_arrays(pa.array(before, pa.int64()), distinct.take(pa.array(codes[kept])))
            ends = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=batch.num_rows))])
            fields = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields), pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                names=[key, "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(trimmed(run), f"`{key}` {kind}, n_words bigint, runs {RUNS}, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
