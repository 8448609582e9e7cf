"""Cache keys, replay of a query log under a cache policy, and its statistics."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import CachePolicy

PREFIX = "search:"


def gateway_key(query: Column, limit: Column | None = None) -> Column:
    """SHA-256 of the raw query; with `limit` results of different lengths have different keys."""
    text = query if limit is None else F.concat_ws("|", query, limit.cast("string"))
    return F.concat(F.lit(PREFIX), F.sha2(text, 256))


def canonical(query: Column, extension: Column, bucket: Column, owner: Column, tags: Column, date_from: Column, date_to: Column, size: Column, start: Column) -> Column:
    """The arguments as JSON with sorted keys; ASCII texts agree byte for byte with a JSON encoder that escapes the rest."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.to_json(F.struct(blank(bucket).alias("bucket"), blank(date_from).alias("date_from"), blank(date_to).alias("date_to"), F.lower(blank(extension)).alias("ext"), start.alias("from"), blank(owner).alias("owner"), F.lower(F.trim(query)).alias("q"), size.alias("size"), F.array_sort(F.coalesce(tags, F.array().cast("array<string>"))).alias("tags")))


def library_key(*arguments: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.substring(F.sha2(canonical(*arguments), 256), 1, 32))


def replay(log: DataFrame, policy: CachePolicy = CachePolicy()) -> DataFrame:
    """log (key, ts, event_id, has_filters) with hit and expires_at: a fold over each key's accesses in order.

    A key's accesses meet in one task; a log in which one key is unbounded is replayed period by period.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "event_id"], kind="stable")
        alive, count, counted, hits, ends = None, 0, None, [], []
        for ts, filtered in zip(frame["ts"], frame["has_filters"], strict=True):
            if policy.at_read and counted is not None and ts >= counted:
                count = 0
            hit = alive is not None and ts < alive
            if hit:
                count += 1
                counted = ts + pd.Timedelta(seconds=2 * policy.popular_ttl)
                if policy.at_read and count == policy.popular_at:
                    alive = ts + pd.Timedelta(seconds=policy.popular_ttl)
            else:
                ttl = policy.filtered_ttl if policy.at_read and filtered else policy.popular_ttl if not policy.at_read and count >= policy.popular_at else policy.default_ttl
                alive = ts + pd.Timedelta(seconds=ttl)
            hits.append(hit)
            ends.append(alive)
        return frame.assign(hit=hits, expires_at=ends)

    return log.select("key", "ts", "event_id", "has_filters").groupBy("key").applyInPandas(fold, "key string, ts timestamp, event_id long, has_filters boolean, hit boolean, expires_at timestamp")


def statistics(replayed: DataFrame) -> DataFrame:
    hits, total = F.count_if("hit"), F.count("*")
    return replayed.agg(hits.alias("hits"), (total - hits).alias("misses"), F.coalesce(F.round(100 * F.try_divide(hits, total), 2), F.lit(0.0)).alias("hit_rate_pct"), F.countDistinct("key").alias("cached_keys"))


def popular(log: DataFrame, n: int = 10) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def recent(log: DataFrame, n: int = 10, contains: str = "") -> DataFrame:
    rows = log.where(F.lower("query").contains(contains.lower())) if contains else log
    return rows.groupBy("query").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "query").limit(n)


class ResultCache:
    """A driver-side store of small result lists with expiry and hit counts; failures never fail a query.

    It holds `most` entries; the least recently used goes first. A hit count ends twice the popular time after its last hit.
    """

    def __init__(self, policy: CachePolicy = CachePolicy(), clock: Callable[[], float] | None = None, most: int = 10_000):
        import time

        self.policy, self.clock, self.most = policy, clock or time.time, most
        self.entries: OrderedDict[str, tuple[float, str]] = OrderedDict()
        self.hits: OrderedDict[str, tuple[float, int]] = OrderedDict()
        self.stats = {"hits": 0, "misses": 0, "stores": 0, "errors": 0}

    def get(self, key: str) -> dict | None:
        found = self.entries.get(key)
        if not found or found[0] <= self.clock():
            self.entries.pop(key, None)
            self.stats["misses"] += 1
            return None
        self.entries.move_to_end(key)
        n = self.count(key) + 1
        self.hits[key] = (self.clock() + 2 * self.policy.popular_ttl, n)
        self._cut(self.hits)
        self.stats["hits"] += 1
        if self.policy.at_read and n == self.policy.popular_at:
            self.entries[key] = (self.clock() + self.policy.popular_ttl, found[1])
        return json.loads(found[1]) | {"_cache": {"hit": True, "hit_count": n, "key": key}}

    def count(self, key: str) -> int:
        ends, n = self.hits.get(key, (0.0, 0))
        return n if ends > self.clock() else 0

    def _cut(self, kept: OrderedDict) -> None:
        while len(kept) > self.most:
            kept.popitem(last=False)

    def set(self, key: str, payload: dict, ttl: int | None = None, has_filters: bool = False) -> None:
        popular_ = not self.policy.at_read and self.count(key) >= self.policy.popular_at
        ttl = ttl or (self.policy.popular_ttl if popular_ else self.policy.filtered_ttl if has_filters else self.policy.default_ttl)
        kept = {k: v for k, v in payload.items() if not k.startswith("_cache")} | {"_stored_at": self.clock()}
        self.entries[key] = (self.clock() + ttl, json.dumps(kept, default=str))
        self.entries.move_to_end(key)
        self._cut(self.entries)
        self.stats["stores"] += 1

    def invalidate(self, key: str) -> int:
        return int(self.entries.pop(key, None) is not None)

    def invalidate_all(self, prefix: str = PREFIX) -> int:
        gone = [k for k in self.entries if k.startswith(prefix)]
        for k in gone:
            del self.entries[k]
        return len(gone)

    def get_stats(self) -> dict:
        asked = self.stats["hits"] + self.stats["misses"]
        return self.stats | {"hit_rate_pct": round(100 * self.stats["hits"] / asked, 2) if asked else 0.0, "cached_keys": len(self.entries)}


def cached_search(cache: ResultCache, key: str, search: Callable[[], dict], has_filters: bool = False) -> dict:
    """A stored result, or a fresh one that is stored unless it failed."""
    began = cache.clock()
    try:
        found = cache.get(key)
    except Exception:
        cache.stats["errors"] += 1
        found = None
    if found is None:
        found = search()
        try:
            cache.set(key, found, has_filters=has_filters)
        except Exception:
            cache.stats["errors"] += 1
        found = found | {"_cache": {"hit": False, "key": key}}
    return found | {"_latency_ms": round(1000 * (cache.clock() - began), 3)}
