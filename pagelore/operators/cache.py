"""Which requests a cache with a fixed time to live would have answered.

A request is a hit when the last *set* of its key is at most ``ttl`` ago; a miss sets the key again.  The chain of
sets is sequential in time, so a key is cut into time segments.  A segment's instants give a jump table: for every way of
entering it, the set it ends with.  Tables are short, since chains that set at the same instant are one from there on.  Walking the
tables of a key in order gives each segment the last set before it, and the segments are then judged side by side, so
a key with any share of the rows is split over tasks.  All steps stream over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv

NEVER = -(2 ** 62)


def _next_set(ts: np.ndarray, ttl: int) -> np.ndarray:
    """Index of the first request after each request's own life time."""
    return np.searchsorted(ts, ts + ttl, side="right")


def segment_exits(ts: np.ndarray, ttl: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, exit): entering with a first set at or before ``entry`` (and after the one
    before it) leaves the segment with ``exit`` as its last set."""
    nxt, n = _next_set(ts, ttl), len(ts)
    jump, last = np.append(nxt, n), np.append(ts, 0)
    while (jump[:n] < n).any():  # pointer doubling: each round doubles the sets that a jump passes over
        ahead = jump[:n] < n
        last[:n] = np.where(ahead, last[jump[:n]], last[:n])
        jump[:n] = np.where(ahead, jump[jump[:n]], jump[:n])
    reach = min(int(np.searchsorted(ts, start + ttl, side="right")) + 1, n)
    exits = last[:reach]
    ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return ts[:reach][ends], exits[ends]


def judge(ts: np.ndarray, ttl: int, last_set: int) -> tuple[np.ndarray, int]:
    """(hit flags, last set) of requests in time order, given the last set before them."""
    hits = np.ones(len(ts), dtype=bool)
    i = int(np.searchsorted(ts, last_set + ttl, side="right")) if last_set != NEVER else 0
    while i < len(ts):
        hits[i], last_set = False, int(ts[i])
        i = int(np.searchsorted(ts, last_set + ttl, side="right"))
    return hits, last_set


def _runs(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[object, int, dict[str, np.ndarray]]]:
    """(key, segment, columns) of each run of sorted rows, across Arrow batches."""
    name: tuple | None = None
    held: list[tuple[np.ndarray, ...]] = []

    def whole() -> tuple[object, int, dict[str, np.ndarray]]:
        return name[0], int(name[1]), {c: np.concatenate([h[i] for h in held]) for i, c in enumerate(columns)}

    for g in frames:
        if not len(g):
            continue
        keys, segments, values = g["cache_key"].to_numpy(), g["segment"].to_numpy(), [g[c].to_numpy() for c in columns]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(g))):
            if name != (keys[lo], segments[lo]):
                if held:
                    yield whole()
                name, held = (keys[lo], segments[lo]), []
            held.append(tuple(v[lo:hi] for v in values))
    if held:
        yield whole()


def judge_requests(requests: DataFrame, ttl_seconds: int = fv.CACHE_TTL_SECONDS, segment_ttls: int = 24) -> DataFrame:
    """requests: event_id, cache_key, at (microseconds) and, optionally, before (last set of the key ahead of all its rows, or null); adds is_hit.

    Requests at one instant go by event_id.
    """
    ttl = ttl_seconds * 1_000_000
    length = ttl * segment_ttls
    before = F.coalesce("before", F.lit(NEVER)) if "before" in requests.columns else F.lit(NEVER)
    rows = requests.select("event_id", "cache_key", "at", F.floor(F.col("at") / length).alias("segment"), before.alias("before"))

    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list = []
        parts: list[tuple[np.ndarray, ...]] = []

        def table() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pd.DataFrame(dict(zip(["segment", "entry", "leave", "before"], columns))).assign(cache_key=keys)[["cache_key", "segment", "entry", "leave", "before"]]

        for key, segment, got in _runs(frames, ["at", "before"]):
            entry, leave = segment_exits(got["at"], ttl, segment * length) if len(got["at"]) > 1 else (got["at"], got["at"])
            parts.append((np.full(len(entry), segment), entry, leave, np.full(len(entry), got["before"][0])))
            keys += [key] * len(entry)
            if len(keys) >= 10_000:
                yield table()
                keys, parts = [], []
        if keys:
            yield table()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, open_key, last = [], None, NEVER
        for key, segment, got in _runs(frames, ["entry", "leave", "before"]):
            if key != open_key:
                open_key, last = key, int(got["before"][0])
            out.append((key, segment, last))
            i = int(np.searchsorted(got["entry"], last + ttl, side="right")) if last != NEVER else 0
            if i < len(got["entry"]):
                last = int(got["leave"][i])
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["cache_key", "segment", "last_set"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["cache_key", "segment", "last_set"])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_run, last = None, NEVER
        for g in batches:
            if len(g) == 0:
                continue
            keys, segments = g["cache_key"].to_numpy(), g["segment"].to_numpy()
            ts, entered = g["at"].to_numpy(), g["last_set"].to_numpy()
            changes = np.flatnonzero((keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])) + 1
            flags = np.empty(len(g), dtype=bool)
            for lo, hi in zip(np.append(0, changes), np.append(changes, len(g))):
                if (keys[lo], segments[lo]) != open_run:
                    open_run, last = (keys[lo], segments[lo]), int(entered[lo])
                flags[lo:hi], last = judge(ts[lo:hi], ttl, last)
            yield pd.DataFrame({"event_id": g["event_id"], "cache_key": keys, "at": ts, "is_hit": flags})

    instants = rows.groupBy("cache_key", "segment", "at").agg(F.max("before").alias("before"))
    tables = instants.repartition("cache_key", "segment").sortWithinPartitions("cache_key", "segment", "at").mapInPandas(
        exits, "cache_key string, segment long, entry long, leave long, before long")
    entered = tables.repartition("cache_key").sortWithinPartitions("cache_key", "segment", "entry").mapInPandas(
        fold, "cache_key string, segment long, last_set long")
    entered = entered.withColumnsRenamed({"cache_key": "_key", "segment": "_segment"})
    here = F.col("cache_key").eqNullSafe(F.col("_key")) & (F.col("segment") == F.col("_segment"))
    return rows.join(entered, here).repartition("cache_key", "segment").sortWithinPartitions(
        "cache_key", "segment", "at", "event_id").select("event_id", "cache_key", "segment", "at", "last_set").mapInPandas(
        mark, "event_id long, cache_key string, at long, is_hit boolean")


def cache_hits_ttl(requests: DataFrame, ttl_seconds: int = fv.CACHE_TTL_SECONDS, segment_ttls: int = 24) -> DataFrame:
    """requests: event_id, cache_key, ts; adds is_hit."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return judge_requests(requests.select("event_id", "cache_key", at.alias("at")), ttl_seconds, segment_ttls).drop("at")
