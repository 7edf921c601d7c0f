"""Keyed state for streams: a bounded log ring, the throttle in event time, and
the listing of a watched corpus.

The processors run under transformWithState, whose state Spark keeps in RocksDB
under the query's checkpoint, so a restarted query goes on where it stopped.
Times travel as microseconds, ids as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """transformWithState needs this provider; other queries of the session keep theirs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ---------------------------------------------------------------- log ring
RING_ENTRY = "at long, event_id long, level string, message string"
RING_OUT = f"shard int, turn long, {RING_ENTRY}"


class LogRing(StatefulProcessor):
    """The newest `keep` entries of a shard, by (time, event_id); never more are held.

    Each batch with entries of a shard emits the shard's ring with a rising turn."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", RING_ENTRY)
        self.turn = handle.getValueState("turn", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RING_ENTRY.split(", ")]
        held = [tuple(r) for r in self.ring.get()]
        for frame in rows:
            held += list(frame[names].itertuples(index=False, name=None))
            held = sorted(held, key=lambda e: e[:2])[-self.keep:]
        turn = (self.turn.get()[0] if self.turn.exists() else 0) + 1
        self.turn.update((turn,))
        self.ring.put([(int(a), int(e), lv, m) for a, e, lv, m in held])
        out = pd.DataFrame(held, columns=names)
        out.insert(0, "turn", turn)
        out.insert(0, "shard", int(key[0]))
        yield out

    def close(self) -> None:
        pass


def ring_entries(logs: DataFrame, shards: int) -> DataFrame:
    """timestamp, level, message, event_id -> ring entries with their shard.  The newest N of all
    entries are among the newest N of the shards, so no single key sees the whole log."""
    return logs.select(F.pmod(F.xxhash64("event_id", "message"), F.lit(shards)).cast("int").alias("shard"),
                       F.unix_micros("timestamp").alias("at"), "event_id", "level", "message").filter("at is not null and event_id is not null")


# ---------------------------------------------------------------- throttle
ATTEMPT = "ts long, event_id long, ok boolean"
JUDGED = "user_id string, event_id long, ts long, ok boolean, blocked boolean"


class OrderedThrottle(StatefulProcessor):
    """The throttle over attempts that come late and in chunks.

    Attempts wait in state until the watermark has passed them, then are judged
    in the order of (time, event_id, outcome).  A timer stands at the first that
    waits; when none does, one stands where the window of the failures ends, and
    then the user's state goes: only users with recent attempts are held.
    Rows without event_id are clock ticks."""

    def __init__(self, most: int, window_s: int):
        self.most, self.window = most, window_s

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ATTEMPT)
        self.state = handle.getValueState("state", "failures long, start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame["event_id"].notna()]
            if len(frame):
                ok = frame["ok"].fillna(False).astype(bool)
                self.waiting.appendList([(int(t), int(e), bool(o)) for t, e, o in zip(frame["ts_micros"].tolist(), frame["event_id"].tolist(), ok.tolist())])
                low = int(frame["ts_micros"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [a for a in waiting if a[0] <= now]
        rest = waiting[len(due):]
        failures, start = self.state.get() if self.state.exists() else (0, None)
        out = []
        for ts, event, ok in due:
            t = ts // 1_000_000
            if start is None or t - start >= self.window:
                failures, start = 0, t
            blocked = failures >= self.most
            if not blocked:
                failures, start = (0, None) if ok else (failures + 1, start)
            out.append((key[0], event, ts, ok, blocked))
        ends = None if start is None else (start + self.window) * 1000  # in ms; a later attempt opens a new window
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif waiting:
            self.waiting.clear()
        if ends is None or not rest and ends * 1000 <= now:
            self.state.clear()
        else:
            self.state.update((failures, start))
            if not rest:
                self.handle.registerTimer(ends)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in JUDGED.split(", ")]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- listing
CHANGE = "project string, path string, ext string, language string, content string, size long, mtime timestamp, change string"


BUCKETS = 1024  # keys of the listing's state: one call for each in a batch, which holds the bucket's files of the batch
KNOWN = "project string, path string, mtime long, hash long"


class Listing(StatefulProcessor):
    """What is known of the files of a bucket: their times and content hashes.  Emits a file when it
    is added, edited or removed (content null); of several sightings in a batch the last counts."""

    def init(self, handle) -> None:
        self.known = handle.getListState("known", KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames, last = [], {}
        for frame in rows:
            for i, (*file, seen, at, now) in enumerate(zip(*(frame[c].tolist() for c in ("project", "path", "seen", "at", "hash")))):
                had = last.get(file := tuple(file))
                if had is None or seen >= had[0]:
                    last[file] = (seen, len(frames), i, at, now)
            frames.append(frame)
        known = {(r[0], r[1]): (r[2], r[3]) for r in self.known.get()} if last and self.known.exists() else {}
        changes = [([], []) for _ in frames]
        for file, (_, n, i, at, now) in last.items():
            had = known.get(file)
            if not isinstance(now, str):
                change = "removed" if had is not None else None
                known.pop(file, None)
            else:
                is_now = (int(at), int(now))
                change = "added" if had is None else "modified" if had != is_now else None
                known[file] = is_now
            if change:
                changes[n][0].append(i)
                changes[n][1].append(change)
        if not any(some for some, _ in changes):
            yield pd.DataFrame()
            return
        if known:
            self.known.put([(*file, *state) for file, state in known.items()])
        else:
            self.known.clear()
        names = [c.split()[0] for c in CHANGE.split(", ")]
        for frame, (some, change) in zip(frames, changes):
            if some:
                yield frame.iloc[some].assign(change=change)[names]

    def close(self) -> None:
        pass


def sightings(files: DataFrame) -> DataFrame:
    """Rows of files (content null where a file is gone; seen: rising per listing) for Listing."""
    # hash and time as text: pandas would make doubles of nullable longs
    return files.select(F.pmod(F.xxhash64("project", "path"), F.lit(BUCKETS)).cast("int").alias("bucket"), "project", "path", "ext", "language", "content", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "mtime", "seen",
                        F.coalesce(F.unix_micros("mtime"), F.lit(-1)).cast("string").alias("at"), F.when(F.col("content").isNotNull(), F.xxhash64("content")).cast("string").alias("hash"))
