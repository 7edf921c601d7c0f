"""Logs, sessions and the failed-attempt throttle."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.config import UiConfig
from linewise.functions.text import log_level_from, log_level_rank
from linewise.operators.numbering import numbered
from linewise.session import shared_path


def log_recent(logs: DataFrame, min_level: str = "info", limit: int = UiConfig.log_default_limit) -> DataFrame:
    """Entries at or above min_level, the newest `limit` (0 = all), returned
    oldest first.  The limit is a global top-k (TakeOrderedAndProject: each
    task keeps `limit` rows, the final merge sees tasks x limit rows)."""
    lv = log_level_rank(log_level_from(F.col("level")))
    df = logs.filter(lv >= log_level_rank(F.lit(min_level)))
    if limit:
        df = df.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)
    return df.orderBy("timestamp", "event_id")


def sessionize(events: DataFrame, gap: str = "60 minutes", key: str = "user_id", ts: str = "ts",
               gap_s: int = 3600, bucket_s: int = 86400) -> DataFrame:
    """Sessions that expire `gap` after the last use (session_window
    semantics: a new session starts when the gap to the previous event is
    >= gap; the end is the last event + gap).

    Batch form: events are cut into runs by a bucketed gap segmentation, so a
    key holding a large share of the events is spread over (key, day)
    partitions; then one aggregate per run.  A null key is a key; events
    without a time belong to no session (as with session_window).
    The streaming job uses session_window with a watermark."""
    del gap  # gap_s carries the same value in seconds
    # Segment starts never share a timestamp (a start needs a gap >= gap_s
    # from the previous event), so the start time alone labels a session and
    # a constant tie-breaker keeps the labels deterministic.
    ev = events.select(F.col(key).alias("user_id"), F.col(ts).alias("ts"),
                       F.lit(0).cast("long").alias("event_id")).filter("ts is not null")
    seg = gap_segments(ev, gap_s, bucket_s)
    out = (seg.groupBy("user_id", "seg").agg(F.min("ts").alias("session_start"), F.max("ts").alias("_last"),
                                            F.count("*").alias("events"))
              .select(F.col("user_id").alias(key), "session_start",
                      F.timestamp_add("SECOND", F.lit(gap_s), F.col("_last")).alias("session_end"), "events"))
    return out


def sessionize_window(events: DataFrame, gap: str = "60 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same sessions through Spark's session_window aggregate."""
    return (events.groupBy(key, F.session_window(ts, gap).alias("s"))
                  .agg(F.count("*").alias("events"))
                  .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null; the right side's keys go."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def gap_segments(events: DataFrame, gap_s: int, bucket_s: int) -> DataFrame:
    """events (user_id, ts, event_id) + seg, the segment's first (ts, event_id).

    A new segment starts at a user's first event or after a gap >= gap_s, taken
    in microseconds.  The ordered work is partitioned by (user, time bucket);
    only one row per (user, bucket) is ordered per user to stitch bucket
    boundaries (previous bucket's last event, last segment start carried
    forward)."""
    keys = ["user_id", "bucket"]
    a = events.withColumn("bucket", F.floor(F.unix_timestamp("ts") / bucket_s))
    wb = Window.partitionBy(*keys).orderBy("ts", "event_id")
    wu = Window.partitionBy("user_id").orderBy("bucket")
    a = a.withColumn("_prev", F.lag("ts").over(wb))
    ends = a.groupBy(*keys).agg(F.max("ts").alias("_last"))
    ends = ends.withColumn("_prev_last", F.lag("_last").over(wu)).drop("_last")
    a = _null_safe(a, ends, keys)
    prev = F.coalesce(F.col("_prev"), F.col("_prev_last"))
    new = prev.isNull() | (F.unix_micros("ts") - F.unix_micros(prev) >= gap_s * 1_000_000)
    a = a.withColumn("_start", F.when(new, F.struct("ts", "event_id")))
    a = a.withColumn("_in", F.last("_start", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    starts = a.groupBy(*keys).agg(F.max("_start").alias("_bucket_start"))
    starts = starts.withColumn("_carry", F.last("_bucket_start", ignorenulls=True)
                               .over(wu.rowsBetween(Window.unboundedPreceding, -1))).drop("_bucket_start")
    a = _null_safe(a, starts, keys)
    return a.select("user_id", "event_id", "ts", F.coalesce("_in", "_carry").alias("seg"))


# ---------------------------------------------------------------- throttle
#
# A user's throttle is an automaton.  Its state is "clear", or a number of
# failures (1 .. max_attempts) with the second in which their window opened.
# Seen from the time of an attempt only the age of the window matters, so there
# are 1 + max_attempts * window_s states, and what a chunk of attempts does to
# them is an array: entry state -> exit state.  Arrays of neighbouring chunks
# compose, so an endless burst of one user is cut into chunks of bounded size,
# summarised chunk by chunk, composed in groups of bounded size, and the state
# that enters each chunk is handed back down before the chunk's own attempts
# are judged.

# ids travel through pandas as text: a nullable long would pass through a double
JUDGED_SCHEMA = "user_id string, event_id string, ts timestamp, ok boolean, blocked boolean"
CHUNK = 4096  # attempts of one user that a task folds at a time
FAN = 256     # neighbouring transition arrays that are composed at a time


class Throttle:
    """States: 0 is clear; 1 + (failures - 1) * window + age otherwise."""

    def __init__(self, max_attempts: int, window_s: int):
        self.most, self.window = max_attempts, window_s
        self.size = 1 + max_attempts * window_s

    def aged(self, states: np.ndarray, seconds: int) -> np.ndarray:
        """The states, seen `seconds` later: windows grow older and end."""
        age = (states - 1) % self.window + seconds
        return np.where((states == 0) | (age >= self.window), 0, states + seconds)

    def transition(self, now: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Exit states (seen at the last attempt) for all entry states (seen at the first), of
        attempts in order.  `now`: whole seconds, rising."""
        n, w, most = len(now), self.window, self.most
        at = np.arange(n)
        ends = np.searchsorted(now, now + w, "left")                   # first attempt after the window opened at i
        hits = np.flatnonzero(ok)
        next_ok = np.append(hits, n)[np.searchsorted(hits, at, "left")]
        # clear before attempt i: an accepted success among the first `most` failures clears the state
        # again, or the window ends before a later attempt, or it is open after the last one
        clears = ((next_ok < ends) & (next_ok - at < most)).tolist()
        goes = np.where(clears, next_ok + 1, ends).tolist()
        held = (1 + (np.minimum(most, n - at) - 1) * w + now[-1] - now).tolist()
        final = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            final[i] = final[goes[i]] if clears[i] or goes[i] < n else held[i]
        final = np.array(final, np.int64)
        state = np.arange(1, self.size)
        failures, age = (state - 1) // w + 1, (state - 1) % w
        expiry = np.searchsorted(now, now[0] - age + w, "left")
        first_ok = int(next_ok[0])
        cleared = (first_ok < expiry) & (first_ok + failures < most)
        j = np.where(cleared, first_ok + 1, expiry)
        held = 1 + (np.minimum(most, failures + n) - 1) * w + age + (now[-1] - now[0])
        out = np.where(cleared | (expiry < n), final[j], held)
        return np.append(final[0], out)

    def judge(self, now: np.ndarray, ok: np.ndarray, entry: int) -> np.ndarray:
        """blocked, for attempts in order that meet the state `entry` (seen at the first)."""
        count, start, blocked = 0, None, np.zeros(len(now), bool)
        if entry:
            count, start = (entry - 1) // self.window + 1, now[0] - (entry - 1) % self.window
        for i, (t, good) in enumerate(zip(now.tolist(), ok.tolist())):
            if start is None or t - start >= self.window:
                count, start = 0, t
            if count >= self.most:
                blocked[i] = True
            elif good:
                count, start = 0, None
            else:
                count += 1
        return blocked


def _runs(frames, keys: list[str]):
    """Frames of sorted rows -> one frame per run of equal keys, however the rows were batched."""
    held = []
    for f in frames:
        if not len(f):
            continue
        new = np.zeros(len(f), bool)
        for k in keys:
            c = f[k]
            new[1:] |= ((c != c.shift()) & ~(c.isna() & c.shift().isna())).to_numpy(bool, na_value=True)[1:]
        cuts = [0, *np.flatnonzero(new).tolist(), len(f)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = f.iloc[lo:hi]
            if lo == 0 and held and not _same(held[-1], part, keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            if hi < len(f):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _same(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    pairs = [(a[k].iloc[-1], b[k].iloc[0]) for k in keys]
    return all((pd.isna(x) and pd.isna(y)) or x == y for x, y in pairs)


MAP_SCHEMA = "user_id string, idx long, first long, last long, states array<int>"
ENTRY_SCHEMA = "user_id string, idx long, entry int"


def _summaries(machine: Throttle):
    """Attempts of chunks -> a transition array per chunk."""
    def run(frames):
        for f in _runs(frames, ["user_id", "idx"]):
            now = f["now"].to_numpy(np.int64)
            out = machine.transition(now, f["ok"].fillna(False).to_numpy(bool))
            yield pd.DataFrame({"user_id": f["user_id"].iloc[:1].to_numpy(), "idx": f["idx"].iloc[:1].to_numpy(), "first": now[:1], "last": now[-1:],
                                "states": [out.astype(np.int32)]})
    return run


def _composed(machine: Throttle):
    """Neighbouring transition arrays -> one array of them all."""
    def run(frames):
        for f in _runs(frames, ["user_id", "up"]):
            state, last = None, None
            for first, end, states in zip(f["first"].tolist(), f["last"].tolist(), f["states"].tolist()):
                states = np.asarray(states)
                state = states if state is None else states[machine.aged(state, first - last)]
                last = end
            yield pd.DataFrame({"user_id": f["user_id"].iloc[:1].to_numpy(), "idx": f["up"].iloc[:1].to_numpy(), "first": f["first"].iloc[:1].to_numpy(),
                                "last": f["last"].iloc[-1:].to_numpy(), "states": [state.astype(np.int32)]})
    return run


def _handed_down(machine: Throttle):
    """Arrays of a group and the state that enters the group -> the state that enters each member."""
    def run(frames):
        for f in _runs(frames, ["user_id", "up"]):
            state, last, out = int(f["entry"].iloc[0]), None, []
            for first, end, states in zip(f["first"].tolist(), f["last"].tolist(), f["states"].tolist()):
                if last is not None:
                    state = int(machine.aged(np.array([state]), first - last)[0])
                out.append(state)
                state, last = int(states[state]), end
            yield pd.DataFrame({"user_id": f["user_id"].to_numpy(), "idx": f["idx"].to_numpy(), "entry": np.array(out, np.int32)})
    return run


def _judged(machine: Throttle):
    def run(frames):
        for f in _runs(frames, ["user_id", "idx"]):
            blocked = machine.judge(f["now"].to_numpy(np.int64), f["ok"].fillna(False).to_numpy(bool), int(f["entry"].iloc[0]))
            out = f[["user_id", "event_id", "ts", "ok"]].copy()
            out["blocked"] = blocked
            yield out
    return run


def _entries(maps: DataFrame, levels: int, machine: Throttle) -> DataFrame:
    """The state that enters each (user, idx), by composing groups of FAN and handing states down."""
    grouped = maps.withColumn("up", F.floor(F.col("idx") / FAN))
    together = grouped.repartition("user_id", "up").sortWithinPartitions("user_id", "up", "idx")
    if levels <= 1:
        top = together.withColumn("entry", F.lit(0))
        return top.mapInPandas(_handed_down(machine), ENTRY_SCHEMA)
    above = materialized(together.mapInPandas(_composed(machine), MAP_SCHEMA), "throttle-maps")
    # entry states of the groups are seen at the group's first attempt, like the members' own
    entry = _entries(above, levels - 1, machine).withColumnRenamed("idx", "up")
    met = _null_safe(grouped, entry, ["user_id", "up"])
    return met.repartition("user_id", "up").sortWithinPartitions("user_id", "up", "idx").mapInPandas(_handed_down(machine), ENTRY_SCHEMA)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Written once under the shared folder and read back: later passes and lost executors reread it."""
    path = shared_path(df.sparkSession, f"linewise/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def burst_throttle(attempts: DataFrame, max_attempts: int = 5, window_s: int = 60) -> DataFrame:
    """Per attempt (user_id, event_id, ts, ok): blocked or not.

    Per user the state is (failures, window start); a window opens at the
    first attempt after the previous one expired, an accepted success clears
    the state and a blocked attempt changes nothing.  Time counts in whole
    seconds, attempts follow (ts, event_id, ok).  A null user is a user; an
    attempt without a time is not blocked and changes nothing.

    No user meets in one task: attempts are numbered over all tasks and cut
    into chunks of CHUNK, and the state enters a chunk through the composed
    transition arrays of those before it."""
    cols = ["user_id", "event_id", "ts", "ok"]
    if max_attempts <= 0:
        return attempts.select(*cols, F.lit(False).alias("blocked"))
    machine, kinds = Throttle(max_attempts, window_s), dict(attempts.dtypes)
    timed = attempts.filter("ts is not null").select(*cols)
    laid = numbered(timed, [F.col("ts").asc(), F.col("event_id").asc(), F.col("ok").asc()], "n", ["user_id"])
    laid = (laid.withColumn("idx", F.floor((F.col("n") - 1) / CHUNK)).withColumn("now", F.unix_timestamp("ts"))
                .withColumns({k: F.col(k).cast("string") for k in ("user_id", "event_id")}))
    chunks = F.floor((F.max("n") - 1) / CHUNK)
    # one number per user; the largest says how many levels of groups there are
    most = laid.agg(chunks.alias("m")).first()["m"] or 0
    levels, width = 0, most
    while width > 0:
        levels, width = levels + 1, width // FAN
    if levels:
        many = laid.groupBy("user_id").agg(chunks.alias("m")).filter("m > 0")
        longer = _null_safe(laid, many, ["user_id"])
        parts = longer.repartition("user_id", "idx").sortWithinPartitions("user_id", "idx", "n")
        maps = materialized(parts.mapInPandas(_summaries(machine), MAP_SCHEMA), "throttle-maps")
        entry = materialized(_entries(maps, levels, machine), "throttle-entries")
        named = entry.select(F.col("user_id").alias("_u"), F.col("idx").alias("_i"), "entry")
        laid = laid.join(named, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("idx") == F.col("_i")), "left").drop("_u", "_i")
        laid = laid.withColumn("entry", F.coalesce("entry", F.lit(0)))
    else:
        laid = laid.withColumn("entry", F.lit(0))
    judged = (laid.repartition("user_id", "idx").sortWithinPartitions("user_id", "idx", "n")
                  .mapInPandas(_judged(machine), JUDGED_SCHEMA))
    judged = judged.select(*[F.col(c).cast(kinds[c]).alias(c) for c in cols], "blocked")
    return judged.unionByName(attempts.filter("ts is null").select(*cols, F.lit(False).alias("blocked")))
