"""Sessions and the throttle: transition arrays, one endless user, nulls."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewise.operators import logs as L

T0 = datetime(2024, 1, 1)


def loop(attempts, most, window):
    """Plain automaton over (user, event_id, second, ok) in order."""
    state, out = {}, {}
    for user, event, t, ok in sorted(attempts, key=lambda a: (a[2], a[1], a[3])):
        count, start = state.get(user, (0, None))
        if start is None or t - start >= window:
            count, start = 0, t
        out[event] = count >= most
        if not out[event]:
            count, start = (0, None) if ok else (count + 1, start)
        state[user] = (count, start)
    return out


@pytest.mark.parametrize("most,window", [(1, 1), (2, 5), (5, 60), (3, 7)])
def test_transition_arrays_agree_with_judging(most, window):
    rng = random.Random(most * window)
    m = L.Throttle(most, window)
    for _ in range(60):
        n = rng.randrange(1, 25)
        now = np.sort(np.array([rng.randrange(0, 3 * window + 1) for _ in range(n)], np.int64))
        ok = np.array([rng.random() < 0.25 for _ in range(n)])
        whole = m.transition(now, ok)
        assert len(whole) == m.size and whole.min() >= 0 and whole.max() < m.size
        # two halves, one after the other, do what the whole does
        cut = rng.randrange(1, n) if n > 1 else n
        if cut < n:
            a, b = m.transition(now[:cut], ok[:cut]), m.transition(now[cut:], ok[cut:])
            assert (b[m.aged(a, int(now[cut] - now[cut - 1]))] == whole).all()
            for entry in rng.sample(range(m.size), min(6, m.size)):
                middle = int(m.aged(a[[entry]], int(now[cut] - now[cut - 1]))[0])
                assert (m.judge(now, ok, entry) == np.append(m.judge(now[:cut], ok[:cut], entry), m.judge(now[cut:], ok[cut:], middle))).all()


def frame(spark, attempts):
    rows = [(u, e, None if t is None else T0 + timedelta(seconds=t), ok) for u, e, t, ok in attempts]
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, ok boolean")


def test_one_endless_user_is_cut_into_composed_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 16)
    monkeypatch.setattr(L, "FAN", 3)
    rng = random.Random(3)
    t, attempts = 0, []
    for e in range(1500):  # never a gap of a window: one burst without end
        t += rng.choice([0, 0, 1, 3, 20])
        attempts.append((7, e, t, rng.random() < 0.1))
    big = 9_007_199_254_740_993  # a double would lose the last digit
    attempts += [(big, 2000 + i, 5 * i, False) for i in range(40)] + [(None, 3000 + i, i, i == 3) for i in range(50)]
    got = L.burst_throttle(frame(spark, attempts)).collect()
    assert {r.event_id: r.blocked for r in got} == loop(attempts, 5, 60)
    assert sorted((r.user_id is None, r.user_id) for r in got if r.event_id >= 2000) == sorted((u is None, u) for u, e, _, _ in attempts if e >= 2000)
    # the work of the one user is spread: no task of the judging pass has more than a chunk of it
    laid = L.numbered(frame(spark, attempts), [F.col("ts"), F.col("event_id")], "n", ["user_id"])
    sizes = laid.groupBy("user_id", F.floor((F.col("n") - 1) / 16)).count().agg(F.max("count")).first()[0]
    assert sizes == 16


def test_null_users_times_and_outcomes(spark):
    attempts = [(None, i, i, False) for i in range(8)] + [(1, 20, None, False), (None, 21, None, True)] + [(1, 30 + i, i, None) for i in range(7)]
    got = {r.event_id: r.blocked for r in L.burst_throttle(frame(spark, attempts)).collect()}
    assert got == {**{i: i >= 5 for i in range(8)}, 20: False, 21: False, **{30 + i: i >= 5 for i in range(7)}}
    assert L.burst_throttle(frame(spark, attempts).limit(0)).collect() == []
    assert not any(r.blocked for r in L.burst_throttle(frame(spark, attempts), 0).collect())


def test_sessions_keep_null_users(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2]), T0 + timedelta(seconds=rng.randrange(0, 400_000))) for _ in range(400)] + [(1, None), (None, None)]
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp")
    key = lambda r: (r.user_id is None, r.user_id or 0, r.session_start)
    a, b = sorted(L.sessionize(ev).collect(), key=key), sorted(L.sessionize_window(ev).collect(), key=key)
    assert a == b and any(r.user_id is None for r in a)


def test_numbering_over_many_tasks(spark):
    from linewise.operators.numbering import numbered
    rows = [(None if i % 3 == 0 else "hot", i % 50, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    got = numbered(df.repartition(7), [F.col("v").desc(), F.col("n").asc()], "rank", ["g"]).collect()
    for g in (None, "hot"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.v, r.n) for r in mine] == sorted(((r.v, r.n) for r in mine), key=lambda x: (-x[0], x[1]))
    assert numbered(df.limit(0), [F.col("v")]).collect() == []
