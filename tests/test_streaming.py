"""Keyed stream state: bounds, restarts, late rows, edits and removals."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linewise.operators import logs as L
from linewise.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def folders(spark, *names):
    return [S.fresh(spark, f"t-{n}") for n in names]


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def state(spark, ckpt, var=None):
    with S.stateful.state_in_rocksdb(spark):
        r = spark.read.format("statestore").option("path", ckpt)
        if var:
            r = r.option("stateVarName", var)
        return r.load().collect()


def test_log_ring_is_bounded_and_survives_a_restart(spark):
    rows = [(T0 + timedelta(seconds=(i * 37) % 500), ["ERROR", "INFO", "DEBUG", None][i % 4], f"m{i}", i) for i in range(300)]
    logs = spark.createDataFrame(rows + [(None, "ERROR", "no time", 999)], "timestamp timestamp, level string, message string, event_id long")
    src, table, ckpt = folders(spark, "src", "table", "ckpt")
    for part in range(3):
        add(logs.filter(F.coalesce(F.col("event_id") % 3 == part, F.lit(part == 0))), src)
        S.log_ring(spark, src, logs.schema, table, ckpt, "info", keep=20, shards=3)  # each call is a restart
    got = L.log_recent(S.read_ring(spark, table), "info", 20).collect()
    want = L.log_recent(logs.filter("timestamp is not null"), "info", 20).select("timestamp", "level", "message", "event_id").collect()
    assert got == want
    assert S.read_ring(spark, table).count() == 60
    held = state(spark, ckpt, "ring")
    per_key = {}
    for r in held:
        per_key[r.key.shard] = per_key.get(r.key.shard, 0) + (len(r.list_element) if isinstance(r.list_element, list) else 1)
    assert per_key and max(per_key.values()) <= 20


def attempts(spark, rows):
    return spark.createDataFrame([(u, e, T0 + timedelta(seconds=t), ok) for u, e, t, ok in rows], "user_id long, event_id long, ts timestamp, ok boolean")


def test_throttle_orders_late_attempts_and_lets_idle_users_go(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for e in range(600):
        t += rng.choice([0, 1, 2, 8])
        rows.append((rng.choice([1, 2, 2, 2, None]), e, t, rng.random() < 0.15))
    # chunks that overlap in time by much less than the watermark's delay, each in random order
    shaken = sorted(rows, key=lambda r: r[2] + rng.randrange(0, 300))
    src, sink, ckpt = folders(spark, "src", "sink", "ckpt")
    df = attempts(spark, rows)
    for lo in range(0, 600, 150):
        part = shaken[lo:lo + 150]
        rng.shuffle(part)
        add(attempts(spark, part), src)
        S.throttle(spark, src, df.schema, sink, ckpt, delay="10 minutes")
    held = len({str(r.key) for r in state(spark, ckpt, "waiting")})
    assert 0 < held <= 3  # users, not attempts
    add(spark.createDataFrame([(None, None, T0 + timedelta(days=3), None)], df.schema), src)  # a clock tick
    S.throttle(spark, src, df.schema, sink, ckpt, delay="10 minutes")
    got = {r.event_id: (r.user_id, r.blocked) for r in spark.read.parquet(sink).collect()}
    want = {r.event_id: (r.user_id, r.blocked) for r in L.burst_throttle(df).collect()}
    assert got == want and any(b for _, b in want.values())
    assert state(spark, ckpt, "waiting") == [] and state(spark, ckpt, "state") == []


def test_watch_emits_edits_and_removals_only(spark):
    kinds = "project string, path string, ext string, language string, content string, size long, mtime timestamp, seen int"

    def sight(seen, **files):
        return spark.createDataFrame([("p", k + ".c", ".c", "C", c, None if c is None else len(c), T0 + timedelta(hours=h), seen) for k, (c, h) in files.items()], kinds)
    src, sink, ckpt = folders(spark, "src", "sink", "ckpt")

    def scan(df):
        add(df, src)
        S.watch_scan(spark, src, df.schema, sink, ckpt)
        issues = F.expr("transform(issues, i -> i.rule_id)")
        return {r.path: (r.code_lines, r.rules) for r in S.watched(spark, sink).select("path", "code_lines", issues.alias("rules")).collect()}
    assert scan(sight(1, a=("int a;\n", 0), b=("md5(x);\n", 0), c=("int c;\nint d;\n", 0))) == {"a.c": (1, []), "b.c": (1, ["SEC-WEAK-HASH"]), "c.c": (2, [])}
    # a is edited, b goes, c is seen unchanged, d was never there, e is new
    assert scan(sight(2, a=("int a;\nint b;\n", 1), b=(None, 0), c=("int c;\nint d;\n", 0), d=(None, 0), e=("", 0))) == {"a.c": (2, []), "c.c": (2, []), "e.c": (0, [])}
    changes = sorted((r.path, r.change) for r in spark.read.parquet(f"{sink}/changes").collect())
    assert changes == [("a.c", "added"), ("a.c", "modified"), ("b.c", "added"), ("b.c", "removed"), ("c.c", "added"), ("e.c", "added")]
    # two sightings in one batch: the later one counts; a file that comes back is new
    both = sight(3, a=("x", 2), b=("md5(y);\n", 3)).unionByName(sight(4, a=("int z;\n", 4)))
    assert scan(both) == {"a.c": (1, []), "b.c": (1, ["SEC-WEAK-HASH"]), "c.c": (2, []), "e.c": (0, [])}
    assert len(state(spark, ckpt, "known")) == 4


def test_rule_counts_leave_the_state_once_written(spark):
    rows = [("p", f"f{i}.c", "C", "md5(x);\n", T0 + timedelta(minutes=20 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "project string, path string, language string, content string, mtime timestamp")
    src, sink, ckpt = folders(spark, "src", "sink", "ckpt")
    add(df.filter("mtime < '2024-01-01 10:00:00'"), src)
    S.rule_counts(spark, src, df.schema, sink, ckpt, delay="1 hour")
    add(df.filter("mtime >= '2024-01-01 10:00:00'"), src)
    S.rule_counts(spark, src, df.schema, sink, ckpt, delay="1 hour")
    assert 0 < len(state(spark, ckpt)) <= 6  # windows of the last two hours, not all 41
    add(spark.createDataFrame([("tick", "tick", "tick", "tick", T0 + timedelta(days=3))], df.schema), src)
    S.rule_counts(spark, src, df.schema, sink, ckpt, delay="1 hour")
    got = sorted((r.window_start, r.issues) for r in spark.read.parquet(sink).collect())
    want = sorted((r.w.start, r["count"]) for r in df.groupBy(F.window("mtime", "1 hour", "30 minutes").alias("w")).count().collect())
    assert got == want and len(set(w for w, _ in got)) == len(got)
    assert state(spark, ckpt) == []


def test_stages_keep_rows_without_a_time(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else T0 + timedelta(seconds=i), i) for i in range(40)], "ts timestamp, i int")
    got = spark.read.parquet(S.stage(df, S.fresh(spark, "t-null"), 3, order_by="ts", tick={"i": -1}))
    assert sorted(r.i for r in got.collect()) == [-1, *range(40)]


def test_staged_slices_grow_in_files_not_in_file_size(spark, monkeypatch, tmp_path):
    """A slice of a larger frame is several files, which one batch takes together."""
    import os

    from linewise.streaming import jobs as S
    monkeypatch.setattr(S, "FILE_BYTES", 1000)
    src = str(tmp_path / "in")
    spark.range(4000).selectExpr("id as i", "timestamp_seconds(id) as ts").repartition(3).write.parquet(src)
    df = spark.read.parquet(src)
    path = S.stage(df, S.fresh(spark, "t-wide"), 2, order_by="ts", tick={"i": -1})
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    each = S._spread(df, 2)
    assert each > 3 and len(files) == 2 * each + 1
    seen = []
    q = (S.file_stream(spark, path, df.schema).writeStream.foreachBatch(lambda b, _: seen.append(b.selectExpr("count(*)", "min(i)", "max(i)").first()))
         .option("checkpointLocation", S.fresh(spark, "t-ck")).trigger(availableNow=True).start())
    S._finish(q)
    assert len(seen) == 3 and sum(n for n, _, _ in seen) == 4001
    assert seen[0][2] < seen[1][1] and tuple(seen[2]) == (1, -1, -1)


def test_a_slice_with_few_rows_still_has_its_files(spark, monkeypatch, tmp_path):
    import os

    from linewise.streaming import jobs as S
    path = S.fresh(spark, "t-few")
    d = spark.createDataFrame([(1,), (2,)], "i int")
    S._write_slice(d, path, 5, "overwrite")
    S._write_slice(d, path, 5, "append")
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 10
    assert spark.read.parquet(path).count() == 4
