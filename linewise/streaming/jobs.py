"""Structured Streaming jobs.

Each job reads a file stream (parquet), applies the same operators as the
batch plans, and writes through a checkpointed sink under the shared
checkpoint folder, so a restarted job resumes without duplicates.
`run_*` helpers drive a job with trigger(availableNow=True) and return the
sink as a DataFrame (used by tests and the registered queries).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.config import ScanConfig, UiConfig
from linewise.functions.text import grade_at_or_below, log_level_from, log_level_rank
from linewise.operators import lines as LN
from linewise.operators import rules as R
from linewise.plans.facts import file_facts
from linewise.session import shared_path
from linewise.streaming import stateful


def fresh(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"linewise-stream/{name}-{uuid.uuid4().hex[:12]}")


FILE_BYTES = 32 << 20  # bytes of a frame's input that one staged file takes, about
_BATCH = "_files_per_batch-"


def _spread(df: DataFrame, parts: int) -> int:
    """How many files one of `parts` slices of a frame takes: more as its input grows."""
    spark = df.sparkSession
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    size = 0
    for name in df.inputFiles():
        p = path_of(name)
        size += p.getFileSystem(conf).getFileStatus(p).getLen()
    return max(1, -(-size // (parts * FILE_BYTES)))


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _write_slice(df: DataFrame, path: str, files: int, mode: str) -> None:
    """df as exactly `files` files (empty ones fill up), written by as many tasks."""
    spark = df.sparkSession
    count = lambda: sum(not n.startswith(("_", ".")) for n in _names(spark, path))
    before = 0 if mode == "overwrite" else count()
    (df.coalesce(1) if files == 1 else df.repartition(files)).write.option("maxRecordsPerFile", 0).mode(mode).parquet(path)
    for _ in range(files - (count() - before)):
        df.limit(0).coalesce(1).write.mode("append").parquet(path)


def stage(df: DataFrame, path: str, parts: int = 4, order_by: str | None = None, tick: dict | None = None) -> str:
    """Write a frame as `parts` slices of parquet files: the stream then sees several
    micro-batches when read with file_stream, one for each slice (in event-time order
    when order_by names the time column; rows without a time come first).  A slice
    is one file, or as many as its size needs; a mark in the folder says how many.
    tick: values of one last row, a clock tick three days after all others, which
    moves the watermark past them (columns that it does not name are null)."""
    spark, files = df.sparkSession, _spread(df, parts)
    if not order_by:
        df.repartition(parts * files).write.mode("overwrite").parquet(path)
        _mark(spark, path, files)
        return path
    # The file source orders files by modification time: write the time
    # slices one after the other, split at approximate quantiles (a few
    # scalars reach the driver).
    secs = F.unix_micros(F.col(order_by).cast("timestamp"))
    cuts = df.select(secs.alias("_t")).approxQuantile("_t", [i / parts for i in range(1, parts)], 0.001)
    bounds = [None, *cuts, None]
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (secs >= F.lit(int(lo)))
        if hi is not None:
            cond = cond & (secs < F.lit(int(hi)))
        _write_slice(df.filter(F.coalesce(cond, F.lit(i == 0))), path, files, "overwrite" if i == 0 else "append")
    if tick is not None:
        last = df.agg(F.max(order_by).alias("_t")).filter("_t is not null")
        at = F.timestamp_add("DAY", F.lit(3), F.col("_t"))
        row = [(at if c == order_by else F.lit(tick.get(c))).cast(df.schema[c].dataType).alias(c) for c in df.columns]
        last.select(*row).write.mode("append").parquet(path)
    _mark(spark, path, files)
    return path


def append_slices(df: DataFrame, path: str, parts: int) -> None:
    """Later rows of a staged stream, in batches no larger than its first ones."""
    df.repartition(parts * _spread(df, parts)).write.mode("append").parquet(path)


def _mark(spark: SparkSession, path: str, files: int) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_BATCH}{files}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Batches of files_per_trigger files; by default of a staged slice, else of one file."""
    if files_per_trigger is None:
        marked = [int(n[len(_BATCH):]) for n in _names(spark, path) if n.startswith(_BATCH)]
        files_per_trigger = max(marked, default=1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _finish(query) -> None:
    query.awaitTermination()
    ex = query.exception()
    if ex is not None:
        raise RuntimeError(str(ex))


# ------------------------------------------------------------------ watch scan
def watch_scan(spark: SparkSession, files_path: str, schema, sink: str, ckpt: str,
               cfg: ScanConfig = ScanConfig()) -> None:
    """Sightings of files (content null: the file is gone; seen: which listing)
    -> facts of the files that were added or edited, and a mark for removed ones.

    Keyed state (per bucket of files: path -> time, content hash) lets only changes
    through.  Each batch writes what changed in it to a folder of its own, which a batch that is
    run again overwrites; `watched` reads the present state of the corpus."""
    rows = stateful.sightings(file_stream(spark, files_path, schema))
    changes = rows.groupBy("bucket").transformWithStateInPandas(stateful.Listing(), stateful.CHANGE, "Append", "none")

    def write(batch: DataFrame, epoch: int) -> None:
        # the state runs once: what it let through is written before it is evaluated
        at = f"{sink}/changes/epoch={epoch}"
        batch.write.mode("overwrite").parquet(at)
        changed = batch.sparkSession.read.schema(batch.schema).parquet(at)
        facts = file_facts(changed.filter("change != 'removed'"), cfg).withColumn("removed", F.lit(False))
        gone = changed.filter("change = 'removed'").select("project", "path", F.lit(True).alias("removed"))
        facts.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{sink}/facts/epoch={epoch}")

    with stateful.state_in_rocksdb(spark):
        q = (changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())
        _finish(q)


def watched(spark: SparkSession, sink: str) -> DataFrame:
    """The facts of the corpus as watch_scan last saw it: per file the last batch's row."""
    facts = spark.read.parquet(f"{sink}/facts")
    last = facts.groupBy("project", "path").agg(F.max("epoch").alias("epoch"))
    return facts.join(last, ["project", "path", "epoch"]).filter("not removed").drop("removed", "epoch")


# ------------------------------------------------------------------ rule counts
def rule_counts(spark: SparkSession, files_path: str, schema, sink: str, ckpt: str,
                window: str = "1 hour", slide: str = "30 minutes", delay: str = "1 day",
                cfg: ScanConfig = ScanConfig()) -> None:
    """Live rule-hit counts per (sliding event-time window of the file mtime,
    rule, severity), before platform-guard suppression (the batch plan applies
    it).  Append mode: a window is written once, when the watermark passes its
    end, and then leaves the state; rows later than `delay` are dropped."""
    files = file_stream(spark, files_path, schema).withWatermark("mtime", delay)
    ln = (files.select("project", "path", "language", "mtime", F.posexplode(LN.lines_array(F.col("content"))))
               .select("project", "path", "language", "mtime", (F.col("pos") + 1).alias("n"), F.col("col").alias("text")))
    iss = _issues_with_mtime(ln, cfg)
    agg = (iss.groupBy(F.window("mtime", window, slide).alias("w"), "rule_id", "severity")
              .agg(F.count("*").alias("issues")))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule_id", "severity", "issues")
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(availableNow=True).start())
    _finish(q)


def _issues_with_mtime(ln: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Rule hits keeping the line's event time (stateless per line)."""
    rs = R.select_rules(cfg)
    text = F.col("text")
    hits = F.array_compact(F.array(*[R._hit(r, text, cfg) for r in rs]))
    return (R.rule_lines(ln, cfg)
              .select("project", "path", "mtime", F.col("n").alias("line"), F.explode(hits).alias("r"))
              .select("project", "path", "mtime", "line", "r.rule_id", "r.severity"))


# ------------------------------------------------------------------ latest file
def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versioned_merge(table: str, reduce):
    """foreachBatch body: merge the batch into table version (epoch - 1) and
    write version epoch.  Batch ids come from the checkpoint, so a restarted
    query re-writes the same version instead of duplicating rows.  A version
    counts once its writer has committed it (its _SUCCESS file), so readers see
    the one before or this one, never a part."""
    def body(batch: DataFrame, epoch: int) -> None:
        sp = batch.sparkSession
        merged = batch
        # only a version that does not exist is "no rows yet"; one that cannot be read fails the batch
        if epoch > 0 and exists(sp, f"{table}/v{epoch - 1}"):
            merged = sp.read.parquet(f"{table}/v{epoch - 1}").unionByName(batch)
        reduce(merged).write.mode("overwrite").parquet(f"{table}/v{epoch}")
    return body


def latest_file(spark: SparkSession, listing_path: str, schema, table: str, ckpt: str) -> None:
    """Keyed upsert: newest mtime per (project, path) into a versioned
    parquet table."""
    reduce = lambda df: df.groupBy("project", "path").agg(F.max("mtime").alias("mtime"))
    q = (file_stream(spark, listing_path, schema).writeStream.foreachBatch(_versioned_merge(table, reduce))
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _finish(q)


def read_versioned(spark: SparkSession, table: str) -> DataFrame:
    """The last committed version of a versioned upsert table."""
    from linewise.plans.store import versions
    done = [int(name[1:]) for _, name in versions(spark, table) if name[1:].isdigit()]
    if not done:
        raise FileNotFoundError(f"no committed version under {table}")
    return spark.read.parquet(f"{table}/v{max(done)}")


# ------------------------------------------------------------------ status upsert
def status_upsert(spark: SparkSession, status_path: str, schema, table: str, ckpt: str) -> None:
    """Status changes merged into the status table: valid statuses only,
    last write per key wins (max_by over updated_at)."""
    from linewise.operators.issues import latest_status, status_valid
    reduce = lambda df: latest_status(status_valid(df))
    q = (file_stream(spark, status_path, schema).writeStream.foreachBatch(_versioned_merge(table, reduce))
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _finish(q)


# ------------------------------------------------------------------ grade alerts
def grade_alert(spark: SparkSession, history_path: str, schema, sink: str, ckpt: str, threshold: str = "C") -> None:
    """Snapshots whose grade is at or below the threshold -> alert table."""
    s = file_stream(spark, history_path, schema)
    out = s.filter(grade_at_or_below(F.col("grade"), threshold))
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(availableNow=True).start())
    _finish(q)


# ------------------------------------------------------------------ log ring
def log_ring(spark: SparkSession, logs_path: str, schema, table: str, ckpt: str, min_level: str = "info",
             keep: int = UiConfig.log_max_entries, shards: int = 8) -> None:
    """The newest `keep` log entries at or above min_level, in keyed state of at
    most `keep` entries for each of `shards` keys.  The versioned table holds
    the shards' rings, so it is as bounded as the state."""
    s = file_stream(spark, logs_path, schema)
    s = s.filter(log_level_rank(log_level_from(F.col("level"))) >= log_level_rank(F.lit(min_level)))
    rings = stateful.ring_entries(s, shards).groupBy("shard").transformWithStateInPandas(stateful.LogRing(keep), stateful.RING_OUT, "Append", "none")

    def newest(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("shard").agg(F.max("turn").alias("turn")), ["shard", "turn"])
    with stateful.state_in_rocksdb(spark):
        q = (rings.writeStream.foreachBatch(_versioned_merge(table, newest)).option("checkpointLocation", ckpt)
                .outputMode("append").trigger(availableNow=True).start())
        _finish(q)


def read_ring(spark: SparkSession, table: str) -> DataFrame:
    """timestamp, level, message, event_id of all shards' rings."""
    return read_versioned(spark, table).select(F.timestamp_micros("at").alias("timestamp"), "level", "message", "event_id")


# ------------------------------------------------------------------ sessions
def sessions(spark: SparkSession, events_path: str, schema, sink: str, ckpt: str,
             gap: str = "60 minutes", delay: str = "2 hours") -> None:
    """session_window per user with a watermark; append mode emits a session
    once the watermark passes its end (late rows are dropped)."""
    s = file_stream(spark, events_path, schema).withWatermark("ts", delay)
    agg = (s.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
             .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"))
    q = (agg.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(availableNow=True).start())
    _finish(q)


# ------------------------------------------------------------------ throttle
def throttle(spark: SparkSession, attempts_path: str, schema, sink: str, ckpt: str,
             max_attempts: int = 5, window_s: int = 60, delay: str = "2 hours") -> None:
    """Per-user throttle in event time: attempts that come out of order, by up to
    `delay`, are judged in order once the watermark has passed them; users whose
    window has ended leave the state."""
    s = file_stream(spark, attempts_path, schema).withWatermark("ts", delay)
    kind = schema["user_id"].dataType
    rows = s.select(F.col("user_id").cast("string").alias("user_id"), "event_id", "ts", "ok")
    machine = stateful.OrderedThrottle(max_attempts, window_s)
    # the watermark's column stays a timestamp; the processor takes microseconds
    judged = rows.withColumn("ts_micros", F.unix_micros("ts")).groupBy("user_id").transformWithStateInPandas(
        machine, stateful.JUDGED, "Append", "EventTime")
    out = judged.select(F.col("user_id").cast(kind).alias("user_id"), "event_id", F.timestamp_micros("ts").alias("ts"), "ok", "blocked")
    with stateful.state_in_rocksdb(spark):
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
                .outputMode("append").trigger(availableNow=True).start())
        _finish(q)
