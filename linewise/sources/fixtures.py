"""Deterministic views derived from the driver tables (FIXTURES.md §2.2).

Each is a projection / aggregate of `documents` or `events`, so its size
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise import fixed
from linewise.config import ScoreConfig
from linewise.functions.text import grade, issue_key
from linewise.operators.lines import explode_lines
from linewise.sources.corpus import documents_as_files, documents_raw, read_table

T0 = "2024-01-01 00:00:00"
SECRET_LINE = 'password = "hunter2x"'
SECRET_RULE = "SEC-HARDCODED-SECRET"


def doc_id_of(path) -> F.Column:
    return F.regexp_extract(path, r"doc([0-9]+)\.", 1).try_cast("long")


def issue_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, status, note, updated_at): one row per hard-coded-secret line of
    documents with doc_id % 3 = 0, a second, later row when doc_id % 6 = 0,
    and a row with an invalid status when doc_id % 9 = 0."""
    ln = explode_lines(documents_as_files(spark, sf_dir)).filter(F.col("text") == SECRET_LINE)
    ln = ln.withColumn("doc_id", doc_id_of(F.col("path"))).filter(F.col("doc_id") % 3 == 0)
    statuses = F.array(*[F.lit(s) for s in fixed.ISSUE_STATUSES])
    key = issue_key(F.col("project"), F.lit(SECRET_RULE), F.col("path"), F.col("n"))
    base_ts = F.timestamp_add("MINUTE", F.col("n"), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    first = ln.select(key.alias("key"),
                      F.element_at(statuses, ((F.col("doc_id") + F.col("n")) % 4 + 1).cast("int")).alias("status"),
                      F.concat(F.lit("review "), F.col("n").cast("string")).alias("note"),
                      base_ts.alias("updated_at"))
    second = (ln.filter(F.col("doc_id") % 6 == 0)
                .select(key.alias("key"),
                        F.element_at(statuses, ((F.col("doc_id") + F.col("n") + 1) % 4 + 1).cast("int")).alias("status"),
                        F.lit("re-review").alias("note"),
                        F.timestamp_add("DAY", F.lit(1), base_ts).alias("updated_at")))
    bad = (ln.filter(F.col("doc_id") % 9 == 0)
             .select(key.alias("key"), F.lit("closed").alias("status"), F.lit("bad status").alias("note"),
                     F.timestamp_add("DAY", F.lit(2), base_ts).alias("updated_at")))
    return first.unionByName(second).unionByName(bad)


def history_snapshots(spark: SparkSession, sf_dir: str, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """(project, ts, file_count, issue_count, tqi, grade, duplicate_blocks):
    one snapshot per (user_id % 5, day) of events; projects p0 and p1 use
    12-hour bins and so exceed 50 snapshots."""
    e = read_table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    mod = F.col("user_id") % 5
    project = F.concat(F.lit("p"), mod.cast("string"))
    ts = F.col("ts").cast("timestamp")
    half_day = F.timestamp_add("HOUR", (F.floor(F.hour(ts) / 12) * 12).cast("int"), F.date_trunc("DAY", ts))
    bin_ts = F.when(mod < 2, half_day).otherwise(F.date_trunc("DAY", ts))
    g = (e.groupBy(project.alias("project"), bin_ts.alias("ts"))
          .agg(F.countDistinct("user_id").alias("file_count"), F.count("*").alias("issue_count"),
               F.count_if(F.col("event_type") == "error").alias("errors"),
               F.count_if(F.col("event_type") == "purchase").alias("duplicate_blocks")))
    tqi = F.lit(100.0) - F.least(F.lit(100.0), F.col("errors").cast("double"))
    return g.select("project", "ts", "file_count", "issue_count", tqi.alias("tqi"), grade(tqi, cfg).alias("grade"),
                    "duplicate_blocks")


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(listing_prev, listing_cur) of (project, path, mtime).
    cur: every document file; prev lacks doc_id % 11 = 0 (added), has the
    files doc_id % 13 = 0 that cur lacks (removed) and an older mtime for
    doc_id % 4 = 0 (modified)."""
    raw = documents_raw(spark, sf_dir).select("project", "path", "mtime", "doc_id")
    cur = raw.filter(F.col("doc_id") % 13 != 0).select("project", "path", "mtime")
    prev_mtime = F.when(F.col("doc_id") % 4 == 0, F.timestamp_add("HOUR", F.lit(-1), F.col("mtime"))) \
                  .otherwise(F.col("mtime"))
    prev = raw.filter(F.col("doc_id") % 11 != 0).select("project", "path", prev_mtime.alias("mtime"))
    return prev, cur


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, level, message) from events."""
    e = read_table(spark, sf_dir, "events")
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN")
             .when(F.col("event_type") == "purchase", "INFO").otherwise("DEBUG"))
    msg = F.concat_ws(" ", F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"),
                      F.lit("event"), F.col("event_id").cast("string"))
    return e.select(F.col("ts").cast("timestamp").alias("timestamp"), level.alias("level"), msg.alias("message"),
                    F.col("event_id"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, ok, event_id): error = failed attempt, signup = success."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup"))
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("event_type") == "signup").alias("ok"), "event_id")


def events_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts cast to TIMESTAMP (watermarks reject timestamp_ntz)."""
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
