"""Scan history, trends, incremental re-scan planning and listing diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.config import UiConfig
from linewise.functions.text import grade_at_or_below, iso_ts
from linewise.operators.numbering import numbered

HISTORY_JSON_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("file_count", T.StringType()), T.StructField("issue_count", T.StringType()),
    T.StructField("tqi", T.StringType()), T.StructField("grade", T.StringType()),
    T.StructField("duplicate_blocks", T.StringType()),
])


def history_to_json_rows(history: DataFrame) -> DataFrame:
    """Snapshot rows in the on-disk form (ISO timestamp string)."""
    return history.select("project", iso_ts(F.col("ts")).alias("timestamp"), "file_count", "issue_count", "tqi",
                          "grade", "duplicate_blocks")


def append_history(history: DataFrame, path: str) -> None:
    """Append snapshots to the NDJSON store (never rewrites older lines)."""
    history_to_json_rows(history).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON snapshots read with string fields then typed: bad or missing
    numbers become 0, a missing grade becomes 'F', a missing or unparsable
    timestamp drops the row."""
    raw = spark.read.schema(HISTORY_JSON_SCHEMA).option("mode", "PERMISSIVE").json(path)

    def num(c, t):
        return F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t))

    ts = F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    out = raw.select(F.coalesce(F.col("project"), F.lit("default")).alias("project"), ts.alias("ts"),
                     num("file_count", "long").alias("file_count"), num("issue_count", "long").alias("issue_count"),
                     num("tqi", "double").alias("tqi"),
                     F.coalesce(F.nullif(F.col("grade"), F.lit("")), F.lit("F")).alias("grade"),
                     num("duplicate_blocks", "long").alias("duplicate_blocks"))
    return out.filter(F.col("ts").isNotNull())


def history_ring(history: DataFrame, keep: int = UiConfig.history_max) -> DataFrame:
    """Newest `keep` snapshots per project (row_number limit, planned as a
    partial WindowGroupLimit before the exchange).  Snapshots of one time are
    ordered by their other columns, so the same ones stay on any cluster."""
    ties = [F.desc(c) for c in sorted(history.columns) if c not in ("project", "ts")]
    w = Window.partitionBy("project").orderBy(F.desc("ts"), *ties)
    return history.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep).drop("age")


def trend(history: DataFrame) -> DataFrame:
    """Ordered tqi / issue series with deltas; projects with >= 2 points.

    Numbered over all tasks (a long series is not sorted in one), by time and
    then by the other columns; each point meets the one before it by number."""
    ties = [F.col(c).asc() for c in sorted(history.columns) if c not in ("project", "ts")]
    laid = numbered(history, [F.col("ts").asc(), *ties], "seq", ["project"])
    before = laid.select(F.col("project").alias("_p"), (F.col("seq") + 1).alias("_s"), F.col("tqi").alias("_tqi"), F.col("issue_count").alias("_n"))
    points = laid.groupBy(F.col("project").alias("_q")).agg(F.max("seq").alias("points")).filter("points >= 2")
    return (laid.join(points, F.col("project").eqNullSafe(F.col("_q")))
                .join(before, F.col("project").eqNullSafe(F.col("_p")) & (F.col("seq") == F.col("_s")), "left")
                .withColumn("tqi_delta", F.col("tqi") - F.col("_tqi"))
                .withColumn("issue_delta", F.col("issue_count") - F.col("_n"))
                .select(*history.columns, "points", "seq", "tqi_delta", "issue_delta"))


def grade_alerts(history: DataFrame, threshold: str = "C") -> DataFrame:
    """Snapshots whose grade is at or below the threshold ('below' includes
    equal)."""
    return history.filter(grade_at_or_below(F.col("grade"), threshold))


def change_set(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(project, path, change) with change in added / modified / removed."""
    p, c = prev.alias("p"), cur.alias("c")
    j = p.join(c, (F.col("p.project") == F.col("c.project")) & (F.col("p.path") == F.col("c.path")), "full_outer")
    change = (F.when(F.col("p.path").isNull(), "added").when(F.col("c.path").isNull(), "removed")
              .when(~F.col("p.mtime").eqNullSafe(F.col("c.mtime")), "modified"))
    return (j.select(F.coalesce("c.project", "p.project").alias("project"), F.coalesce("c.path", "p.path").alias("path"),
                     change.alias("change")).filter(F.col("change").isNotNull()))


def incremental_plan(cached: DataFrame, cur: DataFrame) -> DataFrame:
    """(project, path, mtime, action): reuse when (project, path, mtime) is in
    the cache of the previous scan, else recompute (also without a time)."""
    key = ["project", "path", "mtime"]
    known = cached.select(*key).distinct().withColumn("_known", F.lit(True))
    return (cur.join(known, key, "left")
               .withColumn("action", F.when(F.col("_known"), "reuse").otherwise("recompute")).drop("_known"))


def incremental_metrics(cached_metrics: DataFrame, cur_files: DataFrame, compute) -> DataFrame:
    """Metrics of the current files: cached rows whose (project, path, mtime)
    is unchanged, freshly computed rows for the rest (`compute(files)`)."""
    key = ["project", "path", "mtime"]
    fresh = compute(cur_files.join(cached_metrics.select(*key), key, "left_anti"))
    kept = cached_metrics.join(cur_files.select(*key), key, "left_semi").select(*cached_metrics.columns)
    return kept.unionByName(fresh)


def listing_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Rows present on one side only (multiset difference both ways)."""
    cols = ["project", "path", "mtime"]
    a = prev.select(*cols).exceptAll(cur.select(*cols)).withColumn("side", F.lit("prev_only"))
    b = cur.select(*cols).exceptAll(prev.select(*cols)).withColumn("side", F.lit("cur_only"))
    return a.unionByName(b)
