"""Issue views: review status overlay, source preview, platform buckets,
paging, report listings and the plain-text digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise import fixed
from linewise.config import UiConfig
from linewise.functions.text import issue_key
from linewise.operators.rules import platform_bucket

STATUS_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("status", T.StringType()),
                              T.StructField("note", T.StringType()), T.StructField("updated_at", T.TimestampType())])


def write_issue_status(status: DataFrame, path: str) -> None:
    """Rewrite the whole status store as NDJSON (one object per line)."""
    status.write.mode("overwrite").json(path)


def read_issue_status(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON status store with an explicit schema.  Lines that are not JSON
    objects parse to all-NULL rows and are dropped with rows lacking key or
    status."""
    df = spark.read.schema(STATUS_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return df.filter(F.col("key").isNotNull() & (F.col("key") != "") & F.col("status").isNotNull())


def status_valid(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin(*fixed.ISSUE_STATUSES) & (F.col("key") != ""))


def status_rejected(status: DataFrame) -> DataFrame:
    return status.filter(~F.col("status").isin(*fixed.ISSUE_STATUSES) | (F.col("key") == ""))


def latest_status(status: DataFrame) -> DataFrame:
    """Last write per key wins: a max aggregate (partial aggregation, no
    per-key sort).  A write without a time counts as the oldest; of writes with
    one time the greater (status, note) wins, so the result is fixed."""
    at = F.coalesce("updated_at", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    latest = F.max(F.struct(at.alias("at"), "status", "note", "updated_at"))
    return (status.groupBy("key").agg(latest.alias("s"))
                  .select("key", "s.status", "s.note", "s.updated_at"))


def overlay_status(issues: DataFrame, status: DataFrame) -> DataFrame:
    """issues left-joined to the latest status; default open / ''."""
    st = latest_status(status_valid(status)).select("key", F.col("status").alias("_st"), F.col("note").alias("_note"))
    return (issues.join(st, "key", "left")
                  .withColumn("status", F.coalesce("_st", F.lit("open")))
                  .withColumn("note", F.coalesce("_note", F.lit("")))
                  .drop("_st", "_note"))


def file_previews(files: DataFrame, context: int = 4) -> DataFrame:
    """(project, path, lines array, issues array) -> per issue the lines line-context … line+context,
    clipped to the file; for a finding without a line, the first 2*context+1.
    Cut out of the file's row: no line leaves it but those shown."""
    many = 2 * context + 1
    lo = f"if(coalesce(i.line, 0) <= 0, 1, greatest(1, i.line - {context}))"
    hi = f"least(size(lines), if(coalesce(i.line, 0) <= 0, {many}, i.line + {context}))"
    shown = f"transform(sequence({lo}, {hi}), n -> concat(n, ': ', lines[n - 1]))"
    each = (f"transform(filter(issues, i -> not i.silenced and {lo} <= {hi}), i -> struct(i.rule_id as rule_id, i.line as line, {lo} as from_line, {hi} as to_line, "
            f"cast({hi} - {lo} + 1 as long) as n_lines, array_join({shown}, '\n') as preview))")
    d = files.select("project", "path", F.inline(F.expr(each)))
    key = issue_key(F.col("project"), F.col("rule_id"), F.col("path"), F.col("line"))
    return d.select(key.alias("key"), "project", "path", "line", "from_line", "to_line", "n_lines", "preview")


def platform_counts(issues: DataFrame) -> DataFrame:
    return (issues.withColumn("bucket", platform_bucket(F.col("rule_id")))
                  .groupBy("project", "bucket").agg(F.count("*").alias("issues")))


def platform_top(issues: DataFrame, n: int = 8) -> DataFrame:
    """First n findings per (project, bucket) in scan order + remainder."""
    b = issues.withColumn("bucket", platform_bucket(F.col("rule_id")))
    w = Window.partitionBy("project", "bucket").orderBy("path", "line", "rule_ord")
    totals = b.groupBy("project", "bucket").agg(F.count("*").alias("total"))     # partial aggregation
    top = b.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)  # partial WindowGroupLimit
    return (top.join(totals, ["project", "bucket"])
               .withColumn("remainder", F.greatest(F.col("total") - n, F.lit(0))))


def severity_filter(issues: DataFrame, severity: str = "all") -> DataFrame:
    return issues if severity == "all" else issues.filter(F.col("severity") == severity)


def issue_page(issues: DataFrame, severity: str = "all", n: int = UiConfig.max_table_rows) -> DataFrame:
    """Filtered issues of each project in scan order, capped at n rows."""
    w = Window.partitionBy("project").orderBy("path", "line", "rule_ord")
    return (severity_filter(issues, severity).withColumn("rank", F.row_number().over(w))
                                             .filter(F.col("rank") <= n))


def report_top_issues(issues: DataFrame, n: int = UiConfig.pdf_max_issues) -> DataFrame:
    return issue_page(issues, "all", n)


def report_digest(report: DataFrame, issues: DataFrame, n: int = UiConfig.max_report_issues) -> DataFrame:
    """Plain-text summary per project: counts, integer-truncated scores and
    the first n issues in scan order (`severity rule_id path:line`)."""
    top = issue_page(issues, "all", n)
    item = F.struct("rank", F.format_string("%s %s %s:%d", F.col("severity"), F.col("rule_id"), F.col("path"),
                                            F.col("line")).alias("s"))
    lst = (top.groupBy("project").agg(F.array_sort(F.collect_list(item)).alias("items"))
              .select("project", F.array_join(F.transform("items", lambda x: x["s"]), "\n").alias("top")))
    head = F.format_string("files=%d code_lines=%d issues=%d tqi=%d grade=%s security=%d robustness=%d "
                           "efficiency=%d transferability=%d changeability=%d portability=%d",
                           "file_count", "code_lines", "issue_count", F.floor("tqi").cast("int"), "grade",
                           *[F.floor(f).cast("int") for f in fixed.FACTORS[1:2] + fixed.FACTORS[0:1] + fixed.FACTORS[2:]])
    return (report.select("project", head.alias("head")).join(lst, "project", "left")
                  .select("project", F.concat_ws("\n", "head", F.coalesce("top", F.lit(""))).alias("digest")))


def new_critical_issues(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Critical issues of this scan absent from the previous scan, matched on
    project, rule, path and the hash of the whole line."""
    same = ["project", "rule_id", "path", "line_hash"]
    prev = previous.filter(F.col("severity") == "critical").select(*same).distinct()
    return current.filter(F.col("severity") == "critical").join(prev, same, "left_anti")
