"""Sinks: report JSON, issues CSV, issue-status NDJSON, metrics text.

All writers are distributed (`DataFrame.write`), partitioned by project
label; nothing is collected to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise import fixed
from linewise.functions.text import project_label

METRIC_PREFIX = "linewise"
CSV_COLUMNS = ["severity", "rule_id", "cwe", "file", "line", "title", "remediation_minutes"]


def report_struct(report: DataFrame) -> DataFrame:
    """One row per project with a JSON `report` document."""
    health = F.struct(*[F.col(f) for f in fixed.FACTORS], F.col("tqi"))
    debt = F.struct(F.col("debt_minutes").alias("total_minutes"), F.col("debt_hours").alias("total_hours"),
                    F.col("debt_cost").alias("cost"), F.col("debt_ratio"),
                    F.map_from_arrays(F.array(*[F.lit(s) for s in fixed.SEVERITIES]),
                                      F.array(*[F.col(f"n_{s}") for s in fixed.SEVERITIES])).alias("severity_counts"))
    rep = F.struct("file_count", "total_lines", "code_lines", "comment_lines", "blank_lines", "total_functions",
                   "total_cyclomatic", "max_complexity", "issue_count", "duplicate_blocks", "comment_ratio",
                   "avg_complexity", health.alias("health"), "grade", debt.alias("debt"))
    return report.select("project", F.to_json(rep).alias("report"))


def export_report_json(report: DataFrame, files: DataFrame, issues: DataFrame, out: str) -> None:
    """out/report, out/files, out/issues as JSON lines partitioned by project."""
    report_struct(report).write.mode("overwrite").partitionBy("project").json(f"{out}/report")
    files.write.mode("overwrite").partitionBy("project").json(f"{out}/files")
    issues.write.mode("overwrite").partitionBy("project").json(f"{out}/issues")


def issues_csv_frame(issues: DataFrame) -> DataFrame:
    return issues.select("project", "severity", "rule_id", "cwe", F.col("path").alias("file"),
                         F.col("line").cast("long").alias("line"), "title",
                         F.col("remediation_minutes").cast("long").alias("remediation_minutes"))


def export_issues_csv(issues: DataFrame, out: str, provenance: dict | None = None) -> None:
    """Header + RFC-4180 quoting; provenance goes to a sibling JSON file
    (written by Spark too, so nothing assumes a local file system)."""
    (issues_csv_frame(issues).withColumn("label", project_label(F.col("project")))
        .write.mode("overwrite").partitionBy("label", "project")
        .option("header", True).option("quote", '"').option("escape", '"').csv(f"{out}/issues_csv"))
    if provenance is not None:
        spark = issues.sparkSession
        spark.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "value string") \
             .write.mode("overwrite").text(f"{out}/_provenance")


def read_issues_csv(spark, out: str) -> DataFrame:
    schema = ("severity string, rule_id string, cwe string, file string, line long, title string, "
              "remediation_minutes long, label string, project string")
    back = (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
                 .csv(f"{out}/issues_csv"))
    return back.withColumn("cwe", F.coalesce("cwe", F.lit("")))  # an empty field reads as null


def metrics_rows(report: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """(project, metric, labels, value): files, code lines, issues, debt
    minutes, tqi and the six factor gauges."""
    scalars = [("files_total", "file_count"), ("code_lines_total", "code_lines"), ("issues_total", "issue_count"),
               ("debt_minutes", "debt_minutes"), ("tqi", "tqi")]
    cols = [F.struct(F.lit(f"{prefix}_{m}").alias("metric"), F.lit("").alias("labels"),
                     F.col(c).cast("double").alias("value")) for m, c in scalars]
    cols += [F.struct(F.lit(f"{prefix}_health").alias("metric"), F.lit(f'factor="{f}"').alias("labels"),
                      F.col(f).cast("double").alias("value")) for f in fixed.FACTORS]
    return (report.select("project", F.explode(F.array(*cols)).alias("m"))
                  .select("project", "m.metric", "m.labels", "m.value"))


def metrics_text(report: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """Exposition lines `name{project="p",labels} value`."""
    rows = metrics_rows(report, prefix)
    lab = F.when(F.col("labels") == "", F.format_string('project="%s"', "project")) \
           .otherwise(F.format_string('project="%s",%s', "project", "labels"))
    return rows.select("project", F.format_string("%s{%s} %s", "metric", lab,
                                                  F.col("value").cast("string")).alias("value"))


def export_metrics_text(report: DataFrame, out: str, prefix: str = METRIC_PREFIX) -> None:
    metrics_text(report, prefix).select("value").write.mode("overwrite").text(out)
