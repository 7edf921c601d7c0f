"""Per-file metrics and project totals.

`file_metrics` is a single projection over the files frame (regexp_count
over whole content, a fold over the line array): no exchange.  Project
totals are one hash aggregate with partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.config import ScanConfig
from linewise.functions.lang import comment_style, decision_points, function_count_raw, max_nesting
from linewise.operators.deps import dependencies_of
from linewise.operators.lines import breakdown_fold, lines_array, phantom_line

METRIC_COLUMNS = ["total_lines", "code_lines", "comment_lines", "blank_lines", "functions",
                  "cyclomatic", "max_nesting", "long_lines"]


def file_metrics(files: DataFrame, cfg: ScanConfig = ScanConfig(), with_deps: bool = True) -> DataFrame:
    """files -> metrics(project, path, language, mtime, total_lines, code_lines,
    comment_lines, blank_lines, functions, cyclomatic, max_nesting,
    long_lines[, dependencies])."""
    content = F.col("content")
    lang = F.col("language")
    df = files.select("project", "path", "language", "mtime", "content",
                      lines_array(content).alias("_lines"), comment_style(lang).alias("_style"))
    df = df.withColumn("_bd", breakdown_fold(F.col("_lines"), lang, F.col("_style"), cfg.long_line_columns))
    ph = phantom_line(content)
    fn_raw = function_count_raw(content, lang)
    code = F.col("_bd.code")
    cols = [
        "project", "path", "language", "mtime",
        (F.size("_lines").cast("long") + ph).alias("total_lines"),
        code.alias("code_lines"),
        F.col("_bd.cmt").alias("comment_lines"),
        (F.col("_bd.blank") + ph).alias("blank_lines"),
        F.when((fn_raw == 0) & (code > 0), F.lit(1).cast("long")).otherwise(fn_raw).alias("functions"),
        (decision_points(content, lang) + 1).alias("cyclomatic"),
        max_nesting(content, F.col("_lines"), lang).alias("max_nesting"),
        F.col("_bd.lng").alias("long_lines"),
    ]
    if with_deps:
        cols.append(dependencies_of(F.col("_lines")).alias("dependencies"))
    return df.select(*cols)


def project_totals(metrics: DataFrame) -> DataFrame:
    """Sums per project, max cyclomatic, file count, comment ratio and
    average complexity (ratio of sums)."""
    agg = metrics.groupBy("project").agg(
        F.count("*").alias("file_count"),
        F.sum("total_lines").cast("long").alias("total_lines"),
        F.sum("code_lines").cast("long").alias("code_lines"),
        F.sum("comment_lines").cast("long").alias("comment_lines"),
        F.sum("blank_lines").cast("long").alias("blank_lines"),
        F.sum("functions").cast("long").alias("total_functions"),
        F.sum("cyclomatic").cast("long").alias("total_cyclomatic"),
        F.max("cyclomatic").cast("long").alias("max_complexity"),
    )
    return agg.select(
        "*",
        F.when(F.col("total_lines") > 0, F.col("comment_lines") / F.col("total_lines"))
         .otherwise(F.lit(0.0)).alias("comment_ratio"),
        F.when(F.col("file_count") > 0,
               F.col("total_cyclomatic") / F.greatest(F.col("total_functions"), F.lit(1)))
         .otherwise(F.lit(0.0)).alias("avg_complexity"),
    )


def top_complex_files(metrics: DataFrame, n: int = 10) -> DataFrame:
    """Top-n files by cyclomatic per project (ties by path); a per-project
    row_number limit, which Spark plans as a partial WindowGroupLimit before
    the exchange."""
    from pyspark.sql import Window
    w = Window.partitionBy("project").orderBy(F.desc("cyclomatic"), F.asc("path"))
    return (metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))


def sorted_files(metrics: DataFrame, key: str, ascending: bool = True, n: int = 500) -> DataFrame:
    """Files of each project sorted by any metric column, capped at n rows
    per project (the table-view cap), ties by path."""
    from pyspark.sql import Window
    order = F.asc(key) if ascending else F.desc(key)
    w = Window.partitionBy("project").orderBy(order, F.asc("path"))
    return metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
