"""Licence headers: SPDX identifier and copyright notice in the first 20 lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise import fixed
from linewise.functions.text import header_of
from linewise.operators.lines import lines_array


def file_licenses(files: DataFrame) -> DataFrame:
    """files -> licenses(project, path, spdx, has_copyright, has_header).
    A projection over the first LICENSE_SCAN_LINES lines of each file."""
    head = F.slice(lines_array(F.col("content")), 1, fixed.LICENSE_SCAN_LINES)
    spdx, cr = header_of(F.col("content"), head)
    df = files.select("project", "path", spdx.alias("spdx"), cr.alias("has_copyright"))
    return df.withColumn("has_header", F.col("spdx").isNotNull() | F.col("has_copyright"))


def license_summary(licenses: DataFrame) -> DataFrame:
    """Per project: files with / without a header and coverage percent."""
    agg = licenses.groupBy("project").agg(
        F.count_if("has_header").alias("files_with_header"),
        F.count_if(~F.col("has_header")).alias("files_without_header"),
        F.count("*").alias("files"))
    return agg.withColumn("coverage_pct",
                          F.when(F.col("files") > 0,
                                 F.round(100.0 * F.col("files_with_header") / F.col("files")))
                           .otherwise(F.lit(0.0)))


def spdx_counts(licenses: DataFrame) -> DataFrame:
    return (licenses.filter(F.col("spdx").isNotNull())
                    .groupBy("project", "spdx").agg(F.count("*").alias("files")))
