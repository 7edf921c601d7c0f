"""One pass over the corpus: per-file facts.

`file_facts` evaluates, in a single projection of each file row, everything
the rollups need: line breakdown, complexity, functions, nesting,
dependencies, licence header, issues (with what platform guards say of them)
and duplicate-block hashes.  Written once (parquet under spark.checkpoint.dir),
it replaces four scans of the raw corpus by one, and cuts the lineage: a lost
executor recomputes from the facts table, not from the raw text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise import fixed
from linewise.config import ScanConfig
from linewise.functions.lang import comment_style, decision_points, function_count_raw, max_nesting
from linewise.functions.text import header_of, snippet
from linewise.operators.deps import dependencies_of
from linewise.operators.duplicates import block_array, normalized_lines
from linewise.operators.guards import directives, silenced_issues
from linewise.operators.lines import breakdown_fold, lines_array, phantom_line
from linewise.operators.rules import line_hits, select_rules
from linewise.session import shared_path

ISSUE_TYPE = ("array<struct<line:int,rule_ord:int,rule_id:string,title:string,cwe:string,severity:string,"
              "factor:string,remediation_minutes:int,snippet:string,line_hash:bigint>>")


def _line_issues(lines, cfg: ScanConfig):
    rs = select_rules(cfg)

    def per_line(x, i):
        hits = line_hits(rs, x, cfg)
        rows = F.transform(hits, lambda h: F.struct((i + 1).alias("line"), h["rule_ord"].alias("rule_ord"),
                                                    h["rule_id"].alias("rule_id"), h["title"].alias("title"),
                                                    h["cwe"].alias("cwe"), h["severity"].alias("severity"),
                                                    h["factor"].alias("factor"),
                                                    h["remediation_minutes"].alias("remediation_minutes"),
                                                    snippet(x).alias("snippet"),
                                                    F.xxhash64(x).alias("line_hash")))
        cut = cfg.max_rule_line_length
        return F.when(F.octet_length(x) <= cut, rows).otherwise(F.array().cast(ISSUE_TYPE)) if cut else rows

    return F.flatten(F.transform(lines, per_line))


def file_facts(files: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    content, lang = F.col("content"), F.col("language")
    base = files.select("project", "path", "language", "mtime", "content", lines_array(content).alias("_lines"),
                        comment_style(lang).alias("_style"))
    base = base.select("*", normalized_lines(F.col("_lines")).alias("_norm"),
                       breakdown_fold(F.col("_lines"), lang, F.col("_style"), cfg.long_line_columns).alias("_bd"))
    head = F.slice(F.col("_lines"), 1, fixed.LICENSE_SCAN_LINES)
    ph = phantom_line(content)
    fn_raw = function_count_raw(content, lang)
    code = F.col("_bd.code")
    spdx, cr = header_of(content, head)
    facts = base.select(
        "project", "path", "language", "mtime", F.xxhash64("content").alias("content_hash"),
        (F.size("_lines").cast("long") + ph).alias("total_lines"),
        code.alias("code_lines"),
        F.col("_bd.cmt").alias("comment_lines"),
        (F.col("_bd.blank") + ph).alias("blank_lines"),
        F.when((fn_raw == 0) & (code > 0), F.lit(1).cast("long")).otherwise(fn_raw).alias("functions"),
        (decision_points(content, lang) + 1).alias("cyclomatic"),
        max_nesting(content, F.col("_lines"), lang).alias("max_nesting"),
        F.col("_bd.lng").alias("long_lines"),
        dependencies_of(F.col("_lines")).alias("dependencies"),
        spdx.alias("spdx"), cr.alias("has_copyright"), (spdx.isNotNull() | cr).alias("has_header"),
        block_array(F.col("_norm"), max(1, cfg.duplication_block_lines)).alias("blocks"),
        _line_issues(F.col("_lines"), cfg).alias("issues"),
        directives(F.col("_lines")).alias("_directives"),
    )
    return silenced_issues(facts, "issues", "_directives").drop("_directives")


def file_issues(files: DataFrame, cfg: ScanConfig = ScanConfig(), lines: bool = False) -> DataFrame:
    """(project, path, issues): the issues of each file in one projection of its row,
    each with `silenced`; with `lines`, also the file's line array."""
    base = files.select("project", "path", lines_array(F.col("content")).alias("lines"))
    d = base.select("project", "path", "lines", _line_issues(F.col("lines"), cfg).alias("issues"), directives(F.col("lines")).alias("_directives"))
    out = silenced_issues(d, "issues", "_directives").drop("_directives")
    return out if lines else out.drop("lines")


def materialize(df: DataFrame, name: str = "facts") -> DataFrame:
    """Write under the shared checkpoint folder and read back (lineage cut)."""
    path = shared_path(df.sparkSession, f"linewise/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
