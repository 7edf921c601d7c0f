"""Registered queries: one per operator of the inventory, each
(spark, sf_dir) -> DataFrame over the driver tables.

Outputs are flat (strings, longs, doubles rounded to 6 places, booleans) so
they compare exactly with the DuckDB oracle in linewise.plans.oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.config import GateConfig, ScanConfig, ScoreConfig
from linewise.functions import text as T
from linewise.functions.lang import decision_points
from linewise.operators import deps, duplicates, health, licenses, lines, metrics, rules
from linewise.operators.numbering import numbered
from linewise.plans.analyze import Analysis
from linewise.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


def _files(spark, sf):
    return corpus.corpus_files(spark, sf)


def _analysis(spark, sf, materialize: bool = True) -> Analysis:
    """Scan plan over the corpus; by default every rollup reads the corpus's
    shared facts table, which the first query writes."""
    return Analysis(_files(spark, sf), corpus=f"driver tables {sf}" if materialize else None)


# ----------------------------------------------------------------- step 1
@query("documents_as_files")
def q_documents_as_files(spark, sf):
    f = corpus.documents_as_files(spark, sf)
    return f.select("project", "path", "ext", "language", "content", "size", T.iso_ts(F.col("mtime")).alias("mtime"))


@query("pages_as_files")
def q_pages_as_files(spark, sf):
    return corpus.pages_as_files(spark, sf).select("project", "path", "ext", "language", "size")


@query("detect_language")
def q_detect_language(spark, sf):
    f = corpus.finish_files(corpus.documents_with_strays(spark, sf)).unionByName(corpus.pages_as_files(spark, sf))
    return f.groupBy("project", "language").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


@query("scan_exclude")
def q_scan_exclude(spark, sf):
    return corpus.scan_exclude(corpus.documents_with_strays(spark, sf)).select("project", "path")


@query("multi_project_sources")
def q_multi_project_sources(spark, sf):
    f = corpus.documents_as_files(spark, sf).unionByName(corpus.pages_as_files(spark, sf)) \
              .unionByName(corpus.conversations_as_files(spark, sf))
    return f.groupBy("project").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


@query("explode_lines")
def q_explode_lines(spark, sf):
    return lines.explode_lines(_files(spark, sf)).select("project", "path", "n", "text")


@query("source_order")
def q_source_order(spark, sf):
    return numbered(_files(spark, sf).select("project", "path"), [F.col("path").asc()], "ord", ["project"])


# ----------------------------------------------------------------- step 2
@query("line_class")
def q_line_class(spark, sf):
    return lines.file_line_class(_files(spark, sf))


@query("block_comment_state")
def q_block_comment_state(spark, sf):
    lc = lines.file_line_class(_files(spark, sf))
    return lc.groupBy("project", "language").agg(
        F.count_if(F.col("kind") == "comment").alias("comment_lines"),
        F.count_if(F.col("kind") == "code").alias("code_lines"),
        F.count_if(F.col("kind") == "blank").alias("blank_lines"))


@query("comment_line")
def q_comment_line(spark, sf):
    from linewise.functions.lang import comment_style, line_comment
    ln = lines.explode_lines(_files(spark, sf))
    tr = T.ltrim_ws(F.col("text"))
    pred = (tr != "") & line_comment(comment_style(F.col("language")), F.col("language"), F.col("text"), tr)
    return ln.filter(pred).select("project", "path", "n")


@query("is_blank")
def q_is_blank(spark, sf):
    ln = lines.explode_lines(_files(spark, sf))
    return ln.filter(T.is_blank(F.col("text"))).groupBy("project").agg(F.count("*").alias("blank_lines"))


@query("is_long_line")
def q_is_long_line(spark, sf):
    ln = lines.explode_lines(_files(spark, sf))
    return (ln.filter(lines.is_long_line(F.col("text")))
              .select("project", "path", "n", F.octet_length("text").cast("long").alias("bytes")))


@query("file_line_breakdown")
def q_file_line_breakdown(spark, sf):
    return lines.file_line_breakdown(_files(spark, sf))


@query("lines_by_language")
def q_lines_by_language(spark, sf):
    return lines.lines_by_language(lines.file_line_breakdown(_files(spark, sf)))


@query("comment_ratio")
def q_comment_ratio(spark, sf):
    bd = lines.file_line_breakdown(_files(spark, sf))
    t = bd.groupBy("project").agg(F.sum("comment_lines").alias("c"), F.sum("total_lines").alias("t"))
    return t.select("project", _r6(lines.comment_ratio(F.col("c"), F.col("t"))).alias("comment_ratio"))


# ----------------------------------------------------------------- step 3
@query("count_keyword")
def q_count_keyword(spark, sf):
    f = _files(spark, sf)
    return f.select("project", "path", *[T.count_keywords(F.col("content"), [k]).alias(f"kw_{k}")
                                         for k in ["if", "for", "while", "case", "catch"]])


@query("count_substr")
def q_count_substr(spark, sf):
    f = _files(spark, sf)
    return f.select("project", "path", T.count_substr(F.col("content"), "&&").alias("and_ops"),
                    T.count_substr(F.col("content"), "||").alias("or_ops"))


@query("cyclomatic")
def q_cyclomatic(spark, sf):
    f = _files(spark, sf)
    return f.select("project", "path", (decision_points(F.col("content"), F.col("language")) + 1).alias("cyclomatic"))


@query("functions")
def q_functions(spark, sf):
    return metrics.file_metrics(_files(spark, sf), with_deps=False).select("project", "path", "functions")


@query("nesting_braces")
def q_nesting_braces(spark, sf):
    m = metrics.file_metrics(_files(spark, sf), with_deps=False)
    return m.filter(F.col("language") != "Python").select("project", "path", "max_nesting")


@query("nesting_indent")
def q_nesting_indent(spark, sf):
    m = metrics.file_metrics(_files(spark, sf), with_deps=False)
    return m.filter(F.col("language") == "Python").select("project", "path", "max_nesting")


@query("file_metrics")
def q_file_metrics(spark, sf):
    m = metrics.file_metrics(_files(spark, sf), with_deps=False)
    return m.select("project", "path", "language", *metrics.METRIC_COLUMNS)


@query("project_totals")
def q_project_totals(spark, sf):
    t = metrics.project_totals(metrics.file_metrics(_files(spark, sf), with_deps=False))
    return t.select("project", "file_count", "total_lines", "code_lines", "comment_lines", "blank_lines",
                    "total_functions", "total_cyclomatic", "max_complexity")


@query("avg_complexity")
def q_avg_complexity(spark, sf):
    t = metrics.project_totals(metrics.file_metrics(_files(spark, sf), with_deps=False))
    return t.select("project", _r6(F.col("avg_complexity")).alias("avg_complexity"))


# ----------------------------------------------------------------- step 4
def _issue_cols(df):
    return df.select("project", "path", F.col("line").cast("int").alias("line"), "rule_id", "title", "cwe",
                     "severity", "factor", F.col("remediation_minutes").cast("int").alias("remediation_minutes"),
                     "snippet", "key")


@query("apply_rules")
def q_apply_rules(spark, sf):
    return _issue_cols(rules.apply_rules(lines.explode_lines(_files(spark, sf))))


@query("join_rules")
def q_join_rules(spark, sf):
    a = _analysis(spark, sf, materialize=False)
    rs = rules.select_rules()
    from linewise.functions.text import java_regex
    rdf = rules.rules_frame(spark, [rules.Rule(r.ord, r.id, r.title, r.cwe, r.severity, r.factor, r.minutes, r.enabled,
                                               java_regex(r.pattern)) for r in rs])
    return _issue_cols(rules.join_rules(a.lines, rdf))


RULE_LINE_LIMIT = 2000  # the optional limit of this query; by default rules see every line


@query("rule_line_guard")
def q_rule_line_guard(spark, sf):
    ln = lines.explode_lines(_files(spark, sf))
    return (ln.filter(F.octet_length("text") > RULE_LINE_LIMIT)
              .groupBy("project").agg(F.count("*").alias("skipped_lines")))


@query("rule_enabled")
def q_rule_enabled(spark, sf):
    iss = _analysis(spark, sf).candidate_issues.groupBy("rule_id").agg(F.count("*").alias("hits"))
    cat = rules.rules_frame(spark).select("rule_id", "enabled")
    return cat.join(iss, "rule_id", "left").select("rule_id", "enabled", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query("guard_regions")
def q_guard_regions(spark, sf):
    return rules.file_regions(_files(spark, sf))


@query("suppress_guard")
def q_suppress_guard(spark, sf):
    a = _analysis(spark, sf)
    return a.candidate_issues.filter("silenced").select("project", "path", F.col("line").cast("int").alias("line"), "rule_id")


@query("join_guard_regions")
def q_join_guard_regions(spark, sf):
    a = _analysis(spark, sf)
    return a.issues.groupBy("project", "rule_id").agg(F.count("*").alias("issues"))


@query("snippet")
def q_snippet(spark, sf):
    return _analysis(spark, sf).issues.select("key", "snippet")


@query("file_issue_count")
def q_file_issue_count(spark, sf):
    return _analysis(spark, sf).file_records.select("project", "path", "issues")


# ----------------------------------------------------------------- step 5
@query("normalize_line")
def q_normalize_line(spark, sf):
    ln = lines.explode_lines(_files(spark, sf))
    return ln.select("project", "path", "n", T.normalize_line(F.col("text")).alias("norm"))


@query("duplicate_window")
def q_duplicate_window(spark, sf):
    b = duplicates.blocks(_files(spark, sf))
    return duplicates.duplicate_locations(b).select("project", "path", "line", "occurrences")


@query("duplicate_blocks")
def q_duplicate_blocks(spark, sf):
    return duplicates.duplicate_blocks(duplicates.blocks(_files(spark, sf)))


@query("block_hash")
def q_block_hash(spark, sf):
    b = duplicates.blocks(_files(spark, sf))
    return duplicates.block_counts(b).groupBy("project", "occurrences").agg(F.count("*").alias("blocks"))


@query("duplicate_groups")
def q_duplicate_groups(spark, sf):
    return duplicates.duplicate_groups(_analysis(spark, sf).blocks)


# ----------------------------------------------------------------- step 6
@query("extract_dependency")
def q_extract_dependency(spark, sf):
    return deps.extract_dependencies(lines.explode_lines(_files(spark, sf)))


@query("distinct_dependencies")
def q_distinct_dependencies(spark, sf):
    m = metrics.file_metrics(_files(spark, sf))
    return m.filter(F.size("dependencies") > 0).select("project", "path", F.array_join("dependencies", ",").alias("dependencies"))


@query("technology_fold")
def q_technology_fold(spark, sf):
    m = metrics.file_metrics(_files(spark, sf))
    t = m.select("project", "path", deps.technology_fold(F.col("dependencies")).alias("t")).filter(F.size("t") > 0)
    return t.select("project", "path", F.array_join(F.transform("t", lambda s: s["name"]), ",").alias("technologies"))


@query("technology_inventory")
def q_technology_inventory(spark, sf):
    return deps.technology_inventory(metrics.file_metrics(_files(spark, sf)))


@query("technology_by_category")
def q_technology_by_category(spark, sf):
    return deps.technology_by_category(deps.technology_inventory(metrics.file_metrics(_files(spark, sf))))


@query("spdx_of_line")
def q_spdx_of_line(spark, sf):
    ln = lines.explode_lines(_files(spark, sf))
    s = T.spdx_of_line(F.col("text"))
    return ln.filter(s != "").select("project", "path", "n", s.alias("spdx"))


@query("has_copyright")
def q_has_copyright(spark, sf):
    lic = licenses.file_licenses(_files(spark, sf))
    return lic.filter("has_copyright").select("project", "path")


@query("license_first_spdx")
def q_license_first_spdx(spark, sf):
    lic = licenses.file_licenses(_files(spark, sf))
    return lic.filter(F.col("spdx").isNotNull()).select("project", "path", "spdx")


@query("license_summary")
def q_license_summary(spark, sf):
    s = licenses.license_summary(licenses.file_licenses(_files(spark, sf)))
    return s.select("project", "files_with_header", "files_without_header")


@query("license_spdx_counts")
def q_license_spdx_counts(spark, sf):
    return licenses.spdx_counts(licenses.file_licenses(_files(spark, sf)))


@query("license_coverage")
def q_license_coverage(spark, sf):
    s = licenses.license_summary(licenses.file_licenses(_files(spark, sf)))
    return s.select("project", _r6(F.col("coverage_pct")).alias("coverage_pct"))


# ----------------------------------------------------------------- step 7
@query("severity_counts")
def q_severity_counts(spark, sf):
    rep = _analysis(spark, sf).report
    return rep.unpivot("project", [f"n_critical", "n_major", "n_minor", "n_info"], "sev", "count") \
              .select("project", F.regexp_replace("sev", "^n_", "").alias("severity"), F.col("count").cast("long"))


@query("factor_weights")
def q_factor_weights(spark, sf):
    rep = _analysis(spark, sf).report
    from linewise import fixed
    return rep.select("project", *[_r6(F.col(f"w_{f}")).alias(f"w_{f}") for f in fixed.FACTORS])


@query("health_scores")
def q_health_scores(spark, sf):
    rep = _analysis(spark, sf).report
    from linewise import fixed
    return rep.select("project", *[_r6(F.col(f)).alias(f) for f in fixed.FACTORS], _r6(F.col("tqi")).alias("tqi"))


@query("grade")
def q_grade(spark, sf):
    return _analysis(spark, sf).report.select("project", "grade")


@query("debt_summary")
def q_debt_summary(spark, sf):
    rep = _analysis(spark, sf).report
    return rep.select("project", F.col("debt_minutes").alias("total_minutes"), _r6(F.col("debt_hours")).alias("total_hours"),
                      _r6(F.col("debt_cost")).alias("cost"), _r6(F.col("debt_ratio")).alias("debt_ratio"))


@query("quality_gate")
def q_quality_gate(spark, sf):
    g = health.quality_gate(_analysis(spark, sf).report, GateConfig())
    return g.select("project", "passed", "reason", _r6(F.col("tqi")).alias("tqi"), "issues", "critical")


@query("projects_overview")
def q_projects_overview(spark, sf):
    return _analysis(spark, sf).projects_overview()


#: Thresholds of the registered query; other languages have the global one.
LANGUAGE_THRESHOLDS = {"JavaScript": 3.0, "Python": 2.5, "C++": 4.0, "Java": 30.0}


@query("join_complexity_threshold")
def q_join_complexity_threshold(spark, sf):
    cfg = ScoreConfig(language_thresholds=LANGUAGE_THRESHOLDS, use_language_thresholds=True)
    a = Analysis(_files(spark, sf), score_cfg=cfg, corpus=f"driver tables {sf}")
    return a.report.select("project", _r6(F.col("robustness")).alias("robustness"),
                           _r6(F.col("changeability")).alias("changeability"), _r6(F.col("tqi")).alias("tqi"))


def registered() -> dict[str, Query]:
    from linewise.plans import catalog_more  # noqa: F401  (registers steps 8-10)
    return dict(REGISTRY)
