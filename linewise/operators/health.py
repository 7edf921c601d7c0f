"""Project rollups: severity counts, factor weights, six health scores + TQI,
grade, technical debt and the quality gate.

Every input is first reduced to one row per project by a hash aggregate
(partial aggregation map-side), then the per-project rows are joined and
scored in a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise import fixed
from linewise.config import GateConfig, ScoreConfig
from linewise.functions.text import clamp, grade


def severity_weight(sev: Column, cfg: ScoreConfig) -> Column:
    return (F.when(sev == "critical", F.lit(cfg.w_critical)).when(sev == "major", F.lit(cfg.w_major))
            .when(sev == "minor", F.lit(cfg.w_minor)).otherwise(F.lit(cfg.w_info)))


def issue_rollup(issues: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Per project: issue count, remediation minutes, count per severity
    (zero-filled) and severity weight per factor (pivot over the six factors)."""
    w = severity_weight(F.col("severity"), cfg)
    aggs = [F.count("*").alias("issue_count"),
            F.sum("remediation_minutes").cast("long").alias("debt_minutes")]
    aggs += [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in fixed.SEVERITIES]
    aggs += [F.sum(F.when(F.col("factor") == f, w).otherwise(F.lit(0.0))).alias(f"w_{f}") for f in fixed.FACTORS]
    return issues.groupBy("project").agg(*aggs)


def _density(weighted: Column, kloc: Column, scale: float, cfg: ScoreConfig) -> Column:
    return F.when(kloc <= 0, F.lit(0.0)).otherwise(F.least(F.lit(cfg.density_cap), weighted / kloc * F.lit(scale)))


def language_excess(metrics: DataFrame, thresholds: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """(project, complexity_over): by how much the functions of a project exceed
    their language's complexity threshold, on average over its functions.

    thresholds: (language, complexity_threshold); other languages have the
    global threshold.  A language below its threshold makes up for none above."""
    each = metrics.groupBy("project", "language").agg(F.sum("functions").alias("n"), F.sum("cyclomatic").alias("c"))
    limits = thresholds.select("language", F.col("complexity_threshold").cast("double").alias("_limit"))
    each = each.join(limits, "language", "left")
    limit = F.coalesce("_limit", F.lit(cfg.complexity_threshold))
    over = F.greatest(F.lit(0.0), F.col("c") / F.greatest("n", F.lit(1)) - limit)
    return each.groupBy("project").agg((F.sum(F.col("n") * over) / F.greatest(F.sum("n"), F.lit(1))).alias("complexity_over"))


def score(report: DataFrame, cfg: ScoreConfig = ScoreConfig(), excess: DataFrame | None = None) -> DataFrame:
    """report needs code_lines, comment_ratio, avg_complexity,
    duplicate_blocks and w_<factor> columns; adds the six scores, tqi, grade.
    `excess` (see language_excess) takes the place of the project's average
    over the global threshold when given (off by default)."""
    kloc = F.col("code_lines") / 1000.0
    s = {f: F.lit(100.0) - _density(F.col(f"w_{f}"), kloc, cfg.scale[f], cfg) for f in fixed.FACTORS}
    over = F.col("avg_complexity") - F.lit(cfg.complexity_threshold)
    if excess is not None:
        report = report.join(excess, "project", "left")
        over = F.coalesce("complexity_over", F.lit(0.0))
    cx = over > 0
    s["robustness"] = s["robustness"] - F.when(cx, F.least(F.lit(cfg.complexity_rob_cap), over * cfg.complexity_rob_mult)).otherwise(0.0)
    s["changeability"] = s["changeability"] - F.when(cx, F.least(F.lit(cfg.complexity_chg_cap), over * cfg.complexity_chg_mult)).otherwise(0.0)
    low = F.col("comment_ratio") < cfg.comment_min
    gap = (F.lit(cfg.comment_min) - F.col("comment_ratio")) * 100.0
    s["transferability"] = s["transferability"] - F.when(low, F.least(F.lit(cfg.comment_transfer_cap), gap * cfg.comment_transfer_mult)).otherwise(0.0)
    s["changeability"] = s["changeability"] - F.when(low, F.least(F.lit(cfg.comment_change_cap), gap * cfg.comment_change_mult)).otherwise(0.0)
    has_dup = (F.col("duplicate_blocks") > 0) & (F.col("code_lines") > 0)
    d = F.col("duplicate_blocks") / F.col("code_lines") * 1000.0
    s["changeability"] = s["changeability"] - F.when(has_dup, F.least(F.lit(cfg.dup_change_cap), d * cfg.dup_change_mult)).otherwise(0.0)
    s["transferability"] = s["transferability"] - F.when(has_dup, F.least(F.lit(cfg.dup_transfer_cap), d * cfg.dup_transfer_mult)).otherwise(0.0)
    out = report
    for f in fixed.FACTORS:
        out = out.withColumn(f, clamp(s[f]))
    tqi = sum((F.col(f) for f in ["robustness", "security", "efficiency", "transferability",
                                 "changeability", "portability"]), F.lit(0.0)) / 6.0
    return out.withColumn("tqi", tqi).withColumn("grade", grade(F.col("tqi"), cfg))


def debt(report: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    dev = F.col("code_lines") * cfg.dev_minutes_per_line
    return (report.withColumn("debt_hours", F.col("debt_minutes") / 60.0)
                  .withColumn("debt_cost", F.col("debt_minutes") / 60.0 * cfg.hourly_rate)
                  .withColumn("debt_ratio", F.when(dev > 0, F.col("debt_minutes") / dev).otherwise(F.lit(0.0))))


def project_report(totals: DataFrame, issues_roll: DataFrame, dups: DataFrame,
                   cfg: ScoreConfig = ScoreConfig(), excess: DataFrame | None = None) -> DataFrame:
    """One row per project: totals, issue rollup, duplicates, scores, debt."""
    rep = totals.join(issues_roll, "project", "left").join(dups, "project", "left")
    fill = {"issue_count": 0, "debt_minutes": 0, "duplicate_blocks": 0, "distinct_blocks": 0}
    fill.update({f"n_{s}": 0 for s in fixed.SEVERITIES})
    fill.update({f"w_{f}": 0.0 for f in fixed.FACTORS})
    rep = rep.fillna(fill)
    return debt(score(rep, cfg, excess), cfg)


def quality_gate(report: DataFrame, gate: GateConfig = GateConfig(), new_critical: DataFrame | None = None) -> DataFrame:
    """(project, passed, reason, tqi, issues, critical).  All failing checks
    are evaluated; the reason reported is the last failing one.

    new_critical: critical issues that the scan before did not have
    (issues.new_critical_issues); with gate.max_new_critical >= 0 more of them
    than that fail a project."""
    if new_critical is not None:
        report = report.join(new_critical.groupBy("project").agg(F.count("*").alias("_new")), "project", "left")
    tqi, issues, crit = F.col("tqi"), F.col("issue_count"), F.col("n_critical")
    f_tqi = (F.lit(gate.min_tqi > 0.0) & (tqi < gate.min_tqi))
    f_iss = (F.lit(gate.max_issues >= 0) & (issues > gate.max_issues))
    f_crit = (F.lit(gate.max_critical >= 0) & (crit > gate.max_critical))
    fresh = F.coalesce("_new", F.lit(0)) if new_critical is not None else F.lit(0)
    f_new = F.lit(gate.max_new_critical >= 0) & (fresh > gate.max_new_critical)
    reason = (F.when(f_new, F.concat(F.lit("New critical issues: "), fresh.cast("string")))
              .when(f_crit, F.concat(F.lit("Critical issues: "), crit.cast("string")))
              .when(f_iss, F.format_string("Issues %d > %d", issues, F.lit(gate.max_issues)))
              .when(f_tqi, F.format_string("TQI %f < %f", tqi, F.lit(float(gate.min_tqi))))
              .otherwise(F.lit("")))
    passed = ~(f_tqi | f_iss | f_crit | f_new)
    if not gate.enabled:
        passed, reason = F.lit(True), F.lit("")
    return report.select("project", passed.alias("passed"), reason.alias("reason"), tqi.alias("tqi"),
                         issues.alias("issues"), crit.alias("critical"))
