"""The scan plan: files -> lines -> {metrics, issues, blocks, licences,
technologies} -> per-project report.

Everything is lazy; each frame is built on first use.  Shuffle boundaries:
  * metrics, licences, blocks, issues with guard suppression, previews: none
    (per-file projections and Generate over the file row);
  * duplicate counting: by (project, block hash), partial aggregation first;
  * rollups: by project, partial aggregation first.
`lines` is not cached: re-deriving it from the files scan is cheaper than
materialising one row per line of the corpus.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.config import ScanConfig, ScoreConfig
from linewise.functions.text import issue_key
from linewise.operators import deps, duplicates, health, issues, licenses, lines, metrics


class Analysis:
    def __init__(self, files: DataFrame, cfg: ScanConfig = ScanConfig(), score_cfg: ScoreConfig = ScoreConfig(),
                 thresholds: DataFrame | None = None, materialize: bool = False, corpus: str | None = None):
        """materialize=True: one pass over the corpus writes a per-file facts
        table (plans/facts.py) under spark.checkpoint.dir; metrics, issues,
        blocks and licences are then read from it.  With a corpus name that table
        is shared: written once per state of the input files and merged when
        they change (plans/store.py)."""
        self.files = files
        self.cfg = cfg
        self.score_cfg = score_cfg
        self.thresholds = thresholds
        self.materialized = materialize or corpus is not None
        self.corpus = corpus

    @cached_property
    def facts(self) -> DataFrame:
        from linewise.plans.facts import file_facts, materialize
        from linewise.plans.store import shared_facts
        if self.corpus is not None:
            return shared_facts(self.files, self.corpus, self.cfg)
        return materialize(file_facts(self.files, self.cfg))

    @cached_property
    def lines(self) -> DataFrame:
        return lines.explode_lines(self.files)

    @cached_property
    def metrics(self) -> DataFrame:
        if self.materialized:
            return self.facts.select("project", "path", "language", "mtime", *metrics.METRIC_COLUMNS, "dependencies")
        return metrics.file_metrics(self.files, self.cfg)

    @cached_property
    def file_issues(self) -> DataFrame:
        """(project, path, issues) per file; each issue says whether guards silence it."""
        if self.materialized:
            return self.facts.select("project", "path", "issues")
        from linewise.plans.facts import file_issues
        return file_issues(self.files, self.cfg)

    @cached_property
    def candidate_issues(self) -> DataFrame:
        i = self.file_issues.select("project", "path", F.explode("issues").alias("i")).select("project", "path", "i.*")
        return i.withColumn("key", issue_key(F.col("project"), F.col("rule_id"), F.col("path"), F.col("line")))

    @cached_property
    def issues(self) -> DataFrame:
        return self.candidate_issues.filter("not silenced").drop("silenced")

    @cached_property
    def file_records(self) -> DataFrame:
        """metrics + issue count per file."""
        many = F.expr("cast(size(filter(issues, i -> not i.silenced)) as long)").alias("issues")
        if self.materialized:
            return self.facts.select("project", "path", "language", "mtime", *metrics.METRIC_COLUMNS, "dependencies", many)
        return self.metrics.join(self.file_issues.select("project", "path", many), ["project", "path"])

    @cached_property
    def previews(self) -> DataFrame:
        """The source around each issue, cut out of its file's row: one scan, no exchange."""
        from linewise.plans.facts import file_issues
        return issues.file_previews(file_issues(self.files, self.cfg, lines=True))

    @cached_property
    def blocks(self) -> DataFrame:
        if self.materialized:
            return (self.facts.select("project", "path", F.explode("blocks").alias("b"))
                              .select("project", "path", "b.line", "b.h1", "b.h2"))
        return duplicates.blocks(self.files, self.cfg)

    @cached_property
    def duplicate_counts(self) -> DataFrame:
        return duplicates.duplicate_blocks(self.blocks)

    @cached_property
    def totals(self) -> DataFrame:
        return metrics.project_totals(self.metrics)

    @cached_property
    def complexity_excess(self) -> DataFrame | None:
        """By language, where thresholds are given or switched on; else the global threshold holds."""
        limits = self.thresholds
        if limits is None and self.score_cfg.use_language_thresholds:
            rows = sorted(self.score_cfg.language_thresholds.items())
            limits = self.files.sparkSession.createDataFrame(rows, "language string, complexity_threshold double")
        return None if limits is None else health.language_excess(self.metrics, limits, self.score_cfg)

    @cached_property
    def report(self) -> DataFrame:
        return health.project_report(self.totals, health.issue_rollup(self.issues, self.score_cfg),
                                     self.duplicate_counts, self.score_cfg, self.complexity_excess)

    @cached_property
    def licenses(self) -> DataFrame:
        if self.materialized:
            return self.facts.select("project", "path", "spdx", "has_copyright", "has_header")
        return licenses.file_licenses(self.files)

    @cached_property
    def technologies(self) -> DataFrame:
        return deps.technology_inventory(self.metrics)

    def projects_overview(self) -> DataFrame:
        return self.report.select("project", "grade", F.round("tqi", 6).alias("tqi"),
                                  F.col("issue_count").alias("issues"))


def analyze(files: DataFrame, cfg: ScanConfig = ScanConfig(), score_cfg: ScoreConfig = ScoreConfig()) -> Analysis:
    return Analysis(files, cfg, score_cfg)
