"""The library from SQL: a table function over file contents, small functions, and views of a scan.

After `register(spark, files)` a scan needs no Python:

    SELECT f.path, l.n, l.text FROM files f, LATERAL source_lines(f.content) l
    SELECT project, severity, count(*) FROM issues GROUP BY ALL
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from linewise import fixed
from linewise.config import ScanConfig, ScoreConfig
from linewise.operators import rules
from linewise.plans.analyze import Analysis


@udtf(returnType="n int, text string")
class SourceLines:
    """The lines of a content, from 1: split at LF, CRs dropped, nothing after a final LF; none of null.

    For contents of any table; a scan's own `lines` view does the same inside the JVM."""

    def eval(self, content: str) -> Iterator[tuple[int, str]]:
        if content is None:
            return
        parts = content.split("\n")
        for i, text in enumerate(parts):
            if text or i < len(parts) - 1:
                yield i + 1, text.replace("\r", "")


def _functions() -> dict[str, str]:
    severities = ", ".join(f"'{s}'" for s in fixed.SEVERITIES)
    factors = ", ".join(f"'{f}'" for f in fixed.FACTORS)
    cfg = ScoreConfig()
    steps = " ".join(f"WHEN tqi >= {at} THEN '{g}'" for g, at in (("A", cfg.grade_a), ("B", cfg.grade_b), ("C", cfg.grade_c), ("D", cfg.grade_d)))
    return {
        "severity_from(s STRING) RETURNS STRING": f"CASE WHEN s IN ({severities}) THEN s ELSE 'info' END",
        "factor_from(s STRING) RETURNS STRING": f"CASE WHEN s IN ({factors}) THEN s ELSE 'robustness' END",
        "clamp_score(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(100D, x))",
        "grade_of(tqi DOUBLE) RETURNS STRING": f"CASE {steps} ELSE 'F' END",
    }


def register(spark: SparkSession, files: DataFrame, cfg: ScanConfig = ScanConfig(), corpus: str | None = None, prefix: str = "") -> list[str]:
    """Registers the functions and temporary views of a scan of `files`; returns the views' names.

    Views are lazy, and with a corpus name they share its facts table.  A
    prefix keeps the views of several scans apart."""
    spark.udtf.register("source_lines", SourceLines)
    for head, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    a = Analysis(files, cfg, corpus=corpus)
    views = {"files": files, "lines": a.lines, "file_metrics": a.metrics, "issues": a.issues, "guard_regions": rules.file_regions(files),
             "licenses": a.licenses, "technologies": a.technologies, "duplicate_counts": a.duplicate_counts, "report": a.report}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + v for v in views]
