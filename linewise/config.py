"""Tunables as frozen dataclasses (defaults are the shipped values)."""

from __future__ import annotations

from dataclasses import dataclass, field

from linewise import fixed


@dataclass(frozen=True)
class ScanConfig:
    max_file_bytes: int = 0              # 0: files are never cut; else cut there and flagged `truncated`
    duplication_block_lines: int = 6
    long_line_columns: int = 120
    max_rule_line_length: int = 0        # 0: rules see every line; else longer lines get none
    excludes: tuple[str, ...] = tuple(fixed.DEFAULT_EXCLUDES)
    # Inline suppression marker: a line containing it and a rule id skips that rule.
    suppress_marker: str = "analyzer-suppress"
    case_insensitive_rules: bool = False
    # Rule ids to apply; None = every enabled rule of the catalogue.
    rule_ids: tuple[str, ...] | None = None


@dataclass(frozen=True)
class ScoreConfig:
    w_critical: float = 10.0
    w_major: float = 5.0
    w_minor: float = 2.0
    w_info: float = 1.0
    scale: dict = field(default_factory=lambda: {
        "security": 12.0, "robustness": 10.0, "efficiency": 8.0,
        "transferability": 6.0, "changeability": 6.0, "portability": 8.0})
    density_cap: float = 60.0
    grade_a: float = 90.0
    grade_b: float = 80.0
    grade_c: float = 65.0
    grade_d: float = 50.0
    complexity_threshold: float = 5.0
    complexity_rob_mult: float = 1.5
    complexity_rob_cap: float = 25.0
    complexity_chg_mult: float = 1.2
    complexity_chg_cap: float = 20.0
    comment_min: float = 0.10
    comment_transfer_mult: float = 1.5
    comment_transfer_cap: float = 20.0
    comment_change_mult: float = 1.0
    comment_change_cap: float = 15.0
    dup_change_mult: float = 2.0
    dup_change_cap: float = 20.0
    dup_transfer_mult: float = 1.5
    dup_transfer_cap: float = 15.0
    hourly_rate: float = 75.0
    dev_minutes_per_line: float = 0.5
    # Per-language complexity thresholds: they count only when
    # use_language_thresholds is set (health.language_excess).
    language_thresholds: dict = field(default_factory=dict)
    use_language_thresholds: bool = False

    def weight(self, severity: str) -> float:
        return {"critical": self.w_critical, "major": self.w_major,
                "minor": self.w_minor}.get(severity, self.w_info)


@dataclass(frozen=True)
class GateConfig:
    enabled: bool = True
    min_tqi: float = 80.0          # < 0 disables the check
    max_issues: int = -1           # < 0 disables the check
    max_critical: int = 0          # < 0 disables the check
    max_new_critical: int = -1     # < 0 disables the check


@dataclass(frozen=True)
class UiConfig:
    max_table_rows: int = 500
    pdf_max_issues: int = 40
    history_max: int = 50
    max_report_issues: int = 15
    log_max_entries: int = 1000
    log_default_limit: int = 200
