"""Oracle SQL for steps 8-10 (see catalog_more)."""

from __future__ import annotations

from linewise import fixed
from linewise.config import ScoreConfig
from linewise.plans.oracle import DEP_CTES, DUP_CTES, METRIC_CTES, REPORT, RULE_CTES, TOTALS, lst, q, r6

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
STAT = lst(fixed.ISSUE_STATUSES)
STATUS_CTES = f"""
sl AS (SELECT project, path, n, CAST(regexp_extract(path, 'doc([0-9]+)\\.', 1) AS BIGINT) AS doc_id FROM lines
       WHERE project <> 'web' AND text = 'password = "hunter2x"'),
sl2 AS (SELECT *, concat_ws(':', project, 'SEC-HARDCODED-SECRET', path, CAST(n AS VARCHAR)) AS key,
               TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(n AS BIGINT)) AS t0 FROM sl WHERE doc_id % 3 = 0),
slog AS (SELECT key, list_extract({STAT}, CAST((doc_id + n) % 4 AS INTEGER) + 1) AS status,
                concat('review ', CAST(n AS VARCHAR)) AS note, t0 AS updated_at FROM sl2
         UNION ALL
         SELECT key, list_extract({STAT}, CAST((doc_id + n + 1) % 4 AS INTEGER) + 1), 're-review', t0 + INTERVAL 1 DAY
         FROM sl2 WHERE doc_id % 6 = 0
         UNION ALL
         SELECT key, 'closed', 'bad status', t0 + INTERVAL 2 DAY FROM sl2 WHERE doc_id % 9 = 0),
svalid AS (SELECT * FROM slog WHERE status IN ({', '.join("'" + x + "'" for x in fixed.ISSUE_STATUSES)}) AND key <> ''),
slatest AS (SELECT key, arg_max(status, updated_at) AS status, arg_max(note, updated_at) AS note FROM svalid GROUP BY key)"""

q("read_issue_status", f"SELECT key, status, note, strftime(updated_at, {ISO}) AS updated_at FROM slog", STATUS_CTES)
q("status_valid", f"SELECT key, status, strftime(updated_at, {ISO}) AS updated_at FROM svalid", STATUS_CTES)
q("latest_status", "SELECT key, status, note FROM slatest", STATUS_CTES)
q("export_issue_status", "SELECT key, status, note FROM slatest", STATUS_CTES)
q("overlay_status", """
SELECT i.key, coalesce(s.status, 'open') AS status, coalesce(s.note, '') AS note
FROM issues i LEFT JOIN slatest s ON s.key = i.key""", RULE_CTES + "," + STATUS_CTES)
q("source_preview", """
SELECT i.key, min(l.n) AS from_line, max(l.n) AS to_line, count(*) AS n_lines,
       string_agg(concat(CAST(l.n AS VARCHAR), ': ', l.text), chr(10) ORDER BY l.n) AS preview
FROM issues i JOIN lines l ON l.project = i.project AND l.path = i.path
 AND l.n BETWEEN greatest(i.line - 4, 1) AND i.line + 4
GROUP BY i.key""", RULE_CTES)
BUCKET = "CASE WHEN starts_with(rule_id, 'PORT-WIN') THEN 'WIN' WHEN starts_with(rule_id, 'PORT-POSIX') THEN 'NIX' ELSE 'ALL' END"
q("platform_bucket", f"SELECT key, {BUCKET} AS bucket FROM issues", RULE_CTES)
q("platform_counts", f"SELECT project, {BUCKET} AS bucket, count(*) AS issues FROM issues GROUP BY project, bucket", RULE_CTES)
q("platform_top8", f"""
SELECT project, bucket, rank, key, CAST(greatest(total - 8, 0) AS BIGINT) AS remainder FROM (
  SELECT project, {BUCKET} AS bucket, key,
         row_number() OVER (PARTITION BY project, {BUCKET} ORDER BY path, line, rule_ord) AS rank,
         count(*) OVER (PARTITION BY project, {BUCKET}) AS total FROM issues) t WHERE rank <= 8""", RULE_CTES)
q("top_complex_files", """
SELECT project, rank, path, cyclomatic FROM (
  SELECT project, path, cyclomatic, row_number() OVER (PARTITION BY project ORDER BY cyclomatic DESC, path) AS rank
  FROM metrics) t WHERE rank <= 10""", METRIC_CTES)
q("sorted_files", """
SELECT project, rank, path, code_lines FROM (
  SELECT project, path, code_lines, row_number() OVER (PARTITION BY project ORDER BY code_lines DESC, path) AS rank
  FROM metrics) t WHERE rank <= 500""", METRIC_CTES)
q("severity_filter", "SELECT key, severity FROM issues WHERE severity = 'critical'", RULE_CTES)


def _page(sev_filter: str, n: int) -> str:
    return f"""
SELECT project, rank, key FROM (
  SELECT project, key, row_number() OVER (PARTITION BY project ORDER BY path, line, rule_ord) AS rank
  FROM issues {sev_filter}) t WHERE rank <= {n}"""


q("issue_page", _page("WHERE severity = 'major'", 500), RULE_CTES)
q("report_top_issues", _page("", 40), RULE_CTES)
HEAD = ("printf('files=%d code_lines=%d issues=%d tqi=%d grade=%s security=%d robustness=%d efficiency=%d "
        "transferability=%d changeability=%d portability=%d', file_count, code_lines, issue_count, "
        "CAST(floor(tqi) AS INTEGER), grade, " +
        ", ".join(f"CAST(floor({f}) AS INTEGER)" for f in
                  ["security", "robustness", "efficiency", "transferability", "changeability", "portability"]) + ")")
q("report_digest", f"""
SELECT g.project, concat_ws(chr(10), {HEAD}, coalesce(t.top, '')) AS digest
FROM graded g LEFT JOIN (
  SELECT project, string_agg(printf('%s %s %s:%d', severity, rule_id, path, line), chr(10) ORDER BY rank) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path, line, rule_ord) AS rank FROM issues) x
  WHERE rank <= 15 GROUP BY project) t ON t.project = g.project""", REPORT)


def label(e: str) -> str:
    last = f"regexp_extract(regexp_replace({e}, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1)"
    safe = f"regexp_replace({last}, '[^A-Za-z0-9._-]+', '_', 'g')"
    trimmed = f"regexp_replace({safe}, '^[_.-]+|[_.-]+$', '', 'g')"
    return f"coalesce(nullif({trimmed}, ''), 'report')"


q("project_label", f"""
SELECT source AS project, lang, {label("concat('C:/corpora/', source, ' (', lang, ')/')")} AS label
FROM (SELECT DISTINCT source, lang FROM documents) d""")
q("export_issues_csv", f"""
SELECT severity, rule_id, cwe, path AS file, CAST(line AS BIGINT) AS line, title,
       CAST(remediation_minutes AS BIGINT) AS remediation_minutes, {label('project')} AS label, project FROM issues""", RULE_CTES)
q("export_report_json", f"""SELECT project, issue_count, grade, {r6('tqi')} AS tqi, debt_minutes, file_count AS files,
 total_cyclomatic AS cyclomatic, issue_count AS issues, debt_minutes AS issue_minutes FROM graded""", REPORT)
MET = [("files_total", "file_count"), ("code_lines_total", "code_lines"), ("issues_total", "issue_count"),
       ("debt_minutes", "debt_minutes"), ("tqi", "tqi")]
q("export_metrics_text", " UNION ALL ".join(
    [f"SELECT project, 'linewise_{m}' AS metric, '' AS labels, {r6(c)} AS value FROM graded" for m, c in MET] +
    [f"SELECT project, 'linewise_health', 'factor=\"{f}\"', {r6(f)} FROM graded" for f in fixed.FACTORS]), REPORT)
q("new_critical_issues", """
SELECT c.key, c.rule_id, c.path FROM issues c
WHERE c.severity = 'critical' AND NOT EXISTS (
  SELECT 1 FROM issues p WHERE p.severity = 'critical'
    AND TRY_CAST(regexp_extract(p.path, 'doc([0-9]+)\\.', 1) AS BIGINT) % 7 <> 0
    AND p.project = c.project AND p.rule_id = c.rule_id AND p.path = c.path AND p.full_text = c.full_text)""", RULE_CTES)

# ------------------------------------------------------------------ history
SC = ScoreConfig()
GRADE = (f"CASE WHEN tqi >= {SC.grade_a} THEN 'A' WHEN tqi >= {SC.grade_b} THEN 'B' WHEN tqi >= {SC.grade_c} THEN 'C' "
         f"WHEN tqi >= {SC.grade_d} THEN 'D' ELSE 'F' END")
HIST_CTES = f"""
ev AS (SELECT ts, user_id, event_type, user_id % 5 AS m FROM events),
hb AS (SELECT concat('p', CAST(m AS VARCHAR)) AS project,
              CASE WHEN m < 2 THEN date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 12) * 12 AS BIGINT))
                   ELSE date_trunc('day', ts) END AS ts, user_id, event_type FROM ev),
snap0 AS (SELECT project, ts, count(DISTINCT user_id) AS file_count, count(*) AS issue_count,
                 100.0 - least(100.0, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE)) AS tqi,
                 count(*) FILTER (WHERE event_type = 'purchase') AS duplicate_blocks FROM hb GROUP BY project, ts),
snap AS (SELECT *, {GRADE} AS grade FROM snap0)"""
q("read_history", f"""
SELECT project, strftime(ts, {ISO}) AS ts, file_count, issue_count, tqi,
       CASE WHEN issue_count % 13 = 0 THEN 'F' ELSE grade END AS grade, duplicate_blocks FROM snap""", HIST_CTES)
q("append_history", "SELECT project, count(*) AS snapshots, CAST(sum(issue_count) AS BIGINT) AS issues FROM snap GROUP BY project",
  HIST_CTES)
q("history_ring", f"""
SELECT project, strftime(ts, {ISO}) AS ts, {r6('tqi')} AS tqi FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC) AS age FROM snap) t WHERE age <= 50""", HIST_CTES)
q("trend", f"""
SELECT project, seq, strftime(ts, {ISO}) AS ts, {r6('tqi')} AS tqi, {r6('tqi_delta')} AS tqi_delta, issue_delta FROM (
  SELECT project, ts, tqi, row_number() OVER w AS seq, tqi - lag(tqi) OVER w AS tqi_delta,
         issue_count - lag(issue_count) OVER w AS issue_delta, count(*) OVER (PARTITION BY project) AS points
  FROM snap WINDOW w AS (PARTITION BY project ORDER BY ts)) t WHERE points >= 2""", HIST_CTES)
q("grade_at_or_below", f"""
SELECT project, strftime(ts, {ISO}) AS ts, grade FROM snap
WHERE instr('FDCBA', grade) > 0 AND instr('FDCBA', grade) <= instr('FDCBA', 'C')""", HIST_CTES)
LIST_CTES = """
rd AS (SELECT project, path, mtime, CAST(regexp_extract(path, 'doc([0-9]+)\\.', 1) AS BIGINT) AS doc_id FROM raw_docs),
lcur AS (SELECT project, path, mtime FROM rd WHERE doc_id % 13 <> 0),
lprev AS (SELECT project, path, CASE WHEN doc_id % 4 = 0 THEN mtime - INTERVAL 1 HOUR ELSE mtime END AS mtime
          FROM rd WHERE doc_id % 11 <> 0)"""
q("change_set", """
SELECT coalesce(c.project, p.project) AS project, coalesce(c.path, p.path) AS path,
       CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM lprev p FULL OUTER JOIN lcur c ON c.project = p.project AND c.path = p.path
WHERE p.path IS NULL OR c.path IS NULL OR p.mtime <> c.mtime""", LIST_CTES)
q("listing_diff", f"""
SELECT project, path, strftime(mtime, {ISO}) AS mtime, 'prev_only' AS side FROM (SELECT * FROM lprev EXCEPT ALL SELECT * FROM lcur) a
UNION ALL
SELECT project, path, strftime(mtime, {ISO}) AS mtime, 'cur_only' AS side FROM (SELECT * FROM lcur EXCEPT ALL SELECT * FROM lprev) b""",
  LIST_CTES)
q("incremental_plan", """
SELECT c.project, c.path, CASE WHEN p.path IS NULL THEN 'recompute' ELSE 'reuse' END AS action
FROM lcur c LEFT JOIN lprev p ON p.project = c.project AND p.path = c.path AND p.mtime = c.mtime""", LIST_CTES)

# ------------------------------------------------------------------ logs and sessions
q("log_recent", f"""
SELECT strftime(ts, {ISO}) AS timestamp, level, message FROM (
  SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN'
                  WHEN event_type = 'purchase' THEN 'INFO' ELSE 'DEBUG' END AS level,
         concat_ws(' ', event_type, 'user', CAST(user_id AS VARCHAR), 'event', CAST(event_id AS VARCHAR)) AS message,
         event_id FROM events) t
WHERE level <> 'DEBUG' ORDER BY ts DESC, event_id DESC LIMIT 200""")
q("sessionize", f"""
SELECT user_id, strftime(min(ts), {ISO}) AS session_start, strftime(max(ts) + INTERVAL 60 MINUTE, {ISO}) AS session_end,
       count(*) AS events FROM (
  SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 60 MINUTE THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (
    SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) a) b
GROUP BY user_id, sid""")

_ = (DUP_CTES, TOTALS)

# ------------------------------------------------------------------ streaming (same results as the batch forms)
q("stream_watch_scan", """SELECT m.project, m.path, m.language, m.total_lines, m.code_lines, m.comment_lines, m.blank_lines, m.functions,
                          m.cyclomatic, m.max_nesting, m.long_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS issues
FROM metrics m LEFT JOIN (SELECT project, path, count(*) AS n FROM issues GROUP BY project, path) c ON c.project = m.project AND c.path = m.path
WHERE coalesce(TRY_CAST(regexp_extract(m.path, 'doc([0-9]+)\\.', 1) AS BIGINT) % 13 <> 0, true)""", METRIC_CTES + "," + RULE_CTES)
q("stream_rule_counts", f"""
SELECT strftime(w, {ISO}) AS window_start, strftime(w + INTERVAL 1 HOUR, {ISO}) AS window_end, rule_id, severity, count(*) AS issues
FROM (SELECT c.rule_id, c.severity, unnest([time_bucket(INTERVAL 30 MINUTE, f.mtime), time_bucket(INTERVAL 30 MINUTE, f.mtime) - INTERVAL 30 MINUTE]) AS w
      FROM cand c JOIN files f ON f.project = c.project AND f.path = c.path) t
GROUP BY ALL""", RULE_CTES)
q("stream_latest_file", f"""
SELECT project, path, strftime(max(mtime), {ISO}) AS mtime FROM (SELECT * FROM lprev UNION ALL SELECT * FROM lcur) t
GROUP BY project, path""", LIST_CTES)
q("stream_status_upsert", "SELECT key, status, note FROM slatest", STATUS_CTES)
q("stream_grade_alert", f"""
SELECT project, strftime(ts, {ISO}) AS ts, grade FROM snap
WHERE instr('FDCBA', grade) > 0 AND instr('FDCBA', grade) <= instr('FDCBA', 'C')""", HIST_CTES)
SQL_LOG = __import__("linewise.plans.oracle", fromlist=["SQL"]).SQL["log_recent"]
__import__("linewise.plans.oracle", fromlist=["SQL"]).SQL["stream_log_ring"] = SQL_LOG


# ------------------------------------------------------------------ helpers seen from the other side
from linewise.config import ScanConfig  # noqa: E402
from linewise.plans.oracle import SQL, rules_values  # noqa: E402

_M = ScanConfig().suppress_marker
q("suppress_inline", f"""
SELECT l.project, r.rule_id, count(*) AS issues
FROM (SELECT project, path, n,
             CASE WHEN text = 'password = "hunter2x"' AND doc % 8 = 0
                       THEN concat(text, ' // {_M} SEC-HARDCODED-SECRET: test value')
                  WHEN text = 'password = "hunter2x"' AND doc % 8 = 4 THEN concat(text, ' // {_M} SEC-EVAL')
                  ELSE text END AS text
      FROM (SELECT *, TRY_CAST(regexp_extract(path, 'doc([0-9]+)\\.', 1) AS BIGINT) AS doc FROM lines) x) l
JOIN {rules_values()} r ON regexp_matches(l.text, r.re2)
WHERE NOT (contains(l.text, '{_M}') AND contains(l.text, r.rule_id))
GROUP BY l.project, r.rule_id""")
q("issue_key", "SELECT key, rule_id, path, line FROM issues", RULE_CTES)
q("log_level_from", """
SELECT lower(CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN'
                  WHEN event_type = 'purchase' THEN 'INFO' ELSE 'DEBUG' END) AS level, count(*) AS entries
FROM events GROUP BY 1""")
q("iso_ts", f"SELECT event_id, strftime(ts, {ISO}) AS ts FROM events")
q("severity_from", """
SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'signup' THEN 'minor' ELSE 'info' END AS severity,
       count(*) AS issues FROM events GROUP BY 1""")
q("clamp", f"SELECT event_id, {r6('greatest(0.0, least(100.0, value * 3 - 50))')} AS score FROM events")
# the throttle's automaton, one attempt after the other
q("burst_throttle", f"""
SELECT a.user_id, a.event_id, strftime(a.ts, {ISO}) AS ts, a.ok, t.blocked
FROM att a JOIN thr t ON t.user_id = a.user_id AND t.rn = a.rn""", """
att AS (SELECT user_id, event_id, ts, event_type = 'signup' AS ok, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events WHERE event_type IN ('error', 'signup')),
thr(user_id, rn, failures, since, blocked) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM att
  UNION ALL
  SELECT user_id, rn, CASE WHEN b THEN f WHEN ok THEN 0 ELSE f + 1 END, CASE WHEN NOT b AND ok THEN NULL ELSE s END, b
  FROM (SELECT x.*, x.f >= 5 AS b FROM (
          SELECT t.user_id, a.rn, a.ok, CASE WHEN t.since IS NULL OR a.sec - t.since >= 60 THEN 0 ELSE t.failures END AS f,
                 CASE WHEN t.since IS NULL OR a.sec - t.since >= 60 THEN a.sec ELSE t.since END AS s
          FROM thr t JOIN att a ON a.user_id = t.user_id AND a.rn = t.rn + 1) x) y)""")
for _n in ("sessionize", "burst_throttle"):
    SQL[f"stream_{_n}"] = SQL[_n]
q("status_rejected", "SELECT key, status, note FROM slog WHERE status NOT IN ('open', 'accepted', 'wontfix', 'false_positive')", STATUS_CTES)
q("factor_from", """
SELECT CASE event_type WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'efficiency' WHEN 'signup' THEN 'portability' ELSE 'robustness' END AS factor,
       count(*) AS issues FROM events GROUP BY 1""")
q("gate_new_critical", """
SELECT g.project, coalesce(n.n, 0) <= 2 AS passed, CASE WHEN n.n > 2 THEN concat('New critical issues: ', CAST(n.n AS VARCHAR)) ELSE '' END AS reason
FROM (SELECT DISTINCT project FROM files) g LEFT JOIN (
  SELECT c.project, count(*) AS n FROM issues c WHERE c.severity = 'critical' AND NOT EXISTS (
    SELECT 1 FROM issues p WHERE p.severity = 'critical' AND TRY_CAST(regexp_extract(p.path, 'doc([0-9]+)\\.', 1) AS BIGINT) % 7 <> 0
      AND p.project = c.project AND p.rule_id = c.rule_id AND p.path = c.path AND p.full_text = c.full_text)
  GROUP BY c.project) n ON n.project = g.project""", RULE_CTES)
q("sql_source_lines", """SELECT l.project, l.n_lines, l.bytes, l.longest, g.issue_count AS issues, g.n_critical AS critical, g.grade
FROM (SELECT project, count(*) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(n) AS longest FROM lines GROUP BY project) l
JOIN graded g ON g.project = l.project""", REPORT)
q("join_language", """SELECT project, path, ext, language FROM docfiles
UNION ALL SELECT project, 'vendor/' || path, ext, language FROM docfiles WHERE TRY_CAST(regexp_extract(path, 'doc([0-9]+)', 1) AS BIGINT) % 10 = 9""")
q("join_technology", "SELECT project, path, name, category FROM ftech", DEP_CTES)
q("distinct_sorted", """SELECT project, dependency, row_number() OVER (PARTITION BY project ORDER BY dependency) AS place
FROM (SELECT DISTINCT project, dependency FROM fdeps) d""", DEP_CTES)
q("union_projects", f"SELECT project, grade, {r6('tqi')} AS tqi, issue_count AS issues FROM graded", REPORT)
