"""Registered queries, steps 8-10: issue status, previews, reports,
exports, history, incremental scans, logs and sessions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from linewise.config import GateConfig
from linewise.functions.text import clamp, factor_from, severity_from
from linewise.functions.text import iso_ts, project_label
from linewise.operators import deps, health, lines
from linewise.operators import history as H
from linewise.operators import issues as I
from linewise.operators import logs as L
from linewise.operators import metrics as M
from linewise.operators.numbering import numbered
from linewise.operators.rules import platform_bucket
from linewise.plans import exports as X
from linewise.plans.analyze import Analysis
from linewise.plans.catalog import _analysis, _files, _r6, query
from linewise.session import shared_path
from linewise.sources import corpus
from linewise.sources import fixtures as FX


def _scratch(spark, sf, name):
    """A folder of this call's own: a later query never overwrites what an earlier result still reads."""
    tag = hashlib.sha1(sf.encode()).hexdigest()[:10]
    return shared_path(spark, f"linewise/{name}-{tag}-{uuid.uuid4().hex[:12]}")


def _status_store(spark, sf):
    path = _scratch(spark, sf, "issue_status")
    I.write_issue_status(FX.issue_status_log(spark, sf), path)
    return I.read_issue_status(spark, path)


# ----------------------------------------------------------------- step 8
@query("read_issue_status")
def q_read_issue_status(spark, sf):
    st = _status_store(spark, sf)
    return st.select("key", "status", "note", iso_ts(F.col("updated_at")).alias("updated_at"))


@query("status_valid")
def q_status_valid(spark, sf):
    st = _status_store(spark, sf)
    return I.status_valid(st).select("key", "status", iso_ts(F.col("updated_at")).alias("updated_at"))


@query("status_rejected")
def q_status_rejected(spark, sf):
    """The side table of statuses that are not taken."""
    return I.status_rejected(_status_store(spark, sf)).select("key", "status", "note")


@query("latest_status")
def q_latest_status(spark, sf):
    return I.latest_status(I.status_valid(_status_store(spark, sf))).select("key", "status", "note")


@query("export_issue_status")
def q_export_issue_status(spark, sf):
    latest = I.latest_status(I.status_valid(_status_store(spark, sf)))
    path = _scratch(spark, sf, "issue_status_rewrite")
    I.write_issue_status(latest, path)
    return I.read_issue_status(spark, path).select("key", "status", "note")


@query("overlay_status")
def q_overlay_status(spark, sf):
    a = _analysis(spark, sf)
    return I.overlay_status(a.issues, _status_store(spark, sf)).select("key", "status", "note")


@query("source_preview")
def q_source_preview(spark, sf):
    return _analysis(spark, sf, materialize=False).previews.select("key", "from_line", "to_line", "n_lines", "preview")


@query("platform_bucket")
def q_platform_bucket(spark, sf):
    return _analysis(spark, sf).issues.select("key", platform_bucket(F.col("rule_id")).alias("bucket"))


@query("platform_counts")
def q_platform_counts(spark, sf):
    return I.platform_counts(_analysis(spark, sf).issues)


@query("platform_top8")
def q_platform_top8(spark, sf):
    t = I.platform_top(_analysis(spark, sf).issues, 8)
    return t.select("project", "bucket", "rank", "key", F.col("remainder").cast("long").alias("remainder"))


@query("top_complex_files")
def q_top_complex_files(spark, sf):
    t = M.top_complex_files(M.file_metrics(_files(spark, sf), with_deps=False), 10)
    return t.select("project", "rank", "path", "cyclomatic")


@query("sorted_files")
def q_sorted_files(spark, sf):
    t = M.sorted_files(M.file_metrics(_files(spark, sf), with_deps=False), "code_lines", ascending=False, n=500)
    return t.select("project", "rank", "path", "code_lines")


@query("severity_filter")
def q_severity_filter(spark, sf):
    return I.severity_filter(_analysis(spark, sf).issues, "critical").select("key", "severity")


@query("issue_page")
def q_issue_page(spark, sf):
    return I.issue_page(_analysis(spark, sf).issues, "major", 500).select("project", "rank", "key")


@query("report_top_issues")
def q_report_top_issues(spark, sf):
    return I.report_top_issues(_analysis(spark, sf).issues, 40).select("project", "rank", "key")


@query("report_digest")
def q_report_digest(spark, sf):
    a = _analysis(spark, sf)
    return I.report_digest(a.report, a.issues, 15)


@query("project_label")
def q_project_label(spark, sf):
    d = FX.read_table(spark, sf, "documents").select("source", "lang").distinct()
    root = F.concat(F.lit("C:/corpora/"), F.col("source"), F.lit(" ("), F.col("lang"), F.lit(")/"))
    return d.select(F.col("source").alias("project"), "lang", project_label(root).alias("label"))


@query("export_issues_csv")
def q_export_issues_csv(spark, sf):
    out = _scratch(spark, sf, "export")
    X.export_issues_csv(_analysis(spark, sf).issues, out, {"source": "linewise", "sf": sf})
    return X.read_issues_csv(spark, out)


@query("export_report_json")
def q_export_report_json(spark, sf):
    """The whole report written as JSON (report, files, issues), then read back."""
    a = _analysis(spark, sf)
    out = _scratch(spark, sf, "report")
    X.export_report_json(a.report, a.file_records, a.issues, out)
    r = F.from_json("report", "issue_count long, grade string, health struct<tqi double>, debt struct<total_minutes long>")
    back = spark.read.schema("report string, project string").json(f"{out}/report").select("project", r.alias("r"))
    files = (spark.read.schema("path string, cyclomatic long, dependencies array<string>, issues long, project string").json(f"{out}/files")
             .groupBy("project").agg(F.count("path").alias("files"), F.sum("cyclomatic").alias("cyclomatic")))
    issues = (spark.read.schema("key string, remediation_minutes long, project string").json(f"{out}/issues")
              .groupBy("project").agg(F.countDistinct("key").alias("issues"), F.sum("remediation_minutes").alias("issue_minutes")))
    return back.join(files, "project", "left").join(issues, "project", "left").select(
        "project", F.col("r.issue_count").alias("issue_count"), F.col("r.grade").alias("grade"),
        _r6(F.col("r.health.tqi")).alias("tqi"), F.col("r.debt.total_minutes").alias("debt_minutes"), "files", "cyclomatic",
        F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("issue_minutes", F.lit(0)).alias("issue_minutes"))


@query("export_metrics_text")
def q_export_metrics_text(spark, sf):
    """The exposition text written, read back and taken apart."""
    out = _scratch(spark, sf, "metrics")
    X.export_metrics_text(_analysis(spark, sf).report, out)
    part = lambda k: F.regexp_extract("value", r'^([a-z_]+)\{project="([^"]*)"(?:,([^}]*))?\} (\S+)$', k)
    return spark.read.text(out).select(part(2).alias("project"), part(1).alias("metric"), part(3).alias("labels"),
                                       _r6(part(4).cast("double")).alias("value"))


@query("gate_new_critical")
def q_gate_new_critical(spark, sf):
    """The quality gate that fails a project for critical issues which the scan before did not have."""
    a = _analysis(spark, sf)
    prev = a.issues.filter(FX.doc_id_of(F.col("path")) % 7 != 0)
    gate = GateConfig(min_tqi=-1.0, max_critical=-1, max_new_critical=2)
    g = health.quality_gate(a.report, gate, I.new_critical_issues(a.issues, prev))
    return g.select("project", "passed", "reason")


@query("new_critical_issues")
def q_new_critical_issues(spark, sf):
    cur = _analysis(spark, sf).issues
    prev = cur.filter(FX.doc_id_of(F.col("path")) % 7 != 0)
    return I.new_critical_issues(cur, prev).select("key", "rule_id", "path")


# ----------------------------------------------------------------- step 9
def _history_store(spark, sf):
    """Snapshots written as NDJSON (first half, then appended second half),
    with a missing grade on every 13th snapshot and one line that is not JSON."""
    snaps = FX.history_snapshots(spark, sf)
    rows = H.history_to_json_rows(snaps)
    rows = rows.withColumn("grade", F.when(F.col("issue_count") % 13 == 0, F.lit(None)).otherwise(F.col("grade")))
    path = _scratch(spark, sf, "history")
    cut = F.lit("2024-01-16")
    rows.filter(F.col("timestamp") < cut).write.mode("overwrite").json(path)
    rows.filter(F.col("timestamp") >= cut).write.mode("append").json(path)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    return H.read_history(spark, path)


@query("read_history")
def q_read_history(spark, sf):
    h = _history_store(spark, sf)
    return h.select("project", iso_ts(F.col("ts")).alias("ts"), "file_count", "issue_count", "tqi", "grade",
                    "duplicate_blocks")


@query("append_history")
def q_append_history(spark, sf):
    h = _history_store(spark, sf)
    return h.groupBy("project").agg(F.count("*").alias("snapshots"), F.sum("issue_count").cast("long").alias("issues"))


@query("history_ring")
def q_history_ring(spark, sf):
    h = H.history_ring(FX.history_snapshots(spark, sf), 50)
    return h.select("project", iso_ts(F.col("ts")).alias("ts"), _r6(F.col("tqi")).alias("tqi"))


@query("trend")
def q_trend(spark, sf):
    t = H.trend(FX.history_snapshots(spark, sf))
    return t.select("project", "seq", iso_ts(F.col("ts")).alias("ts"), _r6(F.col("tqi")).alias("tqi"),
                    _r6(F.col("tqi_delta")).alias("tqi_delta"), "issue_delta")


@query("grade_at_or_below")
def q_grade_at_or_below(spark, sf):
    h = FX.history_snapshots(spark, sf)
    return H.grade_alerts(h, "C").select("project", iso_ts(F.col("ts")).alias("ts"), "grade")


@query("change_set")
def q_change_set(spark, sf):
    prev, cur = FX.listings(spark, sf)
    return H.change_set(prev, cur)


@query("listing_diff")
def q_listing_diff(spark, sf):
    prev, cur = FX.listings(spark, sf)
    return H.listing_diff(prev, cur).select("project", "path", iso_ts(F.col("mtime")).alias("mtime"), "side")


@query("incremental_plan")
def q_incremental_plan(spark, sf):
    prev, cur = FX.listings(spark, sf)
    return H.incremental_plan(prev, cur).select("project", "path", "action")


# ----------------------------------------------------------------- step 10
@query("log_recent")
def q_log_recent(spark, sf):
    r = L.log_recent(FX.logs(spark, sf), "info", 200)
    return r.select(iso_ts(F.col("timestamp")).alias("timestamp"), "level", "message")


@query("sessionize")
def q_sessionize(spark, sf):
    s = L.sessionize(FX.events_ts(spark, sf))
    return s.select("user_id", iso_ts(F.col("session_start")).alias("session_start"),
                    iso_ts(F.col("session_end")).alias("session_end"), "events")


@query("burst_throttle")
def q_burst_throttle(spark, sf):
    t = L.burst_throttle(FX.attempts(spark, sf), 5, 60)
    return t.select("user_id", "event_id", iso_ts(F.col("ts")).alias("ts"), "ok", "blocked")


# ----------------------------------------------------------------- streaming
def _run_stream(spark, name, frame, job, order_by=None, tick=None, **kw):
    """Stage `frame` as a file stream source, run `job` with availableNow,
    return the sink path."""
    from linewise.streaming import jobs as S
    src = S.stage(frame, S.fresh(spark, f"{name}-src"), order_by=order_by, tick=tick)
    sink, ckpt = S.fresh(spark, f"{name}-sink"), S.fresh(spark, f"{name}-ckpt")
    job(spark, src, frame.schema, sink, ckpt, **kw)
    return sink


@query("stream_watch_scan")
def q_stream_watch_scan(spark, sf):
    """Two listings of the corpus: the second edits, adds and removes files of the first."""
    from linewise.streaming import jobs as S
    files = _files(spark, sf).select("project", "path", "ext", "language", "content", "size", "mtime")
    doc = FX.doc_id_of(F.col("path"))
    was, is_now = F.coalesce(doc % 11 != 0, F.lit(True)), F.coalesce(doc % 13 != 0, F.lit(True))
    old = F.coalesce(doc % 4 == 0, F.lit(False))
    before = files.filter(was).withColumn("content", F.when(old, F.concat("content", F.lit("\ngoto old;"))).otherwise(F.col("content")))
    before = before.withColumn("mtime", F.when(old, F.timestamp_add("HOUR", F.lit(-1), F.col("mtime"))).otherwise(F.col("mtime")))
    now = files.filter(is_now).unionByName(files.filter(was & ~is_now).withColumn("content", F.lit(None).cast("string")))
    src, sink, ckpt = (S.fresh(spark, f"watch-{n}") for n in ("src", "sink", "ckpt"))
    schema = before.withColumn("seen", F.lit(1)).schema
    S.stage(before.withColumn("seen", F.lit(1)), src, 2)
    S.watch_scan(spark, src, schema, sink, ckpt)
    S.append_slices(now.withColumn("seen", F.lit(2)), src, 2)
    S.watch_scan(spark, src, schema, sink, ckpt)
    issues = F.expr("cast(size(filter(issues, i -> not i.silenced)) as long)").alias("issues")
    return S.watched(spark, sink).select("project", "path", "language", *M.METRIC_COLUMNS, issues)


@query("stream_rule_counts")
def q_stream_rule_counts(spark, sf):
    from linewise.streaming import jobs as S
    tick = dict.fromkeys(("project", "path", "language", "content"), "tick")
    sink = _run_stream(spark, "rulecounts", _files(spark, sf), S.rule_counts, order_by="mtime", tick=tick)
    r = spark.read.parquet(sink)
    return r.select(iso_ts(F.col("window_start")).alias("window_start"), iso_ts(F.col("window_end")).alias("window_end"),
                    "rule_id", "severity", "issues")


@query("stream_latest_file")
def q_stream_latest_file(spark, sf):
    from linewise.streaming import jobs as S
    prev, cur = FX.listings(spark, sf)
    table = _run_stream(spark, "latest", prev.unionByName(cur), S.latest_file)
    t = S.read_versioned(spark, table)
    return t.select("project", "path", iso_ts(F.col("mtime")).alias("mtime"))


@query("stream_status_upsert")
def q_stream_status_upsert(spark, sf):
    from linewise.streaming import jobs as S
    table = _run_stream(spark, "status", FX.issue_status_log(spark, sf), S.status_upsert)
    return S.read_versioned(spark, table).select("key", "status", "note")


@query("stream_grade_alert")
def q_stream_grade_alert(spark, sf):
    from linewise.streaming import jobs as S
    sink = _run_stream(spark, "alert", FX.history_snapshots(spark, sf), S.grade_alert)
    return spark.read.parquet(sink).select("project", iso_ts(F.col("ts")).alias("ts"), "grade")


@query("stream_log_ring")
def q_stream_log_ring(spark, sf):
    from linewise.streaming import jobs as S
    table = _run_stream(spark, "logs", FX.logs(spark, sf), S.log_ring)
    r = L.log_recent(S.read_ring(spark, table), "info", 200)
    return r.select(iso_ts(F.col("timestamp")).alias("timestamp"), "level", "message")


@query("stream_sessionize")
def q_stream_sessionize(spark, sf):
    from linewise.streaming import jobs as S
    ev = FX.events_ts(spark, sf).select("user_id", "ts")
    sink = _run_stream(spark, "sessions", ev, S.sessions, order_by="ts", tick={})
    s = spark.read.parquet(sink)
    return s.select("user_id", iso_ts(F.col("session_start")).alias("session_start"),
                    iso_ts(F.col("session_end")).alias("session_end"), "events")


@query("stream_burst_throttle")
def q_stream_burst_throttle(spark, sf):
    from linewise.streaming import jobs as S
    sink = _run_stream(spark, "throttle", FX.attempts(spark, sf), S.throttle, order_by="ts", tick={})
    t = spark.read.parquet(sink)
    return t.select("user_id", "event_id", iso_ts(F.col("ts")).alias("ts"), "ok", "blocked")


# ----------------------------------------------------------------- helpers seen from the other side
@query("suppress_inline")
def q_suppress_inline(spark, sf):
    """Secret lines of documents with doc_id % 4 = 0 carry an inline marker
    naming their rule (and doc_id % 8 = 4 a marker naming another rule)."""
    from linewise.config import ScanConfig
    from linewise.operators.lines import explode_lines
    from linewise.operators.rules import apply_rules
    m = ScanConfig().suppress_marker
    ln = explode_lines(_files(spark, sf)).withColumn("doc_id", FX.doc_id_of(F.col("path")))
    marked = F.when((F.col("text") == FX.SECRET_LINE) & (F.col("doc_id") % 8 == 0),
                    F.concat(F.col("text"), F.lit(f" // {m} SEC-HARDCODED-SECRET: test value"))) \
              .when((F.col("text") == FX.SECRET_LINE) & (F.col("doc_id") % 8 == 4),
                    F.concat(F.col("text"), F.lit(f" // {m} SEC-EVAL"))) \
              .otherwise(F.col("text"))
    iss = apply_rules(ln.withColumn("text", marked).drop("doc_id"))
    return iss.groupBy("project", "rule_id").agg(F.count("*").alias("issues"))


@query("truncate_content")
def q_truncate_content(spark, sf):
    from linewise.config import ScanConfig
    from linewise.sources.corpus import documents_as_files
    f = documents_as_files(spark, sf, ScanConfig(max_file_bytes=1024))
    return f.filter(F.col("size") >= 1000).select("project", "path", "size")


@query("issue_key")
def q_issue_key(spark, sf):
    return _analysis(spark, sf).issues.select("key", "rule_id", "path", "line")


@query("log_level_from")
def q_log_level_from(spark, sf):
    from linewise.functions.text import log_level_from
    lg = FX.logs(spark, sf)
    return lg.groupBy(log_level_from(F.col("level")).alias("level")).agg(F.count("*").alias("entries"))


@query("iso_ts")
def q_iso_ts(spark, sf):
    e = FX.events_ts(spark, sf)
    return e.select("event_id", iso_ts(F.col("ts")).alias("ts"))


@query("severity_from")
def q_severity_from(spark, sf):
    """Severities as a foreign tool may write them: unknown ones become info."""
    e = FX.events_ts(spark, sf).select("event_type")
    written = (F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "major")
               .when(F.col("event_type") == "signup", "minor").otherwise(F.upper("event_type")))
    return e.select(severity_from(written).alias("severity")).groupBy("severity").agg(F.count("*").alias("issues"))


@query("factor_from")
def q_factor_from(spark, sf):
    """Health factors as a foreign tool may write them: unknown ones become robustness."""
    e = FX.events_ts(spark, sf).select("event_type")
    written = (F.when(F.col("event_type") == "error", "security").when(F.col("event_type") == "purchase", "efficiency")
               .when(F.col("event_type") == "signup", "portability").otherwise(F.upper("event_type")))
    return e.select(factor_from(written).alias("factor")).groupBy("factor").agg(F.count("*").alias("issues"))


@query("clamp")
def q_clamp(spark, sf):
    """Scores below 0 and above 100 are brought to the ends of the scale."""
    e = FX.events_ts(spark, sf)
    return e.select("event_id", _r6(clamp(F.col("value") * 3 - 50)).alias("score"))


# ----------------------------------------------------------------- operators also used inside others
@query("join_language")
def q_join_language(spark, sf):
    """Each file with the language that its extension joins to; files of no known language go."""
    f = corpus.detect_language(corpus.documents_with_strays(spark, sf))
    return f.select("project", "path", "ext", "language")


@query("join_technology")
def q_join_technology(spark, sf):
    """A row for each technology that a file's dependencies name."""
    return deps.file_technologies(M.file_metrics(_files(spark, sf))).select("project", "path", "name", "category")


@query("distinct_sorted")
def q_distinct_sorted(spark, sf):
    """Each project's distinct dependencies in order, with their place."""
    d = deps.extract_dependencies(lines.explode_lines(_files(spark, sf))).select("project", "dependency").distinct()
    return numbered(d, [F.col("dependency").asc()], "place", ["project"]).select("project", "dependency", "place")


@query("union_projects")
def q_union_projects(spark, sf):
    """The reports of two scans, one after the other: each project's from the scan that holds it."""
    docs = Analysis(corpus.documents_as_files(spark, sf), corpus=f"documents {sf}")
    pages = Analysis(corpus.pages_as_files(spark, sf), corpus=f"pages {sf}")
    return docs.projects_overview().unionByName(pages.projects_overview())


@query("sql_source_lines")
def q_sql_source_lines(spark, sf):
    """A scan in SQL: files laid out by the table function, issues and grades from the views."""
    from linewise.sql import register
    register(spark, _files(spark, sf), corpus=f"driver tables {sf}", prefix="sql_scan_")
    return spark.sql("""
        WITH laid AS (SELECT f.project, count(*) AS n_lines, sum(octet_length(l.text)) AS bytes, max(l.n) AS longest
                      FROM sql_scan_files f, LATERAL source_lines(f.content) l GROUP BY f.project),
             found AS (SELECT project, count(*) AS issues, count_if(severity_from(severity) = 'critical') AS critical FROM sql_scan_issues GROUP BY project)
        SELECT laid.project, n_lines, bytes, longest, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical, grade_of(r.tqi) AS grade
        FROM laid LEFT JOIN found ON found.project = laid.project JOIN sql_scan_report r ON r.project = laid.project""")
