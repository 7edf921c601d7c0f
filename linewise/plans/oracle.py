"""DuckDB oracle: an independent SQL formulation of each registered query,
run on the same parquet tables (views documents, pages, events, …).

Building blocks are CTE fragments; each query is `WITH <ctes> SELECT …`.
RE2 (DuckDB) has no look-around: keyword boundaries use \\b / \\B, and the
rules that need look-ahead use the RE2 forms from linewise.fixed.
"""

from __future__ import annotations

from linewise import fixed
from linewise.plans.catalog import LANGUAGE_THRESHOLDS
from linewise.config import GateConfig, ScanConfig, ScoreConfig
from linewise.functions.text import keyword_regex_re2
from linewise.sources.corpus import CODIFY_DEPS, CODIFY_EXTS

SQL: dict[str, str] = {}


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


LANG_VALUES = ", ".join(f"({s(e)}, {s(lang)})" for lang, exts in fixed.LANGUAGES for e in exts)

CODIFY_CASE = """CASE
 WHEN n = 1 AND doc_id % 5 = 0 THEN concat('// SPDX-License-Identifier: MIT', chr(10), l)
 WHEN n = 1 AND doc_id % 5 = 1 THEN concat('// Copyright 2026 Example', chr(10), l)
 WHEN k = 0 THEN concat('// ', l)
 WHEN k = 1 THEN concat('/* ', l)
 WHEN k = 2 THEN concat(l, ' */')
 WHEN k = 3 THEN concat('# ', l)
 WHEN k = 4 THEN concat('-- ', l)
 WHEN k = 5 THEN concat('if (x) { ', l, ' }')
 WHEN k = 6 THEN concat('import ', dep, chr(10), l)
 WHEN k = 7 THEN concat('#include <', dep, '>', chr(10), l)
 WHEN k = 8 THEN concat('while (a && b) {', chr(10), l)
 WHEN k = 9 THEN concat('}', chr(10), l)
 WHEN k = 10 THEN concat('password = "hunter2x"', chr(10), l)
 WHEN k = 11 THEN concat('select * from t', chr(10), l)
 WHEN k = 12 THEN concat('', chr(10), l)
 WHEN k = 13 THEN concat('#ifdef _WIN32', chr(10), l)
 WHEN k = 14 THEN concat('#endif', chr(10), l)
 WHEN k = 15 THEN concat('DWORD x = rand();', chr(10), l)
 ELSE l END"""

EXCLUDES = lst(ScanConfig().excludes)

BASE = f"""
cf AS (SELECT doc_id, source AS project, list_extract({lst(CODIFY_EXTS)}, CAST(doc_id % 12 AS INTEGER) + 1) AS ext,
              'src' AS dir, text FROM documents),
ce0 AS (SELECT doc_id, project, ext, dir, string_split(text, chr(10)) AS a FROM cf),
ce AS (SELECT doc_id, project, ext, dir, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS l FROM ce0),
ck AS (SELECT *, (doc_id * 7 + n * 3) % 19 AS k,
              list_extract({lst(CODIFY_DEPS)}, CAST((doc_id + n) % 7 AS INTEGER) + 1) AS dep FROM ce),
codified AS (SELECT doc_id, project, concat(dir, '/doc', CAST(doc_id AS VARCHAR), ext) AS path, n,
                    {CODIFY_CASE} AS text FROM ck),
raw_docs AS (SELECT project, path,
                    string_agg(text, chr(10) ORDER BY n) || CASE WHEN doc_id % 2 = 1 THEN chr(10) ELSE '' END AS content,
                    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS mtime
             FROM codified GROUP BY project, path, doc_id),
raw_pages AS (SELECT 'web' AS project, concat('page', CAST(page_id AS VARCHAR), '.js') AS path, html AS content,
                     TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(page_id AS BIGINT)) AS mtime FROM pages),
langs AS (SELECT * FROM (VALUES {LANG_VALUES}) AS t(ext, language)),
raw_all AS (SELECT * FROM raw_docs UNION ALL SELECT * FROM raw_pages),
files_all AS (SELECT r.project, r.path, g.ext, g.language, r.content, CAST(strlen(r.content) AS BIGINT) AS size, r.mtime
              FROM raw_all r JOIN langs g ON g.ext = lower(regexp_extract(r.path, '[^/](\\.[^./]+)$', 1))
              WHERE NOT list_has_any(string_split(r.path, '/'), {EXCLUDES})),
files AS (SELECT * FROM files_all),
docfiles AS (SELECT * FROM files_all WHERE project <> 'web'),
la AS (SELECT project, path, language, string_split(content, chr(10)) AS a FROM files),
lu AS (SELECT project, path, language, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS raw, len(a) AS cnt FROM la),
lines AS (SELECT project, path, language, CAST(n AS INTEGER) AS n, replace(raw, chr(13), '') AS text
          FROM lu WHERE NOT (n = cnt AND raw = ''))
"""


def q(name: str, body: str, extra: str = ""):
    ctes = BASE + ("," + extra if extra else "")
    SQL[name] = f"WITH RECURSIVE {ctes}\n{body}"


# ------------------------------------------------------------------ shared SQL expressions
def style(lang: str) -> str:
    parts = " ".join(f"WHEN {lang} IN ({', '.join(s(x) for x in langs)}) THEN '{st}'"
                     for st, langs in fixed.COMMENT_STYLES.items())
    return f"(CASE {parts} ELSE 'slash' END)"


def ltrim_ws(t: str) -> str:
    return f"ltrim({t}, ' ' || chr(9))"


def cobol(t: str) -> str:
    return "(" + " OR ".join(f"(strlen(left({t}, {k})) = 6 AND substr({t}, {k + 1}, 1) = '*')" for k in range(1, 7)) + ")"


def line_comment(st: str, lang: str, t: str, tr: str) -> str:
    sw = lambda p: f"starts_with({tr}, {s(p)})"
    return (f"(CASE WHEN {st} = 'cobol' THEN {cobol(t)} WHEN {st} = 'asterisk' THEN {sw('*')} "
            f"WHEN {st} = 'jcl' THEN {sw('//*')} WHEN {st} = 'hash' THEN {sw('#')} "
            f"WHEN {st} = 'dash' THEN ({sw('--')} OR ({lang} = 'Haskell' AND {sw('{-')})) "
            f"WHEN {st} = 'bang' THEN {sw('!')} WHEN {st} = 'apostrophe' THEN {sw(chr(39))} "
            f"WHEN {st} = 'percent' THEN {sw('%')} WHEN {st} = 'semicolon' THEN {sw(';')} "
            f"WHEN {st} = 'block' THEN {sw('/*')} "
            f"ELSE ({sw('/*')} OR {sw('//')} OR {sw('* ')}) END)")


def close_tok(lang: str) -> str:
    return f"(CASE WHEN {lang} = 'Haskell' THEN '-}}' ELSE '*/' END)"


def opens(st: str, lang: str, tr: str) -> str:
    return (f"(({st} IN ('slash', 'block') AND starts_with({tr}, '/*') AND NOT contains({tr}, '*/')) OR "
            f"({lang} = 'Haskell' AND starts_with({tr}, '{{-') AND NOT contains({tr}, '-}}')))")


def kw_count(col: str, kws: list[str]) -> str:
    if not kws:
        return "CAST(0 AS BIGINT)"
    return f"CAST(len(regexp_extract_all({col}, {s(keyword_regex_re2(kws))})) AS BIGINT)"


def substr_count(col: str, needle: str) -> str:
    return f"CAST((length({col}) - length(replace({col}, {s(needle)}, ''))) // {len(needle)} AS BIGINT)"


def decisions(col: str, lang: str) -> str:
    base = f"{kw_count(col, fixed.UNIVERSAL_DECISION_KEYWORDS)} + {substr_count(col, '&&')} + {substr_count(col, '||')}"
    whens = []
    table = {}
    for L, kws in fixed.EXTRA_DECISION_KEYWORDS.items():
        e = kw_count(col, kws)
        if L in fixed.AND_OR_LANGUAGES:
            e += " + " + kw_count(col, ["and", "or"])
        table[L] = e
    for L in fixed.AND_OR_LANGUAGES:
        table.setdefault(L, kw_count(col, ["and", "or"]))
    for L, e in table.items():
        whens.append(f"WHEN {lang} = {s(L)} THEN {e}")
    return f"({base} + (CASE {' '.join(whens)} ELSE 0 END))"


def functions_raw(col: str, lang: str) -> str:
    whens = []
    for L, kws in fixed.FUNCTION_KEYWORDS.items():
        if L == "D":
            whens.append(f"WHEN {lang} = {s(L)} THEN 0")
            continue
        e = kw_count(col, kws)
        if L in fixed.FUNCTION_BONUS:
            e = f"({e} + {fixed.FUNCTION_BONUS[L]})"
        whens.append(f"WHEN {lang} = {s(L)} THEN {e}")
    cfam = f"CAST(len(regexp_extract_all({col}, {s(r'\([^)]*\)[ \t\r\n]*\{')})) AS BIGINT)"
    return f"(CASE {' '.join(whens)} ELSE {cfam} END)"


NO_BRACE = ", ".join(s(x) for x in fixed.NO_BRACE_NESTING)

# per-file line breakdown (window form of the block automaton) + metrics
METRIC_CTES = f"""
lf AS (SELECT l.*, {ltrim_ws('l.text')} AS tr, {style('l.language')} AS st FROM lines l),
lm AS (SELECT *, CASE WHEN tr = '' THEN NULL WHEN contains(tr, {close_tok('language')}) THEN false
                      WHEN {opens('st', 'language', 'tr')} THEN true ELSE NULL END AS marker FROM lf),
lb AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY project, path ORDER BY n
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_block FROM lm),
lc AS (SELECT project, path, language, n, text,
              CASE WHEN tr = '' THEN 'blank' WHEN in_block OR {line_comment('st', 'language', 'text', 'tr')} THEN 'comment'
                   ELSE 'code' END AS kind, strlen(text) > 120 AS is_long FROM lb),
lcount AS (SELECT project, path, count(*) AS n_lines, count(*) FILTER (WHERE kind = 'code') AS code,
                  count(*) FILTER (WHERE kind = 'comment') AS cmt, count(*) FILTER (WHERE kind = 'blank') AS blank,
                  count(*) FILTER (WHERE is_long) AS lng FROM lc GROUP BY project, path),
bd AS (SELECT f.project, f.path, f.language, f.content, f.mtime,
              CAST(coalesce(c.n_lines, 0) + ph AS BIGINT) AS total_lines, CAST(coalesce(c.code, 0) AS BIGINT) AS code_lines,
              CAST(coalesce(c.cmt, 0) AS BIGINT) AS comment_lines, CAST(coalesce(c.blank, 0) + ph AS BIGINT) AS blank_lines,
              CAST(coalesce(c.lng, 0) AS BIGINT) AS long_lines
       FROM (SELECT *, CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS ph FROM files) f
       LEFT JOIN lcount c ON c.project = f.project AND c.path = f.path),
br0 AS (SELECT project, path, string_split(regexp_replace(content, '[^{{}}]', '', 'g'), '') AS ch FROM files
        WHERE language <> 'Python' AND language NOT IN ({NO_BRACE})),
br1 AS (SELECT project, path, unnest(range(1, len(ch) + 1)) AS i, unnest(ch) AS c FROM br0),
br2 AS (SELECT project, path, i, sum(CASE WHEN c = '{{' THEN 1 WHEN c = '}}' THEN -1 ELSE 0 END)
               OVER (PARTITION BY project, path ORDER BY i ROWS UNBOUNDED PRECEDING) AS sc FROM br1),
br3 AS (SELECT project, path, sc - least(0, min(sc) OVER (PARTITION BY project, path ORDER BY i ROWS UNBOUNDED PRECEDING)) AS d FROM br2),
brace AS (SELECT project, path, CAST(max(d) AS BIGINT) AS depth FROM br3 GROUP BY project, path),
py0 AS (SELECT project, path, unnest(string_split(content, chr(10))) AS l FROM files WHERE language = 'Python'),
py1 AS (SELECT project, path, regexp_extract(l, '^[ \\t]*', 0) AS lead FROM py0),
indent AS (SELECT project, path, CAST(max(floor((length(lead) + 3 * (length(lead) - length(replace(lead, chr(9), '')))) / 4)) AS BIGINT) AS depth
           FROM py1 GROUP BY project, path),
fm AS (SELECT b.project, b.path, b.language, b.mtime, b.total_lines, b.code_lines, b.comment_lines, b.blank_lines,
              {functions_raw('b.content', 'b.language')} AS fn_raw,
              CAST({decisions('b.content', 'b.language')} + 1 AS BIGINT) AS cyclomatic,
              CAST(CASE WHEN b.language = 'Python' THEN coalesce(ix.depth, 0)
                        WHEN b.language IN ({NO_BRACE}) THEN 0 ELSE coalesce(br.depth, 0) END AS BIGINT) AS max_nesting,
              b.long_lines, b.content
       FROM bd b LEFT JOIN brace br ON br.project = b.project AND br.path = b.path
       LEFT JOIN indent ix ON ix.project = b.project AND ix.path = b.path),
metrics AS (SELECT project, path, language, mtime, total_lines, code_lines, comment_lines, blank_lines,
                   CAST(CASE WHEN fn_raw = 0 AND code_lines > 0 THEN 1 ELSE fn_raw END AS BIGINT) AS functions,
                   cyclomatic, max_nesting, long_lines, content FROM fm)
"""

# ------------------------------------------------------------------ rules
def _not_prefix(prefix: str, cls_neg: str) -> str:
    """RE2 alternatives for a non-empty run of [^cls_neg] chars that does not
    start with `prefix` (the run is followed by a closing quote)."""
    esc = lambda c: "\\" + c if not c.isalnum() else c
    alts = []
    for i in range(len(prefix)):
        head = "".join(esc(c) for c in prefix[:i])
        alts.append(f"{head}[^{cls_neg}{esc(prefix[i])}][^{cls_neg}]*")
        if i >= 1:
            alts.append(head)
    return "(?:" + "|".join(alts) + ")"


def _rule10_re2() -> str:
    K = r"\s\"'"
    a = r"/(?:etc|usr|home|opt|tmp|root|srv|proc|sys|mnt)/[^\s\"']+"
    b = "/var/" + _not_prefix("run/secrets/kubernetes.io/", K)
    c = r"/[a-z0-9_.\-]+(?:/[a-z0-9_.\-]+)+\.[a-z0-9]{1,6}"   # look-ahead of this branch dropped (see README)
    d = r"[a-z]:\\\\[^\"'\s]+"
    inner = f"(?:{a}|{b}|{c}|{d})"
    return f"\"{inner}\"|'{inner}'"


def _rule28_re2() -> str:
    ws = r"\s*(?:[^\s(]|$)"            # not followed by optional blanks and '('

    def chain(word: str) -> str:        # word[0] matched; rest must not complete word + ws + '('
        out = ws
        for ch in reversed(word[1:]):
            out = f"(?:$|[^{ch}]|{ch}{out})"
        return out

    e_tail = f"(?:$|[^sn]|s(?:$|[^c]|c{ws})|n{chain('ncodeURI')[0:0]}" + \
        "(?:$|[^c]|c(?:$|[^o]|o(?:$|[^d]|d(?:$|[^e]|e(?:$|[^U]|U(?:$|[^R]|R(?:$|[^I]))))))))"
    alts = ["[a-df-su-zA-MO-RT-Z_$]", f"t{ws}", f"S{chain('String')}", f"N{chain('Number')}", f"e{e_tail}"]
    return r"\.innerHTML\s*=.*\+\s*(?:" + "|".join(alts) + ")"


def rule_re2(rid: str, pattern: str) -> str:
    if rid in fixed.RE2_RULE_FORMS:
        return fixed.RE2_RULE_FORMS[rid]
    if rid == "CHG-MAGIC-PATH":
        return _rule10_re2()
    if rid == "SEC-XSS-INNERHTML":
        return _rule28_re2()
    return pattern


def rules_values(only_enabled: bool = True) -> str:
    rows = []
    for (o, rid, title, cwe, sev, fac, mins, en, pat) in fixed.RULES:
        if only_enabled and not en:
            continue
        rows.append(f"({o}, {s(rid)}, {s(title)}, {s(cwe)}, {s(sev)}, {s(fac)}, {mins}, {str(en).lower()}, {s(rule_re2(rid, pat))})")
    return ("(SELECT * FROM (VALUES " + ", ".join(rows) +
            ") AS t(rule_ord, rule_id, title, cwe, severity, factor, remediation_minutes, enabled, re2))")


MARK = s(ScanConfig().suppress_marker)
PLATFORM = " OR ".join(f"contains(d, {s(t)})" for t in ["_WIN32", "__APPLE__", "__linux__", "_MSC_VER", "__GNUC__", "defined("])

RULE_CTES = f"""
rules_t AS {rules_values()},
cand AS (SELECT l.project, l.path, l.n AS line, r.rule_ord, r.rule_id, r.title, r.cwe, r.severity, r.factor,
                CAST(r.remediation_minutes AS INTEGER) AS remediation_minutes,
                substr({ltrim_ws('l.text')}, 1, 160) AS snippet,
                concat_ws(':', l.project, r.rule_id, l.path, CAST(l.n AS VARCHAR)) AS key, l.text AS full_text
         FROM lines l JOIN rules_t r ON regexp_matches(l.text, r.re2)
         WHERE NOT (contains(l.text, {MARK}) AND contains(l.text, r.rule_id))),
dir0 AS (SELECT project, path, n, regexp_extract(text, '^[ \\t]*#[ \\t]*(.*)$', 1) AS d FROM lines
         WHERE regexp_matches(text, '^[ \\t]*#')),
dir1 AS (SELECT project, path, n, d,
                CASE WHEN starts_with(d, 'ifdef') THEN 'push' WHEN starts_with(d, 'ifndef') THEN 'push'
                     WHEN starts_with(d, 'if') THEN 'push' WHEN starts_with(d, 'elif') THEN 'elif'
                     WHEN starts_with(d, 'else') THEN 'else' WHEN starts_with(d, 'endif') THEN 'endif' END AS op,
                CASE WHEN contains(d, '_WIN32') THEN
                     (CASE WHEN starts_with(d, 'ifdef') THEN 1 WHEN starts_with(d, 'ifndef') THEN 2
                           WHEN contains(d, '!') THEN 2 ELSE 1 END) ELSE 0 END AS frame,
                ({PLATFORM}) AS plat
         FROM dir0),
dirs AS (SELECT project, path, CAST(n AS INTEGER) AS n, op, frame, plat,
                row_number() OVER (PARTITION BY project, path ORDER BY n) AS rn
         FROM dir1 WHERE op IS NOT NULL),
gstate(project, path, rn, n, stack, depth) AS (
  SELECT DISTINCT project, path, CAST(0 AS BIGINT), 0, CAST([] AS INTEGER[]), 0 FROM dirs
  UNION ALL
  SELECT g.project, g.path, d.rn, d.n,
         CASE WHEN d.op = 'push' THEN list_append(g.stack, d.frame)
              WHEN d.op = 'elif' AND len(g.stack) > 0 THEN list_append(g.stack[1:len(g.stack) - 1], 0)
              WHEN d.op = 'else' AND len(g.stack) > 0 AND g.stack[len(g.stack)] IN (1, 2)
                   THEN list_append(g.stack[1:len(g.stack) - 1], 3 - g.stack[len(g.stack)])
              WHEN d.op = 'endif' AND len(g.stack) > 0 THEN g.stack[1:len(g.stack) - 1]
              ELSE g.stack END,
         CASE WHEN d.op = 'push' AND d.plat THEN g.depth + 1
              WHEN d.op = 'endif' AND len(g.stack) > 0 THEN greatest(g.depth - 1, 0)
              ELSE g.depth END
  FROM gstate g JOIN dirs d ON d.project = g.project AND d.path = g.path AND d.rn = g.rn + 1),
gs AS (SELECT project, path, n, list_contains(stack, 1) AS in_win, list_contains(stack, 2) AS in_posix, depth > 0 AS in_platform,
              lead(n) OVER (PARTITION BY project, path ORDER BY rn) AS next_n FROM gstate WHERE rn > 0),
regions AS (SELECT project, path, n AS from_line, CAST(coalesce(next_n - 1, {2**31 - 1}) AS INTEGER) AS to_line,
                   in_win, in_posix, in_platform FROM gs WHERE in_win OR in_posix OR in_platform),
issues AS (SELECT c.* FROM cand c WHERE NOT EXISTS (
             SELECT 1 FROM regions g WHERE g.project = c.project AND g.path = c.path
               AND c.line BETWEEN g.from_line AND g.to_line
               AND ((starts_with(c.rule_id, 'PORT-WIN') AND g.in_win) OR (starts_with(c.rule_id, 'PORT-POSIX') AND g.in_posix)
                    OR (c.rule_id IN ('CHG-MAGIC-PATH', 'SEC-SYSTEM-CALL') AND g.in_platform))))
"""


# ================================================================== queries, steps 1-7
FACTORS = fixed.FACTORS

q("documents_as_files",
  "SELECT project, path, ext, language, content, size, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS mtime FROM docfiles")
q("pages_as_files", "SELECT project, path, ext, language, size FROM files WHERE project = 'web'")
q("detect_language",
  "SELECT project, language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY project, language")
q("scan_exclude",
  f"""SELECT project, path FROM (
  SELECT project, path FROM raw_docs
  UNION ALL SELECT project, 'vendor/' || path FROM raw_docs WHERE TRY_CAST(regexp_extract(path, 'doc([0-9]+)', 1) AS BIGINT) % 10 = 9
  UNION ALL SELECT project, path || '.txt' FROM raw_docs WHERE TRY_CAST(regexp_extract(path, 'doc([0-9]+)', 1) AS BIGINT) % 12 = 11) x
WHERE NOT list_has_any(string_split(path, '/'), {EXCLUDES})""")
q("multi_project_sources", """
SELECT project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT project, size FROM files
  UNION ALL
  SELECT 'chat' AS project, CAST(strlen(content) AS BIGINT) AS size FROM conv_files) t
GROUP BY project""", """
conv_files AS (SELECT conv_id, turn, concat('# ', role, chr(10), text) AS content FROM conversations)""")
q("explode_lines", "SELECT project, path, n, text FROM lines")
q("source_order", "SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) AS ord FROM files")

# step 2
q("line_class", "SELECT project, path, language, n, kind, is_long FROM lc", METRIC_CTES)
q("block_comment_state", """
SELECT project, language, count(*) FILTER (WHERE kind = 'comment') AS comment_lines,
       count(*) FILTER (WHERE kind = 'code') AS code_lines, count(*) FILTER (WHERE kind = 'blank') AS blank_lines
FROM lc GROUP BY project, language""", METRIC_CTES)
q("comment_line", f"""
SELECT project, path, n FROM (SELECT *, {ltrim_ws('text')} AS tr, {style('language')} AS st FROM lines) x
WHERE tr <> '' AND {line_comment('st', 'language', 'text', 'tr')}""")
q("is_blank", f"SELECT project, count(*) AS blank_lines FROM lines WHERE {ltrim_ws('text')} = '' GROUP BY project")
q("is_long_line", "SELECT project, path, n, CAST(strlen(text) AS BIGINT) AS bytes FROM lines WHERE strlen(text) > 120")
q("file_line_breakdown",
  "SELECT project, path, language, total_lines, code_lines, comment_lines, blank_lines, long_lines FROM bd", METRIC_CTES)
q("lines_by_language",
  "SELECT project, language, CAST(sum(code_lines) AS BIGINT) AS code_lines FROM bd GROUP BY project, language", METRIC_CTES)
q("comment_ratio", f"""
SELECT project, {r6('CASE WHEN sum(total_lines) > 0 THEN sum(comment_lines) / sum(total_lines) ELSE 0.0 END')} AS comment_ratio
FROM bd GROUP BY project""", METRIC_CTES)

# step 3
q("count_keyword", "SELECT project, path, " + ", ".join(
    f"{kw_count('content', [k])} AS kw_{k}" for k in fixed.UNIVERSAL_DECISION_KEYWORDS) + " FROM files")
q("count_substr", f"SELECT project, path, {substr_count('content', '&&')} AS and_ops, {substr_count('content', '||')} AS or_ops FROM files")
q("cyclomatic", f"SELECT project, path, CAST({decisions('content', 'language')} + 1 AS BIGINT) AS cyclomatic FROM files")
q("functions", "SELECT project, path, functions FROM metrics", METRIC_CTES)
q("nesting_braces", "SELECT project, path, max_nesting FROM metrics WHERE language <> 'Python'", METRIC_CTES)
q("nesting_indent", "SELECT project, path, max_nesting FROM metrics WHERE language = 'Python'", METRIC_CTES)
q("file_metrics", """SELECT project, path, language, total_lines, code_lines, comment_lines, blank_lines, functions,
                     cyclomatic, max_nesting, long_lines FROM metrics""", METRIC_CTES)
TOTALS = """
totals AS (SELECT project, count(*) AS file_count, CAST(sum(total_lines) AS BIGINT) AS total_lines,
                  CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(comment_lines) AS BIGINT) AS comment_lines,
                  CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(functions) AS BIGINT) AS total_functions,
                  CAST(sum(cyclomatic) AS BIGINT) AS total_cyclomatic, CAST(max(cyclomatic) AS BIGINT) AS max_complexity
           FROM metrics GROUP BY project),
totals2 AS (SELECT *, CASE WHEN total_lines > 0 THEN comment_lines / total_lines ELSE 0.0 END AS comment_ratio,
                   CASE WHEN file_count > 0 THEN total_cyclomatic / greatest(total_functions, 1) ELSE 0.0 END AS avg_complexity
            FROM totals)"""
q("project_totals", """SELECT project, file_count, total_lines, code_lines, comment_lines, blank_lines, total_functions,
                       total_cyclomatic, max_complexity FROM totals""", METRIC_CTES + "," + TOTALS)
q("avg_complexity", f"SELECT project, {r6('avg_complexity')} AS avg_complexity FROM totals2", METRIC_CTES + "," + TOTALS)

# step 4
ISSUE_SEL = "project, path, line, rule_id, title, cwe, severity, factor, remediation_minutes, snippet, key"
q("apply_rules", f"SELECT {ISSUE_SEL} FROM cand", RULE_CTES)
q("join_rules", f"SELECT {ISSUE_SEL} FROM cand", RULE_CTES)
q("rule_line_guard",
  f"SELECT project, count(*) AS skipped_lines FROM lines WHERE strlen(text) > 2000 GROUP BY project")
q("rule_enabled", f"""
SELECT r.rule_id, r.enabled, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits
FROM {rules_values(only_enabled=False)} r LEFT JOIN (SELECT rule_id, count(*) AS hits FROM cand GROUP BY rule_id) h
ON h.rule_id = r.rule_id""", RULE_CTES)
q("guard_regions", "SELECT project, path, from_line, to_line, in_win, in_posix, in_platform FROM regions", RULE_CTES)
q("suppress_guard",
  "SELECT project, path, line, rule_id FROM cand WHERE key NOT IN (SELECT key FROM issues)", RULE_CTES)
q("join_guard_regions", "SELECT project, rule_id, count(*) AS issues FROM issues GROUP BY project, rule_id", RULE_CTES)
q("snippet", "SELECT key, snippet FROM issues", RULE_CTES)
q("file_issue_count", """
SELECT m.project, m.path, CAST(coalesce(c.n, 0) AS BIGINT) AS issues
FROM files m LEFT JOIN (SELECT project, path, count(*) AS n FROM issues GROUP BY project, path) c
ON c.project = m.project AND c.path = m.path""", RULE_CTES)

# step 5
K = ScanConfig().duplication_block_lines
NORM = "regexp_replace(regexp_replace(text, '[ \\t\\r]+', ' ', 'g'), '^ | $', '', 'g')"
DUP_CTES = f"""
nl AS (SELECT project, path, n, {NORM} AS t FROM lines),
nk AS (SELECT project, path, n, t, row_number() OVER (PARTITION BY project, path ORDER BY n) AS k FROM nl WHERE t <> ''),
bw AS (SELECT project, path, n AS line,
              concat_ws(chr(10), t, {', '.join(f'lead(t, {i}) OVER w' for i in range(1, K))}) || chr(10) AS blk,
              lead(t, {K - 1}) OVER w AS last_t
       FROM nk WINDOW w AS (PARTITION BY project, path ORDER BY k)),
blocks AS (SELECT project, path, CAST(line AS INTEGER) AS line, blk FROM bw WHERE last_t IS NOT NULL),
bcount AS (SELECT project, blk, count(*) AS occurrences, min(struct_pack(path := path, line := line)) AS first
           FROM blocks GROUP BY project, blk)"""
q("normalize_line", f"SELECT project, path, n, {NORM} AS norm FROM lines")
q("duplicate_window", """
SELECT b.project, b.path, b.line, c.occurrences FROM blocks b JOIN bcount c ON c.project = b.project AND c.blk = b.blk
WHERE c.occurrences >= 2""", DUP_CTES)
q("duplicate_blocks", """
SELECT project, count(*) FILTER (WHERE occurrences >= 2) AS duplicate_blocks, count(*) AS distinct_blocks
FROM bcount GROUP BY project""", DUP_CTES)
q("block_hash", "SELECT project, occurrences, count(*) AS blocks FROM bcount GROUP BY project, occurrences", DUP_CTES)
q("duplicate_groups", """
SELECT project, group_rank, occurrences, listed, locations FROM (
  SELECT c.project, c.occurrences,
         row_number() OVER (PARTITION BY c.project ORDER BY c.occurrences DESC, c.first.path, c.first.line) AS group_rank,
         CAST(least(c.occurrences, 20) AS INTEGER) AS listed,
         (SELECT string_agg(concat(x.path, ':', CAST(x.line AS VARCHAR)), ',' ORDER BY x.path, x.line)
          FROM (SELECT b.path, b.line FROM blocks b WHERE b.project = c.project AND b.blk = c.blk
                ORDER BY b.path, b.line LIMIT 20) x) AS locations
  FROM bcount c WHERE c.occurrences >= 2) g
WHERE group_rank <= 100""", DUP_CTES)

# step 6
DEP_LINE = f"""CASE
  WHEN starts_with(tt, '#include') THEN
       (CASE WHEN contains(tt, '<') THEN regexp_extract(tt, '^[^<]*<([^>]*)>', 1) ELSE regexp_extract(tt, '^[^"]*"([^"]*)"', 1) END)
  WHEN starts_with(tt, 'import ') OR starts_with(tt, 'from ') THEN regexp_extract(tt, '^(?:import|from) ([^ \\t;]*)', 1)
  WHEN contains(tt, 'require(') THEN coalesce(nullif(regexp_extract(tt, '^[^'']*''([^'']*)''', 1), ''),
                                              regexp_extract(tt, '^[^"]*"([^"]*)"', 1))
  END"""
TECH_VALUES = ", ".join(f"({i}, {s(tok)}, {s(name)}, {s(cat)})" for i, (tok, name, cat) in enumerate(fixed.TECHNOLOGIES))
DEP_CTES = f"""
dl AS (SELECT project, path, n, nullif({DEP_LINE}, '') AS dependency FROM (SELECT *, {ltrim_ws('text')} AS tt FROM lines) x),
fdeps AS (SELECT DISTINCT project, path, dependency FROM dl WHERE dependency IS NOT NULL),
fdeps_n AS (SELECT project, path, dependency, row_number() OVER (PARTITION BY project, path ORDER BY dependency) AS di FROM fdeps),
pats AS (SELECT * FROM (VALUES {TECH_VALUES}) AS t(pi, token, name, category)),
tfold(project, path, di, taken, name, category) AS (
  SELECT DISTINCT project, path, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM fdeps_n
  UNION ALL
  SELECT f.project, f.path, d.di,
         CASE WHEN m.name IS NULL THEN f.taken ELSE list_append(f.taken, m.name) END, m.name, m.category
  FROM tfold f JOIN fdeps_n d ON d.project = f.project AND d.path = f.path AND d.di = f.di + 1
  LEFT JOIN LATERAL (SELECT p.name, p.category FROM pats p
                     WHERE contains(lower(d.dependency), p.token) AND NOT list_contains(f.taken, p.name)
                     ORDER BY p.pi LIMIT 1) m ON true),
ftech AS (SELECT project, path, di, name, category FROM tfold WHERE name IS NOT NULL),
inventory AS (SELECT project, name, category, count(*) AS file_count FROM ftech GROUP BY project, name, category)"""
q("extract_dependency", "SELECT project, path, n, dependency FROM dl WHERE dependency IS NOT NULL", DEP_CTES)
q("distinct_dependencies",
  "SELECT project, path, string_agg(dependency, ',' ORDER BY dependency) AS dependencies FROM fdeps GROUP BY project, path",
  DEP_CTES)
q("technology_fold",
  "SELECT project, path, string_agg(name, ',' ORDER BY di) AS technologies FROM ftech GROUP BY project, path", DEP_CTES)
q("technology_inventory", "SELECT project, name, category, file_count FROM inventory", DEP_CTES)
q("technology_by_category", """
SELECT project, category, sum(file_count) AS file_count,
       string_agg(concat(name, ':', CAST(file_count AS VARCHAR)), ',' ORDER BY file_count DESC, name) AS technologies
FROM inventory GROUP BY project, category""", DEP_CTES)
SPDX = "regexp_replace(regexp_extract(text, '(?i)SPDX-LICENSE-IDENTIFIER:[ \\t]*(.*)', 1), '[\\r\\n */]+$', '')"
LIC_CTES = f"""
lh AS (SELECT project, path, n, {SPDX} AS spdx,
              regexp_matches(text, '(?i)(COPYRIGHT|@LICENSE|@COPYRIGHT)') AS cr FROM lines WHERE n <= 20),
lic AS (SELECT f.project, f.path, s.spdx, coalesce(c.cr, false) AS has_copyright,
               (s.spdx IS NOT NULL OR coalesce(c.cr, false)) AS has_header
        FROM files f
        LEFT JOIN (SELECT project, path, arg_min(spdx, n) AS spdx FROM lh WHERE spdx <> '' GROUP BY project, path) s
               ON s.project = f.project AND s.path = f.path
        LEFT JOIN (SELECT project, path, bool_or(cr) AS cr FROM lh GROUP BY project, path) c
               ON c.project = f.project AND c.path = f.path),
lsum AS (SELECT project, count(*) FILTER (WHERE has_header) AS files_with_header,
                count(*) FILTER (WHERE NOT has_header) AS files_without_header, count(*) AS files FROM lic GROUP BY project)"""
q("spdx_of_line", f"SELECT project, path, n, {SPDX} AS spdx FROM lines WHERE {SPDX} <> ''")
q("has_copyright", "SELECT project, path FROM lic WHERE has_copyright", LIC_CTES)
q("license_first_spdx", "SELECT project, path, spdx FROM lic WHERE spdx IS NOT NULL", LIC_CTES)
q("license_summary", "SELECT project, files_with_header, files_without_header FROM lsum", LIC_CTES)
q("license_spdx_counts", "SELECT project, spdx, count(*) AS files FROM lic WHERE spdx IS NOT NULL GROUP BY project, spdx", LIC_CTES)
q("license_coverage",
  f"SELECT project, {r6('CASE WHEN files > 0 THEN round(100.0 * files_with_header / files) ELSE 0.0 END')} AS coverage_pct FROM lsum",
  LIC_CTES)

# step 7
SC = ScoreConfig()


def _w(sev: str) -> str:
    return (f"CASE WHEN {sev} = 'critical' THEN {SC.w_critical} WHEN {sev} = 'major' THEN {SC.w_major} "
            f"WHEN {sev} = 'minor' THEN {SC.w_minor} ELSE {SC.w_info} END")


def _dens(wcol: str, scale: float) -> str:
    return f"(CASE WHEN code_lines / 1000.0 <= 0 THEN 0.0 ELSE least({SC.density_cap}, {wcol} / (code_lines / 1000.0) * {scale}) END)"


def report_ctes(threshold_expr: str = f"CAST({ScoreConfig().complexity_threshold} AS DOUBLE)") -> str:
    t = threshold_expr
    cx_over = f"(avg_complexity - {t})"
    gap = f"(({SC.comment_min} - comment_ratio) * 100.0)"
    dd = "(duplicate_blocks / code_lines * 1000.0)"
    rob = (f"100.0 - {_dens('w_robustness', SC.scale['robustness'])} - "
           f"(CASE WHEN avg_complexity > {t} THEN least({SC.complexity_rob_cap}, {cx_over} * {SC.complexity_rob_mult}) ELSE 0.0 END)")
    chg = (f"100.0 - {_dens('w_changeability', SC.scale['changeability'])} - "
           f"(CASE WHEN avg_complexity > {t} THEN least({SC.complexity_chg_cap}, {cx_over} * {SC.complexity_chg_mult}) ELSE 0.0 END) - "
           f"(CASE WHEN comment_ratio < {SC.comment_min} THEN least({SC.comment_change_cap}, {gap} * {SC.comment_change_mult}) ELSE 0.0 END) - "
           f"(CASE WHEN duplicate_blocks > 0 AND code_lines > 0 THEN least({SC.dup_change_cap}, {dd} * {SC.dup_change_mult}) ELSE 0.0 END)")
    trn = (f"100.0 - {_dens('w_transferability', SC.scale['transferability'])} - "
           f"(CASE WHEN comment_ratio < {SC.comment_min} THEN least({SC.comment_transfer_cap}, {gap} * {SC.comment_transfer_mult}) ELSE 0.0 END) - "
           f"(CASE WHEN duplicate_blocks > 0 AND code_lines > 0 THEN least({SC.dup_transfer_cap}, {dd} * {SC.dup_transfer_mult}) ELSE 0.0 END)")
    plain = {f: f"100.0 - {_dens('w_' + f, SC.scale[f])}" for f in ["security", "efficiency", "portability"]}
    cl = lambda e: f"greatest(0.0, least(100.0, CAST({e} AS DOUBLE)))"
    roll = ", ".join([f"count(*) AS issue_count", "CAST(sum(remediation_minutes) AS BIGINT) AS debt_minutes"]
                     + [f"count(*) FILTER (WHERE severity = '{x}') AS n_{x}" for x in fixed.SEVERITIES]
                     + [f"sum(CASE WHEN factor = '{f}' THEN {_w('severity')} ELSE 0.0 END) AS w_{f}" for f in FACTORS])
    return f"""
iroll AS (SELECT project, {roll} FROM issues GROUP BY project),
dcount AS (SELECT project, count(*) FILTER (WHERE occurrences >= 2) AS duplicate_blocks FROM bcount GROUP BY project),
rep0 AS (SELECT t.*, coalesce(i.issue_count, 0) AS issue_count, coalesce(i.debt_minutes, 0) AS debt_minutes,
                {', '.join(f'coalesce(i.n_{x}, 0) AS n_{x}' for x in fixed.SEVERITIES)},
                {', '.join(f'coalesce(i.w_{f}, 0.0) AS w_{f}' for f in FACTORS)},
                coalesce(d.duplicate_blocks, 0) AS duplicate_blocks
         FROM totals2 t LEFT JOIN iroll i ON i.project = t.project LEFT JOIN dcount d ON d.project = t.project),
rep1 AS (SELECT *, {cl(rob)} AS robustness, {cl(plain['security'])} AS security, {cl(plain['efficiency'])} AS efficiency,
                {cl(trn)} AS transferability, {cl(chg)} AS changeability, {cl(plain['portability'])} AS portability FROM rep0),
report AS (SELECT *, (robustness + security + efficiency + transferability + changeability + portability) / 6.0 AS tqi,
                  debt_minutes / 60.0 AS debt_hours, debt_minutes / 60.0 * {SC.hourly_rate} AS debt_cost,
                  CASE WHEN code_lines * {SC.dev_minutes_per_line} > 0 THEN debt_minutes / (code_lines * {SC.dev_minutes_per_line})
                       ELSE 0.0 END AS debt_ratio FROM rep1),
graded AS (SELECT *, CASE WHEN tqi >= {SC.grade_a} THEN 'A' WHEN tqi >= {SC.grade_b} THEN 'B' WHEN tqi >= {SC.grade_c} THEN 'C'
                          WHEN tqi >= {SC.grade_d} THEN 'D' ELSE 'F' END AS grade FROM report)"""


REPORT = METRIC_CTES + "," + TOTALS + "," + RULE_CTES + "," + DUP_CTES + "," + report_ctes()
q("severity_counts", """
SELECT project, severity, CAST(count AS BIGINT) AS count FROM (
  SELECT project, 'critical' AS severity, n_critical AS count FROM graded UNION ALL
  SELECT project, 'major', n_major FROM graded UNION ALL SELECT project, 'minor', n_minor FROM graded UNION ALL
  SELECT project, 'info', n_info FROM graded) t""", REPORT)
q("factor_weights", "SELECT project, " + ", ".join(f"{r6('w_' + f)} AS w_{f}" for f in FACTORS) + " FROM graded", REPORT)
q("health_scores", "SELECT project, " + ", ".join(f"{r6(f)} AS {f}" for f in FACTORS) + f", {r6('tqi')} AS tqi FROM graded", REPORT)
q("grade", "SELECT project, grade FROM graded", REPORT)
q("debt_summary", f"""SELECT project, debt_minutes AS total_minutes, {r6('debt_hours')} AS total_hours, {r6('debt_cost')} AS cost,
                     {r6('debt_ratio')} AS debt_ratio FROM graded""", REPORT)
G = GateConfig()
q("quality_gate", f"""
SELECT project, NOT (f_tqi OR f_iss OR f_crit) AS passed,
       CASE WHEN f_crit THEN concat('Critical issues: ', CAST(critical AS VARCHAR))
            WHEN f_iss THEN printf('Issues %d > %d', issues, {G.max_issues})
            WHEN f_tqi THEN printf('TQI %f < %f', tqi, CAST({float(G.min_tqi)} AS DOUBLE)) ELSE '' END AS reason,
       {r6('tqi')} AS tqi, issues, critical
FROM (SELECT project, tqi, issue_count AS issues, n_critical AS critical,
             {str(G.min_tqi > 0).lower()} AND tqi < {G.min_tqi} AS f_tqi,
             {str(G.max_issues >= 0).lower()} AND issue_count > {G.max_issues} AS f_iss,
             {str(G.max_critical >= 0).lower()} AND n_critical > {G.max_critical} AS f_crit FROM graded) g""", REPORT)
q("projects_overview", f"SELECT project, grade, {r6('tqi')} AS tqi, issue_count AS issues FROM graded", REPORT)
q("join_complexity_threshold",
  f"SELECT project, {r6('robustness')} AS robustness, {r6('changeability')} AS changeability, {r6('tqi')} AS tqi FROM graded",
  METRIC_CTES + """,
lover AS (SELECT project, sum(f * greatest(0.0, c / greatest(f, 1) - thr)) / greatest(sum(f), 1) AS complexity_over
          FROM (SELECT project, sum(functions) AS f, sum(cyclomatic) AS c, CASE language """
  + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in LANGUAGE_THRESHOLDS.items())
  + f""" ELSE CAST({ScoreConfig().complexity_threshold} AS DOUBLE) END AS thr FROM metrics GROUP BY project, language) x GROUP BY project),"""
  + TOTALS.replace("FROM totals)", "FROM totals LEFT JOIN lover USING (project))") + "," + RULE_CTES + "," + DUP_CTES + ","
  + report_ctes("(avg_complexity - complexity_over)"))
