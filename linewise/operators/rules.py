"""Rule catalogue, rule application, platform-guard regions and suppression.

apply_rules evaluates every enabled rule on every line as one projection of
literal `rlike` predicates (each pattern compiled once per task), then
explodes the hits: lines never leave their partition.  Guards and their
suppression are folded inside the file row (operators/guards.py); for a table
of lines alone there is an anti join on (project, path) with a line range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise import fixed
from linewise.config import ScanConfig
from linewise.functions.text import issue_key, java_regex, snippet
from linewise.operators import guards
from linewise.operators.lines import lines_array
from linewise.operators.rule_index import necessary_literals, proposer


@dataclass(frozen=True)
class Rule:
    ord: int
    id: str
    title: str
    cwe: str
    severity: str
    factor: str
    minutes: int
    enabled: bool
    pattern: str


CATALOGUE = [Rule(*r) for r in fixed.RULES]

# Prefilter (ours, derived from each pattern): every match of the rule's
# pattern contains at least one of these literals, so a line containing none
# of them skips the regex.  `contains` is a byte search; `And` short-circuits.
PREFILTER: dict[str, list[str]] = {
    "SEC-HARDCODED-SECRET": ["password", "passwd", "secret", "api", "token"],
    "SEC-EVAL": ["eval", "exec"],
    "SEC-WEAK-HASH": ["md5", "sha1"],
    "SEC-WEAK-CIPHER": ["des", "rc4", "ecb"],
    "SEC-SQL-CONCAT": ["select", "insert", "update", "delete"],
    "SEC-SYSTEM-CALL": ["system", "popen", "subprocess"],
    "ROB-EMPTY-CATCH": ["catch"],
    "ROB-TODO": ["todo", "fixme", "hack", "xxx"],
    "EFF-SELECT-STAR": ["select"],
    "CHG-MAGIC-PATH": ['"', "'"],
    "SEC-INSECURE-RANDOM": ["rand"],
    "SEC-PRIVATE-KEY": ["-----BEGIN "],
    "SEC-AWS-KEY": ["AKIA"],
    "SEC-BEARER-TOKEN": ["Bearer"],
    "MISRA-C-15-1": ["goto"],
    "MISRA-C-21-3": ["malloc", "calloc", "realloc", "free"],
    "CERT-MSC32-C": ["rand"],
    "CERT-STR31-C": ["strcpy", "strcat", "gets", "sprintf"],
    "CERT-ERR33-C": ["fopen", "fclose", "fread", "fwrite", "scanf"],
    "PORT-WIN-API": ["#include"],
    "PORT-WIN-TYPES": ["WORD", "HANDLE", "HRESULT", "HWND", "HMODULE", "HINSTANCE", "LPCSTR", "LPSTR",
                       "LPCTSTR", "LPTSTR", "TCHAR"],
    "PORT-WIN-SLEEP": ["Sleep"],
    "PORT-POSIX-FORK": ["fork"],
    "PORT-POSIX-ONLY": ["#include"],
    "PORT-PATH-SEP": [":\\"],
    "PORT-MAX-PATH": ["MAX_PATH"],
    "SEC-XSS-INNERHTML": [".innerHTML"],
    "SEC-PATH-TRAVERSAL": [".."],
    "SEC-PRINTF-FORMAT": ["printf"],
    "ROB-NULL-DEREF": ["->"],
    "EFF-LOOP-INVARIANT": ["for"],
    "TRN-COMMENTED-CODE": ["//"],
    "MISRA-C-14-4": ["while"],
    "CERT-MEM35-C": ["malloc"],
    "CHG-NO-LICENSE": ["SPDX-License-Identifier"],
}


# What else every match of a pattern holds: one literal of each list.
ALSO: dict[str, list[list[str]]] = {
    "SEC-HARDCODED-SECRET": [['"', "'"]],
    "SEC-EVAL": [["("]],
    "SEC-SQL-CONCAT": [["+"], ['"', "'"]],
    "SEC-SYSTEM-CALL": [["("]],
    "ROB-EMPTY-CATCH": [["("], ["}"]],
    "EFF-SELECT-STAR": [["*"]],
    "CHG-MAGIC-PATH": [['"/', "'/", ":\\\\"]],
    "SEC-BEARER-TOKEN": [["."]],
    "PORT-WIN-API": [[".h>"]],
    "PORT-WIN-SLEEP": [["("]],
    "PORT-POSIX-FORK": [["("]],
    "PORT-POSIX-ONLY": [[".h>"]],
    "PORT-PATH-SEP": [['"']],
    "SEC-PATH-TRAVERSAL": [["../", "..\\"]],
    "SEC-PRINTF-FORMAT": [["("]],
    "ROB-NULL-DEREF": [["("], [")"]],
    "EFF-LOOP-INVARIANT": [["("], [";"]],
}

# Rules that share a condition of their matches: where a line does not meet it, none of them is tried.
GATES: list[tuple[str, list[str]]] = [
    (r"\(", ["SEC-EVAL", "SEC-SYSTEM-CALL", "ROB-EMPTY-CATCH", "PORT-WIN-SLEEP", "PORT-POSIX-FORK", "SEC-PRINTF-FORMAT",
             "ROB-NULL-DEREF", "EFF-LOOP-INVARIANT"]),
    (r"[\"']", ["SEC-HARDCODED-SECRET", "SEC-SQL-CONCAT", "CHG-MAGIC-PATH", "PORT-PATH-SEP"]),
    (r"[A-Z]{4}", ["SEC-PRIVATE-KEY", "SEC-AWS-KEY", "PORT-WIN-TYPES", "PORT-MAX-PATH"]),
    (r"#include", ["PORT-WIN-API", "PORT-POSIX-ONLY"]),
]

_SHIPPED = {r.id: r.pattern for r in CATALOGUE}


def _any_literal(text: Column, literals: list[str]) -> Column:
    out = None
    for lit in literals:
        c = F.contains(text, F.lit(lit))
        out = c if out is None else (out | c)
    return out


def _plain(r: Rule, cfg: ScanConfig) -> bool:
    """The literals belong to the shipped pattern: a user's rule that reuses
    an id with another pattern has none."""
    return _SHIPPED.get(r.id) == r.pattern and not cfg.case_insensitive_rules


def prefilter(r: Rule, text: Column, cfg: ScanConfig) -> Column:
    lits = PREFILTER.get(r.id) if _plain(r, cfg) else None
    if not lits:
        return F.lit(True)
    out = _any_literal(text, lits)
    for more in reversed(ALSO.get(r.id, [])):
        out = _any_literal(text, more) & out
    return out


def line_hits(rs: list[Rule], text: Column, cfg: ScanConfig) -> Column:
    """array<struct> of the rules that a line of an array hits, gate by gate.
    The order of the rules is that of the gates; who needs another one sorts."""
    left, parts = list(rs), []
    for pattern, ids in GATES:
        gated = [r for r in left if r.id in ids and _plain(r, cfg)]
        left = [r for r in left if r not in gated]
        if gated:
            hits = F.array_compact(F.array(*[_hit(r, text, cfg) for r in gated]))
            parts.append(F.when(text.rlike(pattern), hits))
    if left:
        parts.append(F.array_compact(F.array(*[_hit(r, text, cfg) for r in left])))
    return F.flatten(F.array_compact(F.array(*parts)))


def select_rules(cfg: ScanConfig = ScanConfig(), rules: list[Rule] | None = None) -> list[Rule]:
    """Enabled rules (disabled ones are defined but not applied), optionally
    restricted to cfg.rule_ids; patterns that java.util.regex rejects are
    dropped (see rejected_rules)."""
    out = []
    for r in rules or CATALOGUE:
        if not r.enabled:
            continue
        if cfg.rule_ids is not None and r.id not in cfg.rule_ids:
            continue
        if pattern_error(java_regex(r.pattern, cfg.case_insensitive_rules)) is None:
            out.append(r)
    return out


def pattern_error(pattern: str) -> str | None:
    """What java.util.regex, which will run the pattern, says against it."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException
    context = SparkContext._active_spark_context
    if context is None:  # no JVM yet: nothing to judge by
        return None
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:  # a PatternSyntaxException, as PySpark raises it
        return str(e)
    except Py4JJavaError as e:
        return str(e.java_exception.getMessage())
    return None


def rejected_rules(rules: list[Rule]) -> list[tuple[str, str]]:
    """(rule id, reason) of every rule whose pattern cannot be compiled."""
    found = ((r.id, pattern_error(java_regex(r.pattern))) for r in rules)
    return [(i, e) for i, e in found if e is not None]


def rule_lines(lines: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The lines that rules see: all, unless the configuration sets a limit."""
    cut = cfg.max_rule_line_length
    return lines.filter(F.octet_length("text") <= cut) if cut else lines


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rows = [(r.ord, r.id, r.title, r.cwe, r.severity, r.factor, r.minutes, r.enabled, r.pattern)
            for r in (rules or CATALOGUE)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, title string, cwe string, severity string, "
                                       "factor string, remediation_minutes int, enabled boolean, pattern string")


def _hit(r: Rule, text: Column, cfg: ScanConfig) -> Column:
    suppressed = F.contains(text, F.lit(cfg.suppress_marker)) & F.contains(text, F.lit(r.id))
    matched = prefilter(r, text, cfg) & text.rlike(java_regex(r.pattern, cfg.case_insensitive_rules))
    info = F.struct(F.lit(r.ord).alias("rule_ord"), F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("title"),
                    F.lit(r.cwe).alias("cwe"), F.lit(r.severity).alias("severity"), F.lit(r.factor).alias("factor"),
                    F.lit(r.minutes).alias("remediation_minutes"))
    return F.when(matched & ~suppressed, info)


ISSUE_COLUMNS = ["project", "path", "line", "rule_ord", "rule_id", "title", "cwe", "severity", "factor",
                 "remediation_minutes", "snippet", "line_hash", "key"]


def apply_rules(lines: DataFrame, cfg: ScanConfig = ScanConfig(), rules: list[Rule] | None = None) -> DataFrame:
    """lines -> candidate issues (before platform-guard suppression).
    At most one issue per (line, rule)."""
    rs = select_rules(cfg, rules)
    text = F.col("text")
    guarded = rule_lines(lines, cfg)
    hits = F.array_compact(F.array(*[_hit(r, text, cfg) for r in rs]))
    df = guarded.select("project", "path", F.col("n").alias("line"), "text", F.explode(hits).alias("r"))
    return df.select("project", "path", "line", "r.*", snippet(text).alias("snippet"),
                     F.xxhash64(text).alias("line_hash"),
                     issue_key(F.col("project"), F.col("r.rule_id"), F.col("path"), F.col("line")).alias("key"))


RULE_BATCH = 5_000          # rules of one index
RULE_BATCH_BYTES = 4 << 20  # and bytes of their patterns


def rule_batches(rules_df: DataFrame) -> Iterator[list]:
    """The enabled rules in batches of bounded size, read one after the other."""
    batch, size = [], 0
    for r in rules_df.filter("enabled").select("rule_ord", "rule_id", "pattern").toLocalIterator():
        if batch and (len(batch) >= RULE_BATCH or size + len(r.pattern or "") > RULE_BATCH_BYTES):
            yield batch
            batch, size = [], 0
        if r.pattern is not None:
            batch.append(r)
            size += len(r.pattern)
    if batch:
        yield batch


def join_rules(lines: DataFrame, rules_df: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Issues of lines by a user's rules table of any size (rule_ord names a rule).

    Rules are taken in batches of bounded size.  An index of the literals that a
    match must hold proposes (line, rule) pairs; those pairs join the rules by
    number and the pattern decides.  Patterns without such a literal are tested
    on every line, as literal predicates compiled once a task.  Patterns that
    java.util.regex rejects match nothing (see rejected_rules)."""
    cols = ["project", "path", "n", "text"]
    guarded = rule_lines(lines, cfg).select(*cols)
    hits = None
    for batch in rule_batches(rules_df):
        sound = [r for r in batch if pattern_error(r.pattern) is None]
        literals = {r.rule_ord: necessary_literals(r.pattern) for r in sound}
        entries = [(w, o) for o, ws in literals.items() for w in ws or ()]
        found = []
        if entries:
            pairs = guarded.mapInPandas(proposer(entries), f"{_schema(guarded)}, proposed array<int>")
            pairs = pairs.select(*cols, F.explode("proposed").alias("rule_ord"))
            # a batch's patterns: at most RULE_BATCH rows and RULE_BATCH_BYTES bytes
            patterns = lines.sparkSession.createDataFrame([(r.rule_ord, r.pattern) for r in sound if literals[r.rule_ord]], "rule_ord int, jpattern string")
            found.append(pairs.join(F.broadcast(patterns), "rule_ord").filter(F.expr("text rlike jpattern")).select(*cols, "rule_ord"))
        for group in _groups([r for r in sound if not literals[r.rule_ord]], 50):
            each = F.array_compact(F.array(*[F.when(F.col("text").rlike(r.pattern), F.lit(r.rule_ord)) for r in group]))
            found.append(guarded.select(*cols, F.explode(each).alias("rule_ord")))
        for f in found:
            hits = f if hits is None else hits.unionByName(f)
    if hits is None:
        hits = guarded.limit(0).withColumn("rule_ord", F.lit(0))
    info = rules_df.filter("enabled").select(F.col("rule_ord").cast("int").alias("rule_ord"), "rule_id", "title", "cwe", "severity", "factor", "remediation_minutes")
    j = hits.join(info, "rule_ord")
    j = j.filter(~(F.contains("text", F.lit(cfg.suppress_marker)) & F.contains("text", F.col("rule_id"))))
    return j.select("project", "path", F.col("n").alias("line"), "rule_ord", "rule_id", "title", "cwe", "severity",
                    "factor", "remediation_minutes", snippet(F.col("text")).alias("snippet"),
                    F.xxhash64("text").alias("line_hash"),
                    issue_key(F.col("project"), F.col("rule_id"), F.col("path"), F.col("n")).alias("key"))


def _groups(items: list, n: int) -> list[list]:
    return [items[i:i + n] for i in range(0, len(items), n)]


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# ------------------------------------------------------------------ guards
def directive_lines(lines: DataFrame) -> DataFrame:
    """Lines whose first non-blank character is '#': (project, path, n, d)
    with d = text after '#', left-trimmed."""
    d = F.regexp_extract("text", r"(?s)^[ \t]*#[ \t]*(.*)\z", 1)
    return (lines.filter(F.col("text").rlike(r"^[ \t]*#"))
                 .select("project", "path", "n", d.alias("d")))


def guard_regions(lines: DataFrame) -> DataFrame:
    """lines -> regions(project, path, from_line, to_line, in_win, in_posix,
    in_platform): line ranges where a suppressing guard state holds.  For tables
    of lines: the (rare) directive lines of a file meet by one exchange.  Where
    the file row is at hand, `file_regions` needs none."""
    d = (directive_lines(lines).groupBy("project", "path")
         .agg(F.sort_array(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "d"))).alias("directives")))
    return guards.with_regions(d)


def file_regions(files: DataFrame) -> DataFrame:
    """The same regions from file rows: a projection."""
    return guards.with_regions(files.select("project", "path", guards.directives(lines_array(F.col("content"))).alias("directives")))


def suppress_guard(issues: DataFrame, regions: DataFrame) -> DataFrame:
    """Drop PORT-WIN* issues in _WIN32-true regions, PORT-POSIX* in
    _WIN32-false regions, CHG-MAGIC-PATH / SEC-SYSTEM-CALL in any platform guard."""
    i, r = issues.alias("i"), regions.alias("r")
    rid = F.col("i.rule_id")
    cond = ((F.col("i.project") == F.col("r.project")) & (F.col("i.path") == F.col("r.path"))
            & F.col("i.line").between(F.col("r.from_line"), F.col("r.to_line"))
            & ((F.startswith(rid, F.lit("PORT-WIN")) & F.col("r.in_win"))
               | (F.startswith(rid, F.lit("PORT-POSIX")) & F.col("r.in_posix"))
               | (rid.isin("CHG-MAGIC-PATH", "SEC-SYSTEM-CALL") & F.col("r.in_platform"))))
    return i.join(r, cond, "left_anti")


def file_issues(lines: DataFrame, cfg: ScanConfig = ScanConfig(), rules: list[Rule] | None = None) -> DataFrame:
    """Issues of a table of lines: rules applied, guard suppression done.  Plans
    that hold file rows take them from plans/facts.py, without a join."""
    return suppress_guard(apply_rules(lines, cfg, rules), guard_regions(lines))


def platform_bucket(rule_id: Column) -> Column:
    return (F.when(F.startswith(rule_id, F.lit("PORT-WIN")), "WIN")
            .when(F.startswith(rule_id, F.lit("PORT-POSIX")), "NIX").otherwise("ALL"))
