"""Scalar column expressions over line / file text.

All of them are built-in Spark expressions on the JVM (higher-order functions are interpreted); nothing
here calls back into Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word characters; \b is rewritten with these so that Java's
# Unicode-aware boundary does not change answers on accented text.
WORD = "A-Za-z0-9_"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


NOT_WORD_BEFORE = f"(?<![{WORD}])"
NOT_WORD_AFTER = f"(?![{WORD}])"


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _group_span(p: str, i: int) -> int:
    """Index of the ')' closing the '(' at i (escapes and classes skipped)."""
    depth, j, in_cls = 0, i, False
    while j < len(p):
        c = p[j]
        if c == "\\":
            j += 2
            continue
        if in_cls:
            in_cls = c != "]"
        elif c == "[":
            in_cls = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return j
        j += 1
    return -1


def _alternatives(body: str) -> list[str]:
    out, depth, cur, j, in_cls = [], 0, "", 0, False
    while j < len(body):
        c = body[j]
        if c == "\\":
            cur += body[j:j + 2]
            j += 2
            continue
        if in_cls:
            in_cls = c != "]"
        elif c == "[":
            in_cls = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(cur)
            cur = ""
            j += 1
            continue
        cur += c
        j += 1
    out.append(cur)
    return out


def _starts_with_word(p: str, i: int) -> bool:
    """Does every match of the pattern text starting at i begin with a word char?"""
    if i >= len(p):
        return False
    if _is_word(p[i]):
        return True
    if p[i] == "(":
        end = _group_span(p, i)
        body = p[i + 1:end]
        if body.startswith("?:"):
            body = body[2:]
        elif body.startswith("?"):
            return False
        return end > 0 and all(a and _is_word(a[0]) for a in _alternatives(body))
    return False


def _ends_with_word(p: str, i: int) -> bool:
    """Does every match of the pattern text ending at index i-1 end with a word char?"""
    if i == 0:
        return False
    c = p[i - 1]
    escaped = i >= 2 and p[i - 2] == "\\"
    if _is_word(c) and not escaped:
        return True
    if c == ")" and not escaped:
        # find the matching '('
        depth, j = 0, i - 1
        while j >= 0:
            if p[j] == ")" and (j == 0 or p[j - 1] != "\\"):
                depth += 1
            elif p[j] == "(" and (j == 0 or p[j - 1] != "\\"):
                depth -= 1
                if depth == 0:
                    break
            j -= 1
        body = p[j + 1:i - 1]
        if body.startswith("?"):
            return False
        return all(a and _is_word(a[-1]) and not (len(a) >= 2 and a[-2] == "\\") for a in _alternatives(body))
    return False


def java_regex(pattern: str, case_insensitive: bool = False) -> str:
    """Rewrite an ECMAScript-style pattern for java.util.regex with ASCII
    word boundaries.  A boundary next to pattern text that must match a word
    character only needs a one-sided look-around (cheaper: Java keeps its
    literal-prefix search); otherwise the two-sided form is used."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt != "b":
                out.append(c + nxt)
            elif _starts_with_word(pattern, i + 2):
                out.append(NOT_WORD_BEFORE)
            elif _ends_with_word(pattern, i):
                out.append(NOT_WORD_AFTER)
            else:
                out.append(BOUNDARY)
            i += 2
            continue
        out.append(c)
        i += 1
    body = "".join(out)
    return ("(?i)" + body) if case_insensitive else body


def _quote(kw: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch not in " _" else ch for ch in kw)


def keyword_regex(keywords: list[str]) -> str:
    """Whole-word alternation; an edge that is not a word character needs no
    boundary of its own (e.g. '->' is bounded by the look-arounds directly).
    The class of first characters comes first: at most places it settles the
    test, before the look-behind and the alternatives are tried."""
    alts = "|".join(_quote(k) for k in keywords)
    first = "".join(sorted({_quote(k[0]) for k in keywords}))
    return f"(?=[{first}])(?<![{WORD}])(?:{alts})(?![{WORD}])"


def keyword_regex_re2(keywords: list[str]) -> str:
    """RE2 form for the DuckDB oracle: \\b around word edges, \\B around non-word
    edges (\\B before '-' holds exactly when the previous byte is not a word char)."""
    parts = []
    for k in keywords:
        left = "\\b" if (k[0].isalnum() or k[0] == "_") else "\\B"
        right = "\\b" if (k[-1].isalnum() or k[-1] == "_") else "\\B"
        parts.append(f"{left}{_quote(k)}{right}")
    return "|".join(parts)


def count_regex(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


def count_keywords(col: Column, keywords: list[str]) -> Column:
    """Whole-word occurrences of any keyword (case-sensitive, ASCII boundaries).
    Distinct whole-word matches cannot overlap, so one alternation equals the
    sum of per-keyword counts."""
    if not keywords:
        return F.lit(0).cast("long")
    return count_regex(col, keyword_regex(keywords))


def count_substr(col: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def strip_cr(col: Column) -> Column:
    return F.replace(col, F.lit("\r"), F.lit(""))


def ltrim_ws(col: Column) -> Column:
    """Remove leading spaces and tabs only."""
    return F.ltrim(col, F.lit(" \t"))


def is_blank(col: Column) -> Column:
    return ltrim_ws(col) == ""


def normalize_line(col: Column) -> Column:
    """Collapse space/tab/CR runs to one space; trim both ends.
    Only a line with a tab, a CR or two spaces in a row needs the pattern."""
    runs = F.contains(col, F.lit("  ")) | F.contains(col, F.lit("\t")) | F.contains(col, F.lit("\r"))
    return F.trim(F.when(runs, F.regexp_replace(col, r"[ \t\r]+", " ")).otherwise(col))


def snippet(col: Column, n: int = 160) -> Column:
    return F.substring(ltrim_ws(col), 1, n)


def spdx_of_line(col: Column) -> Column:
    """Text after 'SPDX-License-Identifier:' (ASCII case-insensitive) with
    leading blanks and trailing space, CR, LF, '*' and '/' removed; '' if none."""
    raw = F.regexp_extract(col, r"(?i)SPDX-LICENSE-IDENTIFIER:[ \t]*([^\n]*)", 1)
    return F.regexp_replace(raw, r"[\r\n */]+\z", "")


def has_copyright(col: Column) -> Column:
    up = F.upper(col)
    return F.contains(up, F.lit("COPYRIGHT")) | F.contains(up, F.lit("@LICENSE"))


def header_of(content: Column, lines: Column) -> tuple[Column, Column]:
    """(first SPDX identifier, whether there is a copyright) of a file's leading lines.
    A text that holds a mark nowhere, in any case, has it in none of its lines."""
    up = F.upper(strip_cr(content))
    named = F.contains(up, F.lit("SPDX-LICENSE-IDENTIFIER:"))
    marked = F.contains(up, F.lit("COPYRIGHT")) | F.contains(up, F.lit("@LICENSE"))
    spdx = F.when(named, F.get(F.filter(F.transform(lines, spdx_of_line), lambda s: s != ""), 0))
    return spdx, F.when(~marked, False).otherwise(F.exists(lines, has_copyright))


def issue_key(project: Column, rule_id: Column, path: Column, line: Column) -> Column:
    """Identity of an issue: projects share one table, so the project is part of it."""
    return F.concat_ws(":", project, rule_id, path, line.cast("string"))


def iso_ts(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def grade(tqi: Column, cfg) -> Column:
    return (F.when(tqi >= cfg.grade_a, "A").when(tqi >= cfg.grade_b, "B")
            .when(tqi >= cfg.grade_c, "C").when(tqi >= cfg.grade_d, "D").otherwise("F"))


def grade_at_or_below(g: Column, threshold: str) -> Column:
    order = F.lit("FDCBA")
    return (F.instr(order, g) > 0) & (F.instr(order, g) <= F.instr(order, F.lit(threshold)))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def severity_from(col: Column) -> Column:
    return F.when(col.isin("critical", "major", "minor"), col).otherwise("info")


def factor_from(col: Column) -> Column:
    return F.when(col.isin("security", "efficiency", "transferability", "changeability", "portability"),
                  col).otherwise("robustness")


def severity_rank(col: Column) -> Column:
    """critical=0 … info=3 (sort order of reports)."""
    return (F.when(col == "critical", 0).when(col == "major", 1)
            .when(col == "minor", 2).otherwise(3))


def log_level_from(col: Column) -> Column:
    lc = F.lower(col)
    return F.when(lc.isin("debug", "info", "warn", "error"), lc).otherwise("info")


def log_level_rank(col: Column) -> Column:
    return (F.when(col == "debug", 0).when(col == "info", 1)
            .when(col == "warn", 2).when(col == "error", 3).otherwise(1))


def project_label(col: Column) -> Column:
    """Last path component, runs of characters outside [A-Za-z0-9._-] become '_',
    then '_', '.', '-' trimmed; empty -> 'report'."""
    last = F.regexp_extract(F.regexp_replace(col, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    safe = F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_")
    trimmed = F.regexp_replace(safe, r"^[_.-]+|[_.-]+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("report"))
