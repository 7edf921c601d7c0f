"""Per-language column expressions: comment style, comment predicates,
cyclomatic decision counts, function counts, nesting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewise import fixed
from linewise.functions.text import count_keywords, count_regex, count_substr, keyword_regex

STYLE_OF = {lang: style for style, langs in fixed.COMMENT_STYLES.items() for lang in langs}


def comment_style(language: Column) -> Column:
    """'hash' | 'dash' | … | 'block' | 'slash' (every language not listed)."""
    expr = None
    for style, langs in fixed.COMMENT_STYLES.items():
        cond = language.isin(*langs)
        expr = F.when(cond, style) if expr is None else expr.when(cond, style)
    return expr.otherwise("slash")


def _starts(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def cobol_indicator(t: Column) -> Column:
    """Byte 7 of the untrimmed line is '*'.  '*' is one byte, so it is the
    character that follows a prefix of exactly six bytes."""
    conds = [(F.octet_length(F.substring(t, 1, k)) == 6) & (F.substring(t, k + 1, 1) == "*")
             for k in range(1, 7)]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def line_comment(style: Column, language: Column, t: Column, tr: Column) -> Column:
    """Comment test for a non-blank line outside an open block.
    t = line without CR, tr = t with leading spaces/tabs removed."""
    return (F.when(style == "cobol", cobol_indicator(t))
            .when(style == "asterisk", _starts(tr, "*"))
            .when(style == "jcl", _starts(tr, "//*"))
            .when(style == "hash", _starts(tr, "#"))
            .when(style == "dash", _starts(tr, "--") | ((language == "Haskell") & _starts(tr, "{-")))
            .when(style == "bang", _starts(tr, "!"))
            .when(style == "apostrophe", _starts(tr, "'"))
            .when(style == "percent", _starts(tr, "%"))
            .when(style == "semicolon", _starts(tr, ";"))
            .when(style == "block", _starts(tr, "/*"))
            .otherwise(_starts(tr, "/*") | _starts(tr, "//") | _starts(tr, "* ")))


def block_close_token(language: Column) -> Column:
    return F.when(language == "Haskell", F.lit("-}")).otherwise(F.lit("*/"))


def block_opens(style: Column, language: Column, tr: Column) -> Column:
    """Line (outside a block) opens a block comment that it does not close."""
    slash_open = style.isin("slash", "block") & _starts(tr, "/*") & ~F.contains(tr, F.lit("*/"))
    hs_open = (language == "Haskell") & _starts(tr, "{-") & ~F.contains(tr, F.lit("-}"))
    return slash_open | hs_open


def _case_by_language(table: dict[str, Column], default: Column, language: Column) -> Column:
    expr = None
    for lang, val in table.items():
        expr = F.when(language == lang, val) if expr is None else expr.when(language == lang, val)
    return default if expr is None else expr.otherwise(default)


def decision_points(content: Column, language: Column) -> Column:
    """Universal keywords + language keywords + '&&' + '||' + and/or (8 langs).
    Counted over the whole content, comments and strings included."""
    base = count_keywords(content, fixed.UNIVERSAL_DECISION_KEYWORDS)
    symbols = count_substr(content, "&&") + count_substr(content, "||")
    table = {}
    for lang, kws in fixed.EXTRA_DECISION_KEYWORDS.items():
        extra = count_keywords(content, kws)
        if lang in fixed.AND_OR_LANGUAGES:
            extra = extra + count_keywords(content, ["and", "or"])
        table[lang] = extra       # Erlang 'case' counts here and in the universal set
    for lang in fixed.AND_OR_LANGUAGES:
        table.setdefault(lang, count_keywords(content, ["and", "or"]))
    return base + symbols + _case_by_language(table, F.lit(0).cast("long"), language)


C_FAMILY_FUNCTION = r"\([^)]*+\)[ \t\r\n]*\{"


def function_count_raw(content: Column, language: Column) -> Column:
    table = {}
    for lang, kws in fixed.FUNCTION_KEYWORDS.items():
        if lang == "D":
            table[lang] = F.lit(0).cast("long")  # counted as none: a file with code has one
            continue
        val = count_keywords(content, kws)
        if lang in fixed.FUNCTION_BONUS:
            val = val + F.lit(fixed.FUNCTION_BONUS[lang])
        table[lang] = val
    return _case_by_language(table, count_regex(content, C_FAMILY_FUNCTION), language)


def brace_depth_max(content: Column) -> Column:
    """Max depth of '{' / '}' with the counter floored at zero."""
    chars = F.split(F.regexp_replace(content, r"[^{}]+", ""), "")
    acc0 = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc, ch):
        opened = acc["d"] + 1
        return F.when(ch == "{", F.struct(opened.alias("d"), F.greatest(acc["m"], opened).alias("m"))) \
                .otherwise(F.struct(F.greatest(acc["d"] - 1, F.lit(0)).alias("d"), acc["m"].alias("m")))

    return F.aggregate(chars, acc0, step)["m"].cast("long")


def indent_depth_max(lines: Column) -> Column:
    """Python: max over lines of (leading spaces + 4 * leading tabs) / 4."""
    def depth(line):
        lead = F.regexp_extract(line, r"^[ \t]*", 0)
        tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
        return F.floor((F.length(lead) + 3 * tabs) / 4)
    return F.coalesce(F.array_max(F.transform(lines, depth)), F.lit(0)).cast("long")


def max_nesting(content: Column, lines: Column, language: Column) -> Column:
    return (F.when(language == "Python", indent_depth_max(lines))
            .when(language.isin(*fixed.NO_BRACE_NESTING), F.lit(0).cast("long"))
            .otherwise(brace_depth_max(content)))


__all__ = ["comment_style", "line_comment", "block_close_token", "block_opens", "decision_points",
           "function_count_raw", "max_nesting", "keyword_regex", "STYLE_OF"]
