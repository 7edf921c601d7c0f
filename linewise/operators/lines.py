"""Lines: explode, classify (blank / comment / code) and per-file breakdown.

Equivalent forms of the block-comment automaton are provided:

* `file_line_breakdown` folds over the file's line array inside the file row
  (`aggregate` higher-order function).  No shuffle: a file is one row and at
  most `max_file_bytes` long, so the fold is bounded per task.  This is what
  the metrics and health plans use.
* `file_line_class` gives line-level output by the same fold, from file rows.
* `line_class` is for tables of lines: it carries the automaton with a window
  `last(marker) IGNORE NULLS` over the file and needs the lines clustered by
  file (one exchange on project, path).

tests/test_lines.py checks the two agree with a sequential loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.config import ScanConfig
from linewise.functions.lang import block_close_token, block_opens, comment_style, line_comment
from linewise.functions.text import ltrim_ws, strip_cr

LINE_COLUMNS = ["project", "path", "language", "n", "text"]


def lines_array(content: Column) -> Column:
    """Split on LF, drop the final piece when empty, strip CR.
    CRs go from the whole text at once; a final piece that held only CRs stays."""
    parts = F.split(strip_cr(content), "\n", -1)
    dropped = F.when((content == "") | F.endswith(content, F.lit("\n")), 1).otherwise(0)
    return F.slice(parts, F.lit(1), F.size(parts) - dropped)


def phantom_line(content: Column) -> Column:
    """A non-empty file without a final newline counts one extra blank line."""
    return ((F.length(content) > 0) & ~F.endswith(content, F.lit("\n"))).cast("long")


def explode_lines(files: DataFrame) -> DataFrame:
    """files -> lines(project, path, language, n, text); n from 1.
    Generate keeps each file's lines in the file's partition (no shuffle)."""
    return (files.select("project", "path", "language", F.posexplode(lines_array(F.col("content"))))
                 .select("project", "path", "language", (F.col("pos") + 1).alias("n"),
                         F.col("col").alias("text")))


def is_long_line(text: Column, cfg: ScanConfig = ScanConfig()) -> Column:
    return F.octet_length(text) > cfg.long_line_columns


def block_marker(style: Column, language: Column, tr: Column) -> Column:
    """False when the line closes a block, True when it opens one without
    closing it, NULL otherwise (state carried from the previous line)."""
    return (F.when(tr == "", F.lit(None).cast("boolean"))
            .when(F.contains(tr, block_close_token(language)), F.lit(False))
            .when(block_opens(style, language, tr), F.lit(True))
            .otherwise(F.lit(None).cast("boolean")))


def line_class(lines: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """lines -> line_class(project, path, language, n, kind, is_long).
    kind in (blank, comment, code)."""
    style = comment_style(F.col("language"))
    tr = ltrim_ws(F.col("text"))
    w = (Window.partitionBy("project", "path").orderBy("n")
         .rowsBetween(Window.unboundedPreceding, -1))
    df = lines.withColumn("_tr", tr).withColumn("_style", style)
    df = df.withColumn("_marker", block_marker(F.col("_style"), F.col("language"), F.col("_tr")))
    in_block = F.coalesce(F.last("_marker", ignorenulls=True).over(w), F.lit(False))
    kind = (F.when(F.col("_tr") == "", "blank")
            .when(in_block | line_comment(F.col("_style"), F.col("language"), F.col("text"), F.col("_tr")),
                  "comment")
            .otherwise("code"))
    return df.select("project", "path", "language", "n", kind.alias("kind"),
                     is_long_line(F.col("text"), cfg).alias("is_long"))


SLICE = 256  # lines that one inner fold takes


def line_kinds(lines: Column, language: Column, style: Column) -> Column:
    """array<string> of 'b' (blank), 'm' (comment) or 'c' (code) for a line array.
    `style` is a column of the file row, so it is found once a file and not once a line.

    The block state is carried by a fold over slices of the array, so what the
    fold gathers is copied in proportion to the file."""
    close = block_close_token(language)

    def feat(x):
        tr = ltrim_ws(x)
        return F.struct((tr == "").alias("blank"), line_comment(style, language, x, tr).alias("lc"),
                        block_opens(style, language, tr).alias("op"), F.contains(tr, close).alias("cl"))

    def step(acc, f):
        inside = F.when(f["blank"], acc["inside"]).when(acc["inside"], ~f["cl"]).otherwise(f["lc"] & f["op"])
        kind = F.when(f["blank"], "b").when(acc["inside"] | f["lc"], "m").otherwise("c")
        return F.struct(inside.alias("inside"), F.concat(acc["kinds"], kind).alias("kinds"))

    def part(acc, at):
        piece = F.transform(F.slice(lines, at * SLICE + 1, SLICE), feat)
        return F.aggregate(piece, acc, step)

    slices = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / SLICE).cast("int"))).otherwise(F.array().cast("array<int>"))
    empty = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("parts"))

    def outer(acc, at):
        done = part(F.struct(acc["inside"].alias("inside"), F.lit("").alias("kinds")), at)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["inside"].alias("inside"), F.concat(acc["parts"], F.array(d["kinds"])).alias("parts"))), 1)

    joined = F.array_join(F.aggregate(slices, empty, outer, lambda acc: acc["parts"]), "")
    return F.when(F.size(lines) > 0, F.split(joined, "")).otherwise(F.array().cast("array<string>"))


def file_line_class(files: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """files -> line_class(project, path, language, n, kind, is_long), in the file's row: no exchange."""
    df = files.select("project", "path", "language", lines_array(F.col("content")).alias("_lines"), comment_style(F.col("language")).alias("_style"))
    df = df.withColumn("_kinds", line_kinds(F.col("_lines"), F.col("language"), F.col("_style")))
    df = df.select("project", "path", "language", F.posexplode(F.arrays_zip("_lines", "_kinds")).alias("_pos", "_line"))
    kind = F.when(F.col("_line._kinds") == "b", "blank").when(F.col("_line._kinds") == "m", "comment").otherwise("code")
    return df.select("project", "path", "language", (F.col("_pos") + 1).alias("n"), kind.alias("kind"), is_long_line(F.col("_line._lines"), cfg).alias("is_long"))


def _acc(b, code, cmt, blank, lng) -> Column:
    return F.struct(b.alias("b"), code.alias("code"), cmt.alias("cmt"), blank.alias("blank"), lng.alias("lng"))


def breakdown_fold(lines: Column, language: Column, style: Column, long_line_columns: int) -> Column:
    """struct(code, cmt, blank, lng) of a line array, block state carried by a
    left fold (O(lines), bounded by the file size).  `style` is a column of the
    file row: the comment style is found once a file and not once a line."""
    close = block_close_token(language)

    def feat(x):
        tr = ltrim_ws(x)
        return F.struct((tr == "").alias("blank"),
                        line_comment(style, language, x, tr).alias("lc"),
                        block_opens(style, language, tr).alias("op"),
                        F.contains(tr, close).alias("cl"),
                        (F.octet_length(x) > long_line_columns).alias("lg"))

    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    init = _acc(F.lit(False), zero, zero, zero, zero)

    def step(acc, f):
        lng = acc["lng"] + F.when(f["lg"], one).otherwise(zero)
        return (F.when(f["blank"], _acc(acc["b"], acc["code"], acc["cmt"], acc["blank"] + 1, lng))
                .when(acc["b"], _acc(~f["cl"], acc["code"], acc["cmt"] + 1, acc["blank"], lng))
                .when(f["lc"], _acc(f["op"], acc["code"], acc["cmt"] + 1, acc["blank"], lng))
                .otherwise(_acc(F.lit(False), acc["code"] + 1, acc["cmt"], acc["blank"], lng)))

    return F.aggregate(F.transform(lines, feat), init, step)


def file_line_breakdown(files: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """files -> (project, path, language, total_lines, code_lines,
    comment_lines, blank_lines, long_lines).  Pure projection: no shuffle."""
    arr = lines_array(F.col("content"))
    df = files.select("project", "path", "language", "content", arr.alias("_lines"), comment_style(F.col("language")).alias("_style"))
    df = df.withColumn("_bd", breakdown_fold(F.col("_lines"), F.col("language"), F.col("_style"), cfg.long_line_columns))
    ph = phantom_line(F.col("content"))
    return df.select(
        "project", "path", "language",
        (F.size("_lines").cast("long") + ph).alias("total_lines"),
        F.col("_bd.code").alias("code_lines"),
        F.col("_bd.cmt").alias("comment_lines"),
        (F.col("_bd.blank") + ph).alias("blank_lines"),
        F.col("_bd.lng").alias("long_lines"),
    )


def lines_by_language(breakdown: DataFrame) -> DataFrame:
    """sum(code_lines) per (project, language)."""
    return (breakdown.groupBy("project", "language")
                     .agg(F.sum("code_lines").cast("long").alias("code_lines")))


def comment_ratio(comment: Column, total: Column) -> Column:
    return F.when(total > 0, comment / total).otherwise(F.lit(0.0))


__all__ = ["lines_array", "explode_lines", "line_class", "file_line_breakdown", "lines_by_language",
           "comment_ratio", "phantom_line", "is_long_line", "strip_cr"]
