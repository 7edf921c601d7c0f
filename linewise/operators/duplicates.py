"""Duplicate line blocks.

Blocks are K consecutive normalised non-empty lines (overlapping windows).
They are built inside each file row (slices of the normalised line array)
and identified by two independent 64-bit hashes, so the shuffle carries
(project, h1, h2, path, line) instead of K lines of text.  Counting is a
hash aggregate with map-side partial aggregation, so a block that occurs in
a third of all files (licence headers) still collapses to one row per map
task before the exchange.  Group listings take at most 20 locations per
block through a row_number limit that Spark plans as a partial
WindowGroupLimit ahead of the exchange, so a hot block never reaches one
task in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.config import ScanConfig
from linewise.functions.text import normalize_line
from linewise.operators.lines import lines_array
from linewise.operators.numbering import numbered

MAX_LOCATIONS = 20
MAX_GROUPS = 100


def normalized_lines(lines_arr: Column) -> Column:
    """array<struct<t, n>> of non-empty normalised lines with their line number."""
    pairs = F.transform(lines_arr, lambda x, i: F.struct(normalize_line(x).alias("t"), (i + 1).alias("n")))
    return F.filter(pairs, lambda s: s["t"] != "")


def block_array(norm: Column, k: int) -> Column:
    """array<struct<line, h1, h2>>: one entry per window of k kept lines.

    The k lines of every window come from k shifted slices zipped together,
    so each slice is computed once per file and the lambda touches only its
    own element (a lambda that referenced the whole array would re-evaluate
    it per element)."""
    m = F.greatest(F.size(norm) - k + 1, F.lit(0))
    texts = F.transform(norm, lambda s: s["t"])
    shifted = [F.slice(texts, j + 1, m).alias(f"t{j}") for j in range(k)]
    starts = F.slice(F.transform(norm, lambda s: s["n"]), 1, m).alias("line")
    zipped = F.arrays_zip(starts, *shifted)

    def block(z):
        blk = F.concat(F.concat_ws("\n", *[z[f"t{j}"] for j in range(k)]), F.lit("\n"))
        return F.struct(z["line"].alias("line"), F.xxhash64(blk).alias("h1"),
                        F.xxhash64(F.lit("linewise-dup"), blk).alias("h2"))

    return F.transform(zipped, block)


def blocks(files: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """files -> blocks(project, path, line, h1, h2)."""
    k = max(1, cfg.duplication_block_lines)
    norm = files.select("project", "path", normalized_lines(lines_array(F.col("content"))).alias("_norm"))
    return (norm.select("project", "path", F.explode(block_array(F.col("_norm"), k)).alias("b"))
                .select("project", "path", "b.line", "b.h1", "b.h2"))


def block_counts(blk: DataFrame) -> DataFrame:
    """(project, h1, h2, occurrences, first_path, first_line)."""
    first = F.min(F.struct("path", "line"))
    return (blk.groupBy("project", "h1", "h2")
               .agg(F.count("*").alias("occurrences"), first.alias("first"))
               .select("project", "h1", "h2", "occurrences",
                       F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line")))


def duplicate_blocks(blk: DataFrame) -> DataFrame:
    """Per project: number of distinct blocks seen at least twice, and the
    number of distinct blocks."""
    c = blk.groupBy("project", "h1", "h2").agg(F.count("*").alias("occ"))
    return c.groupBy("project").agg(F.count_if(F.col("occ") >= 2).alias("duplicate_blocks"),
                                    F.count("*").alias("distinct_blocks"))


def duplicate_locations(blk: DataFrame) -> DataFrame:
    """Duplicated block starts with the number of copies of their block."""
    c = block_counts(blk).filter(F.col("occurrences") >= 2).select("project", "h1", "h2", "occurrences")
    return blk.join(c, ["project", "h1", "h2"])


def duplicate_groups(blk: DataFrame, max_groups: int | None = MAX_GROUPS,
                     max_locations: int | None = MAX_LOCATIONS) -> DataFrame:
    """Per project the duplicated blocks ordered by occurrences desc then first
    location, at most max_groups of them; each lists its first max_locations
    locations 'path:line' in (path, line) order.  None lists all.

    Blocks are counted first; only the groups that are listed fetch locations,
    so a block that stands once never travels with its path."""
    order = [F.desc("occurrences"), F.asc("first_path"), F.asc("first_line"), F.asc("h1"), F.asc("h2")]
    groups = block_counts(blk).filter(F.col("occurrences") >= 2)
    if max_groups is None:
        groups = numbered(groups, order, "group_rank", ["project"])
    else:
        # a limit of row numbers: Spark keeps max_groups rows a project in each task before the exchange
        rank = F.row_number().over(Window.partitionBy("project").orderBy(*order))
        groups = groups.withColumn("group_rank", rank).filter(F.col("group_rank") <= max_groups)
    on = ["project", "h1", "h2"]
    starts = blk.join(groups.select(*on, "group_rank", "occurrences"), on)
    # likewise, a hot block sends at most max_locations rows from each task
    if max_locations is not None:
        place = F.row_number().over(Window.partitionBy(*on).orderBy("path", "line"))
        starts = starts.withColumn("_r", place).filter(F.col("_r") <= max_locations)
    g = (starts.groupBy(*on, "group_rank", "occurrences")
         .agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("locs")))
    loc_str = F.transform("locs", lambda s: F.concat_ws(":", s["path"], s["line"].cast("string")))
    return g.select("project", "group_rank", "occurrences", F.size("locs").alias("listed"),
                    F.array_join(loc_str, ",").alias("locations"))
