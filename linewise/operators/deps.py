"""Dependencies and technologies.

Per-line extraction is a built-in projection; the per-file technology
assignment is a left fold over the file's sorted dependency list against the
fixed, ordered pattern list (76 entries, a constant array literal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise import fixed
from linewise.functions.text import ltrim_ws


def dependency_of_line(line: Column) -> Column:
    """Dependency named on one line, or NULL.
      #include <x> / #include "x"      (text between the first pair)
      import x / from x                (first token up to space, tab, ';')
      … require('x') / require("x")    (first quoted text; either quote)
    Empty names are dropped."""
    t = ltrim_ws(line)
    angle = F.regexp_extract(t, r'^[^<]*<([^>]*)>', 1)
    dquote = F.regexp_extract(t, r'^[^"]*"([^"]*)"', 1)
    squote = F.regexp_extract(t, r"^[^']*'([^']*)'", 1)
    word = F.regexp_extract(t, r"^(?:import|from) ([^ \t;]*)", 1)
    dep = (F.when(F.startswith(t, F.lit("#include")),
                  F.when(F.contains(t, F.lit("<")), angle).otherwise(dquote))
           .when(F.startswith(t, F.lit("import ")) | F.startswith(t, F.lit("from ")), word)
           .when(F.contains(t, F.lit("require(")), F.coalesce(F.nullif(squote, F.lit("")), dquote)))
    return F.nullif(dep, F.lit(""))


def dependencies_of(lines: Column) -> Column:
    """Sorted distinct dependencies of a line array."""
    deps = F.filter(F.transform(lines, dependency_of_line), lambda d: d.isNotNull())
    return F.array_sort(F.array_distinct(deps))


def extract_dependencies(lines: DataFrame) -> DataFrame:
    """lines -> (project, path, n, dependency) for lines naming one."""
    return (lines.select("project", "path", "n", dependency_of_line(F.col("text")).alias("dependency"))
                 .filter(F.col("dependency").isNotNull()))


def _patterns() -> Column:
    return F.array(*[F.struct(F.lit(tok).alias("token"), F.lit(name).alias("name"), F.lit(cat).alias("category"))
                     for tok, name, cat in fixed.TECHNOLOGIES])


def technology_fold(deps: Column) -> Column:
    """array<struct<name, category>> for one file: for each dependency in
    sorted order, the first pattern whose token occurs in lower(dep) and whose
    name is not yet taken in this file."""
    pats = _patterns()
    init = F.array().cast("array<struct<name:string,category:string>>")

    def step(acc, dep):
        low = F.lower(dep)
        taken = F.transform(acc, lambda t: t["name"])
        hits = F.filter(pats, lambda p: F.contains(low, p["token"]) & ~F.array_contains(taken, p["name"]))
        first = F.slice(F.transform(hits, lambda p: F.struct(p["name"].alias("name"),
                                                             p["category"].alias("category"))), 1, 1)
        return F.concat(acc, first)

    return F.aggregate(deps, init, step)


def file_technologies(metrics: DataFrame) -> DataFrame:
    """metrics(with dependencies) -> (project, path, name, category)."""
    return (metrics.select("project", "path", F.explode(technology_fold(F.col("dependencies"))).alias("t"))
                   .select("project", "path", "t.name", "t.category"))


def technology_inventory(metrics: DataFrame) -> DataFrame:
    """Files per technology per project."""
    return (file_technologies(metrics).groupBy("project", "name", "category")
            .agg(F.count("*").alias("file_count")))


def technology_by_category(inventory: DataFrame) -> DataFrame:
    """Per project and category: technologies ordered by file count desc,
    then name; rendered 'name:count' joined by ','."""
    item = F.struct((-F.col("file_count")).alias("k"), F.col("name"), F.col("file_count"))
    return (inventory.groupBy("project", "category")
            .agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("file_count").alias("file_count"))
            .select("project", "category", "file_count",
                    F.array_join(F.transform("items", lambda s: F.concat_ws(":", s["name"], s["file_count"].cast("string"))),
                                 ",").alias("technologies")))
