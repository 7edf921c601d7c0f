"""Corpus sources: source trees, driver tables as file corpora, language
detection, excludes and truncation.

The canonical `files` frame is
    project string, path string, ext string, language string,
    content string, size long, mtime timestamp
one row per source file.  Everything downstream is derived from it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise import fixed
from linewise.config import ScanConfig

FILES_COLUMNS = ["project", "path", "ext", "language", "content", "size", "mtime"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread a text-heavy scan over the cluster when it arrives in fewer
    splits than there are task slots (a parquet file splits only at row-group
    boundaries, so one large row group is read by one task).  Per-row work
    here (regex, folds) dominates, so one hash exchange of the rows is cheap
    next to running it on one core.  Large inputs already arrive in many
    splits and are left as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * slots:
        return df
    return df.repartition(2 * slots, key)


def read_text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return balanced(read_table(spark, sf_dir, name), key)


# ---------------------------------------------------------------- languages
def languages_dim(spark: SparkSession) -> DataFrame:
    """(ext, language): one row per extension, ~110 rows — a fixed-size
    dimension, so broadcasting it is always safe."""
    rows = [(ext, lang) for lang, exts in fixed.LANGUAGES for ext in exts]
    return spark.createDataFrame(rows, "ext string, language string")


def extension_of(path: Column) -> Column:
    """Lower-cased final extension of the base name; a leading-dot file
    ('.bashrc') has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def detect_language(raw: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Attach ext + language; files of unknown language are dropped (inner
    join against the broadcast dimension)."""
    spark = spark or raw.sparkSession
    dim = F.broadcast(languages_dim(spark))
    return raw.withColumn("ext", extension_of(F.col("path"))).join(dim, "ext", "inner")


# ---------------------------------------------------------------- excludes
def exclude_filter(path: Column, excludes: Iterable[str]) -> Column:
    """True when no directory or file base name equals an exclude entry."""
    ex = list(excludes)
    if not ex:
        return F.lit(True)
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ex]))


def scan_exclude(df: DataFrame, excludes: Iterable[str] = fixed.DEFAULT_EXCLUDES) -> DataFrame:
    return df.filter(exclude_filter(F.col("path"), excludes))


def bytes_to_text(b: Column) -> Column:
    """UTF-8 bytes -> string; invalid or cut sequences become U+FFFD (a
    strict decode would fail the task on one bad file)."""
    return F.make_valid_utf8(b.cast("string"))


def truncate_content(content: Column, max_bytes: int) -> Column:
    """Keep the first max_bytes bytes (UTF-8); files are cut, not skipped."""
    cut = bytes_to_text(F.substring(F.encode(content, "UTF-8"), 1, max_bytes))
    return F.when(F.octet_length(content) > max_bytes, cut).otherwise(content)


def finish_files(raw: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """raw(project, path, content, mtime) -> canonical files frame."""
    df = scan_exclude(raw, cfg.excludes)
    df = detect_language(df)
    if not cfg.max_file_bytes:
        return df.withColumn("size", F.octet_length("content").cast("long")).select(*FILES_COLUMNS)
    df = df.withColumn("truncated", F.octet_length("content") > cfg.max_file_bytes)
    df = df.withColumn("content", truncate_content(F.col("content"), cfg.max_file_bytes))
    df = df.withColumn("size", F.octet_length("content").cast("long"))
    return df.select(*FILES_COLUMNS, "truncated")


# ---------------------------------------------------------------- source tree
def source_glob() -> str:
    """A file name pattern of the known extensions, in any case."""
    each = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext[1:]) for _, exts in fixed.LANGUAGES for ext in exts]
    return "*.{" + ",".join(sorted(set(each))) + "}"


def tree_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel) of the files of known extensions below root.  Only names are
    read: Spark lists the folders (as a job, when they are many), and a scan of
    this source without its content column opens no file."""
    base = root.split("://")[-1].replace("file:", "")
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _re_escape(base) + "/", "")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", source_glob()).load(root))
    return listed.select("path", rel.alias("rel"))


def kept_roots(listing: DataFrame, excludes: Iterable[str]) -> DataFrame:
    """The fewest subtrees (and single files) that hold all kept files and no
    excluded one: (rel), one row each.

    A folder with an excluded folder or file somewhere below it is mixed.  A
    kept file is reached through its topmost folder that is not mixed, or by
    itself where all of its folders are."""
    ex = list(excludes)
    first = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get("parts", i - 1).isin(ex))
    d = listing.select(F.split("rel", "/").alias("parts")).withColumn("bad", F.get(first, 0) if ex else F.lit(None).cast("int"))
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    # above the topmost excluded name, every folder is mixed (the root is, if anything is excluded)
    mixed = (d.filter("bad is not null").select("parts", F.explode(F.sequence(F.lit(0), F.col("bad") - 1)).alias("n"))
              .select(upto(F.col("n")).alias("mixed")).distinct())
    kept = d.filter("bad is null").select("parts", F.slice("parts", F.lit(1), F.size("parts") - 1).alias("folder"))
    folders = kept.select("folder").distinct()
    steps = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("folder")), lambda n: F.array_join(F.slice("folder", F.lit(1), n), "/"))).alias("n", "at"))
    clean = steps.join(mixed, steps["at"] == mixed["mixed"], "left_anti")
    top = clean.groupBy("folder").agg(F.min_by("at", "n").alias("rel"))
    reached = kept.join(top, "folder", "left")
    return reached.select(F.coalesce("rel", F.array_join("parts", "/")).alias("rel")).distinct()


def scan_source_tree(spark: SparkSession, root: str, project: str = "default",
                     cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Recursive walk of `root` (any Hadoop file system) -> files frame.

    The names are listed first; the content is then read only below the folders
    that `kept_roots` finds, so no byte of an excluded tree or of an unknown
    extension is read.  A tree without a kept file gives no row."""
    root_uri = root.rstrip("/")
    base = root_uri.split("://")[-1].replace("file:", "")
    # a few names: those of subtrees that border on an excluded one, which the file source needs as its paths
    roots = sorted(r.rel for r in kept_roots(tree_listing(spark, root_uri), cfg.excludes).collect())
    paths = [_glob_escape(f"{root_uri}/{r}" if r else root_uri) for r in roots]
    if not paths:
        return spark.createDataFrame([], T.StructType(FILES_SCHEMA.fields + ([T.StructField("truncated", T.BooleanType())] if cfg.max_file_bytes else [])))
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", source_glob()).load(paths))
    # Relative POSIX path: strip everything up to and including the root folder.
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _re_escape(base) + "/", "")
    raw = (df.select(F.lit(project).alias("project"), rel.alias("path"),
                     F.col("modificationTime").alias("mtime"), F.col("content"), F.col("length")))
    raw = scan_exclude(raw, cfg.excludes)
    raw = detect_language(raw)
    cut = cfg.max_file_bytes
    if cut:
        raw = raw.withColumn("truncated", F.octet_length("content") > cut)
    content = bytes_to_text(F.substring(F.col("content"), 1, cut) if cut else F.col("content"))
    return (raw.withColumn("content", content)
               .withColumn("size", F.octet_length("content").cast("long"))
               .select(*FILES_COLUMNS, *(["truncated"] if cut else [])))


def _glob_escape(path: str) -> str:
    """Names are names: the file source would take these characters as patterns."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def _re_escape(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in s)


def multi_project_sources(spark: SparkSession, projects: list[tuple[str, str]],
                          cfg: ScanConfig = ScanConfig(), root: str = ".") -> DataFrame:
    """Union of per-root scans, `project` set from the configured name; where
    none is configured, `root` as project `default`."""
    frames = [scan_source_tree(spark, folder, name, cfg) for name, folder in projects or [("default", root)]]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- driver tables
CODIFY_EXTS = [".py", ".cpp", ".js", ".sql", ".java", ".go", ".hs", ".f90", ".cbl", ".erl", ".rs", ".ts"]
CODIFY_DEPS = ["react", "numpy", "django", "boost/asio.hpp", "tokio", "kafka", "react-redux"]


def _codify_line(doc_id: Column, line: Column, n: Column) -> Column:
    """Prose line n of a document with pseudo-code around it: every original
    line stays, decorated or led by an inserted line of its own."""
    led = lambda code: F.concat(code if not isinstance(code, str) else F.lit(code), F.lit("\n"), line)
    k = (doc_id * 7 + n * 3) % 19
    dep = F.element_at(F.array(*[F.lit(d) for d in CODIFY_DEPS]), ((doc_id + n) % 7 + 1).cast("int"))
    return (F.when((n == 1) & (doc_id % 5 == 0), led("// SPDX-License-Identifier: MIT"))
            .when((n == 1) & (doc_id % 5 == 1), led("// Copyright 2026 Example"))
            .when(k == 0, F.concat(F.lit("// "), line))
            .when(k == 1, F.concat(F.lit("/* "), line))
            .when(k == 2, F.concat(line, F.lit(" */")))
            .when(k == 3, F.concat(F.lit("# "), line))
            .when(k == 4, F.concat(F.lit("-- "), line))
            .when(k == 5, F.concat(F.lit("if (x) { "), line, F.lit(" }")))
            .when(k == 6, led(F.concat(F.lit("import "), dep)))
            .when(k == 7, led(F.concat(F.lit("#include <"), dep, F.lit(">"))))
            .when(k == 8, led("while (a && b) {"))
            .when(k == 9, led("}"))
            .when(k == 10, led('password = "hunter2x"'))
            .when(k == 11, led("select * from t"))
            .when(k == 12, led(""))
            .when(k == 13, led("#ifdef _WIN32"))
            .when(k == 14, led("#endif"))
            .when(k == 15, led("DWORD x = rand();"))
            .otherwise(line))


def documents_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as raw source files (before excludes / language):
    one file per document, built by a per-row projection (no shuffle)."""
    d = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", "text")
    doc_id = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in CODIFY_EXTS]), (doc_id % 12 + 1).cast("int"))
    pieces = F.split(F.col("text"), "\n", -1)
    body = F.array_join(F.transform(pieces, lambda l, i: _codify_line(doc_id, l, i + 1)), "\n")
    content = F.concat(body, F.when(doc_id % 2 == 1, F.lit("\n")).otherwise(F.lit("")))
    mtime = F.timestamp_add("MINUTE", doc_id, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return d.select(F.col("source").alias("project"),
                    F.concat(F.lit("src/doc"), doc_id.cast("string"), ext).alias("path"),
                    content.alias("content"), mtime.alias("mtime"), doc_id)


def documents_with_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents_raw, and beside it a copy of every tenth document in an
    excluded folder and of every twelfth under an unknown extension."""
    raw = documents_raw(spark, sf_dir)
    vendored = raw.filter(F.col("doc_id") % 10 == 9).withColumn("path", F.concat(F.lit("vendor/"), F.col("path")))
    unknown = raw.filter(F.col("doc_id") % 12 == 11).withColumn("path", F.concat(F.col("path"), F.lit(".txt")))
    return raw.unionByName(vendored).unionByName(unknown)


def documents_as_files(spark: SparkSession, sf_dir: str, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    return finish_files(documents_raw(spark, sf_dir), cfg)


def pages_as_files(spark: SparkSession, sf_dir: str, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """`pages` as JavaScript files of project 'web' (content = raw html)."""
    p = read_text_table(spark, sf_dir, "pages", "page_id").select("page_id", "html")
    raw = p.select(F.lit("web").alias("project"),
                   F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"),
                   F.col("html").alias("content"),
                   F.timestamp_add("SECOND", F.col("page_id"),
                                   F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("mtime"))
    return finish_files(raw, cfg)


def conversations_as_files(spark: SparkSession, sf_dir: str, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """`conversations` as Python files of project 'chat': one file per turn,
    `conv<id>/turn<k>.py` = '# role' line + text (a projection; no grouping)."""
    c = read_text_table(spark, sf_dir, "conversations", "conv_id").select("conv_id", "turn", "role", "text")
    raw = c.select(F.lit("chat").alias("project"),
                   F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("/turn"),
                            F.col("turn").cast("string"), F.lit(".py")).alias("path"),
                   F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.col("text")).alias("content"),
                   F.timestamp_add("SECOND", F.col("conv_id"),
                                   F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("mtime"))
    return finish_files(raw, cfg)


def corpus_files(spark: SparkSession, sf_dir: str, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """All projects: documents (20 projects) + pages ('web')."""
    return documents_as_files(spark, sf_dir, cfg).unionByName(pages_as_files(spark, sf_dir, cfg))


FILES_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("ext", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
])
