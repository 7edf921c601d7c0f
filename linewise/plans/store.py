"""One facts table per corpus, shared by all queries and kept between scans.

A corpus has a name.  Its facts are written once per state of its input files
(their paths, sizes and times): a later query on the same state only reads
them.  When the input has changed, the last version is merged by (project,
path, mtime, content hash): rows of files that are still there are taken over,
files that are new or edited are evaluated, the rest go.  A version is a folder
of its own that counts once its writer has committed it, so a reader of an
older version is never disturbed and a writer that dies leaves nothing behind
that is read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.config import ScanConfig
from linewise.operators.rules import CATALOGUE
from linewise.plans.facts import file_facts
from linewise.session import shared_path

KEY = ["project", "path", "mtime", "content_hash"]
FORM = 2  # raised when the columns or the meaning of facts change


def _hash(*parts: str) -> str:
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()[:16]


def input_state(files: DataFrame) -> str | None:
    """A digest of the input files' paths, sizes and times; None for a frame that reads no file."""
    spark = files.sparkSession
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    seen = []
    for name in sorted(files.inputFiles()):
        p = path_of(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return _hash(*seen) if seen else None


def versions(spark, root: str) -> list[tuple[int, str]]:
    """(time, folder name) of the committed versions, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [(s.getModificationTime(), s.getPath()) for s in fs.listStatus(p) if s.isDirectory()]
    return sorted((t, d.getName()) for t, d in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def taken_over(previous: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts that still hold, files to evaluate)."""
    now = files.withColumn("content_hash", F.xxhash64("content"))
    names = [f"_k{i}" for i in range(len(KEY))]

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)]).distinct()
        on = F.lit(True)
        for k, n in zip(KEY, names):
            on = on & F.col(k).eqNullSafe(F.col(n))
        return left.join(other, on, how)
    return same(previous, now, "left_semi"), same(now, previous, "left_anti").drop("content_hash")


def shared_facts(files: DataFrame, corpus: str, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """The facts of a named corpus, evaluated only where its files have changed."""
    spark = files.sparkSession
    root = shared_path(spark, f"linewise/facts/{_hash(corpus, repr(cfg), repr(CATALOGUE), str(FORM))}")
    state = input_state(files)
    known = versions(spark, root)
    if state and (at := next((n for _, n in reversed(known) if n.startswith(state)), None)):
        return spark.read.parquet(f"{root}/{at}")
    if state and known:
        old = spark.read.parquet(f"{root}/{known[-1][1]}")
        kept, fresh = taken_over(old, files)
        facts = kept.unionByName(file_facts(fresh, cfg))
    else:
        facts = file_facts(files, cfg)
    at = f"{root}/{state or 'private'}-{uuid.uuid4().hex[:12]}"
    facts.write.parquet(at)
    return spark.read.schema(facts.schema).parquet(at)
