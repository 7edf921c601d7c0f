"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the whole text in Arrow batches; the trees are
fitted from the statistics of all labelled rows (on the driver up to `max_rows`
of them, else by sums over the executors), flattened into arrays and applied to
batches of rows at once.

Defined results: null and empty texts get the statistics of an empty text and
so a score like any other; repeated rows score alike; without usable labels
every score is 0.5.  labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm import boosting
from linewise.llm.common import crc_mod, drop_new, read, written

#: Labels up to which the trees are fitted on the driver.
MAX_ROWS = 20_000
#: Score from which a document counts as good.
THRESHOLD = 0.3

STATISTICS = ("log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "repeated_next",
              "short_words", "upper", "digits", "high_bytes", "punctuation", "exclamation", "symbols", "pipes",
              "stops_commas", "spaces", "lines_per_word", "distinct_lines", "short_lines", "distinct_pairs",
              "capital_words", "commonest_sign")
_SIGNS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_SYMBOLS = np.array([ord(c) for c in "#$%&*+<>=@^_~\\{}[]"])


def statistics(text: str | None) -> list[float]:
    """One row of STATISTICS for a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    nw = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    many = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, nw) if nw else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))
    signs = count[_SIGNS]
    w, ln = max(nw, 1), max(len(lines), 1)
    return [np.log1p(n), np.log1p(nw), n / w, np.log1p(lens.max()), len(many) / w,
            max(many.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, float((lens <= 3).mean()),
            count[65:91].sum() / n, count[48:58].sum() / n, count[128:].sum() / n, signs.sum() / n,
            count[33] / w, count[_SYMBOLS].sum() / w, count[124] / w, (count[44] + count[46]) / w,
            (count[32] + count[9:14].sum()) / n, len(lines) / w, len(set(lines)) / ln,
            sum(len(x) < 40 for x in lines) / ln, pairs / max(nw - 1, 1),
            sum(map(bytes.isupper, words)) / w, signs.max() / w]


def statistics_of(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS,
        **tree) -> boosting.Trees:
    """Trees from all labelled rows that `usable` (over doc_id) admits."""
    usable = F.lit(True) if usable is None else usable
    lab = (labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy("doc_id").agg(F.max("quality").alias("label")))

    @F.pandas_udf("array<double>")
    def stats(s: pd.Series) -> pd.Series:
        return pd.Series(list(statistics_of(s)), dtype=object)

    docs = docs.select("doc_id", "text")
    few = lab.count() <= max_rows
    if few:  # at most max_rows rows of 16 bytes: broadcast
        found = docs.join(F.broadcast(lab), "doc_id").select(stats("text").alias("x"), "label")
    else:    # statistics travel to their labels, texts do not
        found = docs.filter(usable & F.col("doc_id").isNotNull()).select("doc_id", stats("text").alias("x")).join(lab, "doc_id").select("x", "label")
    if few and found.count() <= max_rows:
        rows = sorted((tuple(r[0]), r[1]) for r in found.collect())  # the same trees whatever order tasks end in
        x = np.array([r[0] for r in rows]).reshape(-1, len(STATISTICS))
        return boosting.fit(x, np.array([r[1] for r in rows], dtype=float), **tree)
    found = written(found, "quality-statistics")
    rows = found.select("x", F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(-1).alias("fold"))
    return boosting.fit_frame(rows, **tree)[0][0]


def score(df: DataFrame, trees: boosting.Trees, text_col: str = "text") -> DataFrame:
    """df with score double and predicted int."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(shared.value.probability(statistics_of(s)))

    keep = drop_new(df, ["score", "predicted"]).columns
    out = df.withColumn("__score", run(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__score").alias("score"),
                      (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    held = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    return score(held, trees).select("doc_id", "held_out", "score", "predicted")
