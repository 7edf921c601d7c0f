"""The corpus pipeline: from `documents` to clean, encoded training documents.

    quality         documents that the boosted trees reject go            (operator 6)
    near_duplicates one document of each group of near copies stays       (operator 4, with 5-word
                    shingles from Jaccard 0.8; the op4_jaccard query has 4 words and 0.85)
    decontaminate   documents that leak a benchmark item go               (operator 1)
    pii             spans of personal data are replaced by their kind     (operator 9)
    bpe             texts are encoded; ids and their decoding are added   (operator 7)

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.  Tables are written
between stages, so a lost executor costs a reread.

Defined results, beyond those of the operators: of repeated rows of one doc_id
one stays; rows without doc_id are compared by text only, one of each text stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm import op1_decontaminate, op4_jaccard, op6_quality, op7_bpe, op9_pii
from linewise.llm.common import crc_mod, fresh, marked, read, written

SHINGLE_WORDS, SHINGLE_SHARE = 5, 80  # near copies: shingle length; least Jaccard in hundredths


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = op6_quality.fit(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    mark, = fresh(docs, "__kept")
    scored = op6_quality.score(docs.select(F.struct("*").alias(mark), "text"), trees)
    return scored.filter("predicted = 1").select(f"{mark}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(op4_jaccard.components(docs, SHINGLE_WORDS, SHINGLE_SHARE), "pipeline-components")
    # ids that are not simply one row which stays; the texts of all others need not travel
    each = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__all"), F.count_if(F.expr("doc_id = component_id")).alias("__rows"))
    touched = written(each.filter("__all > 1 or __rows = 0").drop("__all"), "pipeline-touched")
    mark, = fresh(docs, "__touched")
    split = marked(docs.filter("doc_id is not null"), "doc_id", touched.select("doc_id"), mark)
    out = split.filter(~F.col(mark)).select(*docs.columns)
    joined = split.filter(mark).join(touched, "doc_id", "left").select(*docs.columns, F.coalesce("__rows", F.lit(1)).alias("__rows"))
    out = out.unionByName(joined.filter("__rows = 1").drop("__rows"))
    again = not touched.filter("__rows > 1").isEmpty()
    nameless = not found.filter("doc_id is null").isEmpty()
    if again:
        out = out.unionByName(joined.filter("__rows > 1").dropDuplicates(["doc_id"]).drop("__rows"))
    return out.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"])) if nameless else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op9_pii.fit(docs.select("text"))
    mark, = fresh(docs, "__row")
    found = op9_pii.find(docs.select(F.struct("*").alias(mark), "text"), model)
    text = op9_pii.redact(F.col("text"), F.col("spans"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"{mark}.`{c}`").alias(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_bpe.encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pii", pii), ("bpe", bpe)]

#: SQL can express neither the learned stages nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
