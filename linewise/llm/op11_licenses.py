"""Operator 11: license scans by an exact set-similarity join.  DataFrame expressions only.

Templates are the usual short notices of public licenses.  A text is cut into
blocks of words that overlap by half, at least as long as the longest template,
so that a notice may stand anywhere in a text and be wrapped in any way.  A
block gets a template's label when it holds at least THRESHOLD of the
template's distinct words.  The join finds all such blocks:

* words are ordered by their frequency in all documents (rarest first, ties by
  the word).  A block keeps only words of some template: others can't be shared.
* prefix filter: sets that share c words share one among the first |x| - c + 1 of
  each, in that order.  Prefixes of blocks meet the templates' postings.
* length filter: a block of fewer than c kept words is dropped.
* positional filter: after a match at places i and j, at most
  1 + min(|b| - 1 - i, |t| - 1 - j) words can be shared, which must reach c.
* what is left is verified by the size of the intersection.

Templates are dealt into batches of at most BATCH_WORDS distinct words; a batch
is one broadcast of postings (its size is bounded by the batch), and any number
of templates makes more batches, each joined in the same way.

Template words and block words are compared in lower case.

Defined results: a null or empty text has no word, no label and score 0.
Repeated rows are scanned each for itself.  Columns of other names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import read, written

# Fixed values of the contract: phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Customary notices of public licenses, (label, words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

THRESHOLD = 90  # least share of a template's distinct words in a block, in hundredths (short notices: all words)
BLOCK_WORDS = 48  # least words of a block; twice the step between blocks
BATCH_WORDS = 4096  # distinct words of the templates of one join
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what parts words, once A-Z count as a-z


def words(text: Column) -> Column:
    """The words of a text in lower case; none of a null text.

    Two letters outside ASCII have an ASCII letter in lower case; they are kept
    apart, so that only A-Z become a-z."""
    kept = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138"))
    # what stands before the first and after the last separator may be empty
    return F.array_remove(F.split(F.lower(kept), BETWEEN), "")


def places(found: str, phrase: str) -> str:
    """SQL: the starts of a phrase in a word array, from 0."""
    parts = phrase.split()
    # sequence(0, -1) counts down, so an array that is too short is answered first
    each = " and ".join(f"{found}[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return (f"if(size({found}) < {len(parts)}, cast(array() as array<int>), "
            f"filter(sequence(0, size({found}) - {len(parts)}), i -> {each}))")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (the same for equal texts) and the base columns of each row."""
    have = {c.lower() for c in docs.columns}
    text = (F.col("text") if "text" in have else F.lit(None)).cast("string")
    d = docs.select((F.col("doc_id") if "doc_id" in have else F.lit(None).cast("long")).alias("doc_id"),
                    F.coalesce(text, F.lit("")).alias("text"))
    # a text without a phrase's last word needs no search of its words
    d = d.select("doc_id", words(F.col("text")).alias("w"), F.lower("text").contains("license").alias("maybe"), F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    found = ", ".join(f"transform({places('w', p)}, i -> struct(i as at, '{label}' as label))" for p, label in PHRASES.items())
    d = d.withColumn("base", F.expr(f"if(maybe, concat({found}), cast(array() as array<struct<at: int, label: string>>))"))
    return d.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
                    F.expr("cast(array_min(base).at as long)").alias("first_word"), F.expr("cast(array_max(base).at as long)").alias("last_word"),
                    F.expr("array_sort(array_distinct(base.label))").alias("base_set"))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


def batches(templates: Sequence[tuple[str, str]]) -> list[list[tuple[str, list[str]]]]:
    """Templates as (label, distinct words), in batches of at most BATCH_WORDS
    distinct words (a template that alone has more is a batch of its own)."""
    out, held = [], set()
    for label, text in sorted(templates):
        mine = sorted(set(template_words(text)))
        if not mine:
            continue
        if not out or len(held | set(mine)) > BATCH_WORDS:
            out.append([])
            held = set()
        held |= set(mine)
        out[-1].append((label, mine))
    return out


def order_of(d: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from rare to frequent in all documents: one count per word comes back."""
    # a text's words are thinned to the vocabulary before they become rows
    mine = F.filter("w", lambda w: w.isin(vocabulary))
    count = {r.word: r.n for r in d.select(F.explode(mine).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def needed(size: int, threshold: int = THRESHOLD) -> int:
    """Words that a block must share with a template of `size` distinct words."""
    return max(1, -(-size * threshold // 100))


def step_of(templates: Sequence[tuple[str, str]]) -> int:
    """Words between the starts of two blocks: any notice of so many words stands whole in a block."""
    return max(BLOCK_WORDS // 2, max((len(template_words(t)) for _, t in templates), default=0))


def blocks(d: DataFrame, order: list[str], step: int, least: int, rare: list[str]) -> DataFrame:
    """One row per block that passes the length filter: key, block, b (kept words, rarest first).
    rare: the templates' prefixes; a text without any of these words has no match."""
    kept = "x in (" + ", ".join(f"'{w}'" for w in order) + ")"
    part = f"filter(transform(sequence(k * {step}, least(size(w), (k + 2) * {step}) - 1), i -> w[i]), x -> {kept})"
    cut = F.expr(f"transform(sequence(0, greatest(0, (size(w) - 1) div {step} - 1)), k -> struct(k as block, {part} as part))")
    some = F.exists("w", lambda w: w.isin(rare))
    each = d.filter((F.size("w") >= least) & some).select("key", F.explode(F.filter(cut, lambda x: F.size(x.part) >= least)).alias("x"))
    each = each.select("key", "x.block", F.array_intersect(F.array(*map(F.lit, order)), F.col("x.part")).alias("b"))
    return each.filter(F.size("b") >= least)


def matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """All (key, block, label, shared, size) of blocks that hold the threshold of a template."""
    spark = docs.sparkSession
    have = {c.lower() for c in docs.columns}
    text = (F.col("text") if "text" in have else F.lit(None)).cast("string")
    d = docs.select(F.coalesce(text, F.lit("")).alias("text")).select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), words(F.col("text")).alias("w"))
    out = spark.createDataFrame([], "key string, block int, label string, shared int, size int")
    step = step_of(templates)
    for batch in batches(templates):
        order = order_of(d, sorted({w for _, t in batch for w in t}))
        at = {w: i for i, w in enumerate(order)}
        rows, least = [], len(order)
        for label, mine in batch:
            t = sorted(mine, key=at.get)
            c = needed(len(t), threshold)
            least = min(least, c)
            rows += [(t[j], j, label, t, c) for j in range(len(t) - c + 1)]
        postings = spark.createDataFrame(rows, "word string, j int, label string, t array<string>, c int")
        b = blocks(d, order, step, least, sorted({r[0] for r in rows}))
        prefix = b.select("key", "block", "b", F.posexplode(F.expr(f"slice(b, 1, size(b) - {least} + 1)")).alias("i", "word"))
        # postings: at most BATCH_WORDS words of the batch's prefixes
        met = prefix.join(F.broadcast(postings), "word").filter(
            (F.size("b") >= F.col("c")) & (F.col("i") <= F.size("b") - F.col("c"))
            & (1 + F.least(F.size("b") - 1 - F.col("i"), F.size("t") - 1 - F.col("j")) >= F.col("c")))
        # a pair is kept where its first shared word met, so each is verified once
        shared = F.array_intersect("b", "t")
        sure = met.filter((F.element_at(shared, 1) == F.col("word")) & (F.size(shared) >= F.col("c")))
        out = out.unionByName(sure.select("key", "block", "label", F.size(shared).alias("shared"), F.size("t").alias("size")))
    return out


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a base place, else the largest share of a template that a
    block holds (0 below the threshold)."""
    hits = (matches(docs, templates, threshold).groupBy("key")
            .agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("share")))
    # few texts hold a notice, and a hot text has one row here: copies of it meet one row
    hits = written(hits, "op11-hits").withColumnRenamed("key", "hit")
    d = scanned(docs)
    both = d.join(hits, d.key == hits.hit, "left")
    none = F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_union("base_set", F.coalesce("more", none)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"),
                       F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of the query: every block is held against every template."""
    quoted = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')))" for label, t in TEMPLATES)
    step = step_of(TEMPLATES)
    starts = " union all ".join(
        f"select doc_id, i - 1 as pos, '{label}' as label from t, unnest(range(1, n_words + 1)) u(i) where "
        + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items())
    return f"""
with t as (select doc_id, w, len(w) as n_words from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)),
 base as (select doc_id, count(*) as n, min(pos) as lo, max(pos) as hi, list_sort(list_distinct(list(label))) as labels from ({starts}) group by doc_id),
 tpl(label, words) as (values {quoted}),
 blk as (select doc_id, w[k * {step} + 1 : (k + 2) * {step}] as b from t, unnest(range(0, greatest(0, (n_words - 1) // {step} - 1) + 1)) u(k) where n_words > 0),
 hit as (select doc_id, label, len(list_intersect(words, b)) as shared, len(words) as size from blk, tpl),
 more as (select doc_id, list(distinct label) as labels, max(shared / size) as share from hit where shared * 100 >= size * {THRESHOLD} group by doc_id)
select t.doc_id, t.n_words, coalesce(base.n, 0) as n_base, base.lo as first_word, base.hi as last_word,
 coalesce(array_to_string(base.labels, ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
 case when base.n > 0 then 1.0::double else coalesce(more.share, 0.0)::double end as score
from t left join base using (doc_id) left join more using (doc_id)"""
