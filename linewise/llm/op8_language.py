"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language.
An unseen word falls back to its character n-grams: the longest order of which
any gram is known, then progressively shorter ones.  A text's score per
language is the sum over its words.

The counts come from about `max_docs` training texts per language (chosen by a
hash of doc_id; a documented bound), aggregated in Spark; the model keeps every
language's own most frequent words and grams of that sample (`max_words`,
`max_grams` of each, documented bounds too), with their counts in all languages,
and is broadcast.  So a rare language keeps its words beside common ones.
Prediction reads whole texts.

Defined results: `und` with score 0 for a null text, a text without letters, or
if no language could be learned; ties go to the language that sorts first;
repeated rows get equal predictions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import crc_mod, drop_new, read

#: Bounds for each language: texts learned from, about; words and grams kept.
MAX_DOCS, MAX_WORDS, MAX_GRAMS = 1500, 30_000, 30_000
ORDERS = (5, 4, 3, 2, 1)
MEMO_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


class Model:
    """known: word or gram (marked by a leading '#') -> row of `weights`,
    log relative frequencies by language."""

    def __init__(self, langs: list[str], entries: list[tuple[str, str, int]]):
        self.langs = langs
        column = {x: i for i, x in enumerate(langs)}
        keys = sorted({e[0] for e in entries})
        self.known = {k: i for i, k in enumerate(keys)}
        count = np.zeros((len(keys) + 1, max(len(langs), 1)))
        for key, lang, n in entries:
            count[self.known[key], column[lang]] = n
        # words, and grams of each order, are distributions of their own
        kind = np.array([len(k) - 1 if k[0] == "#" else 0 for k in keys] + [0])
        self.weights = np.zeros_like(count)
        for k in np.unique(kind):
            rows = kind == k
            c = count[rows] + 0.5
            self.weights[rows] = np.log(c / c.sum(axis=0))
        self.weights[-1] = 0  # a word with nothing known says nothing
        self.memo: dict[str, np.ndarray] = {}

    def rows(self, word: str) -> list[int]:
        """Rows of `weights` whose mean scores the word."""
        known = self.known
        if word in known:
            return [known[word]]
        for n in ORDERS:
            found = [known[g] for g in ["#" + g for g in grams(word, n)] if g in known]
            if found:
                return found
        return [len(self.weights) - 1]

    def learn(self, new: list[str]) -> None:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        found = [self.rows(w) for w in new]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int64, size.sum())
        mean = np.add.reduceat(self.weights[flat], np.cumsum(size) - size) / size[:, None]
        self.memo.update(zip(new, mean))

    def predict(self, text: str | None) -> tuple[str, float]:
        many = Counter(words(text)) if text else {}
        if not text or not self.langs or not any(c.isalpha() for w in many for c in w):
            return "und", 0.0
        new = [w for w in many if w not in self.memo]
        if len(new) > MEMO_WORDS // 2:  # a very long text: in parts, so that the memo stays bounded
            total = np.zeros(len(self.langs))
            for a in range(0, len(new), MEMO_WORDS // 2):
                part = new[a:a + MEMO_WORDS // 2]
                self.learn(part)
                total += sum(many[w] * self.memo[w] for w in part)
            old = many.keys() - set(new)
            total += sum((many[w] * self.weights[self.rows(w)].mean(axis=0) for w in old), np.zeros(len(self.langs)))
        else:
            held = [self.memo[w] for w in many if w in self.memo]
            n_held = [many[w] for w in many if w in self.memo]
            total = np.zeros(len(self.langs))
            if held:
                total += np.array(n_held) @ np.array(held)
            if new:
                self.learn(new)
                total += np.array([many[w] for w in new]) @ np.array([self.memo[w] for w in new])
        # words are far from independent: the evidence counts as that of the square root of their number
        z = (total - total.max()) / np.sqrt(sum(many.values()))
        p = np.exp(z) / np.exp(z).sum()
        best = int(total.argmax())
        return self.langs[best], float(p[best])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """From text and lang of docs (rows without either are left out)."""
    train = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row per language
    share = 1 << 20
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, int(share * min(1.0, max_docs / n)) + 1).otherwise(limit)
    sample = train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) < limit).select("lang", "text")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                many: Counter = Counter()
                for t in texts:
                    many.update(words(t))
                small: Counter = Counter()
                for w, n in many.items():
                    for k in ORDERS:
                        for g in grams(w, k):
                            small["#" + g] += n
                many.update(small)
                yield pd.DataFrame({"key": list(many), "lang": lang, "n": list(many.values())})

    total = sample.mapInPandas(counts, "key string, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    gram = F.col("key").startswith("#")
    place = F.row_number().over(Window.partitionBy("lang", gram).orderBy(F.desc("n"), "key"))
    by = total.withColumn("place", place).groupBy("key").agg(
        F.sum("n").alias("all"), F.min("place").alias("place"), F.collect_list(F.struct("lang", "n")).alias("by"))
    top = by.filter(F.col("place") <= F.when(gram, max_grams).otherwise(max_words)).filter("all >= 2").select("key", "by").collect()
    return Model(sorted(sizes), [(r["key"], b["lang"], b["n"]) for r in top for b in r["by"]])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred string and score double."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in it:
            yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])

    keep = drop_new(df, ["lang_pred", "score"]).columns
    out = df.withColumn("__lang", run(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__lang.lang_pred").alias("lang_pred"),
                      F.col("__lang.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).drop("text")
