"""Toxicity by a classifier chain.

The categories are predicted in a fixed order; each is a linear (logistic)
model over term counts, whose inputs also hold the probabilities of all earlier
categories.  While fitting, those come from out-of-fold models, so a later
model sees earlier probabilities as good as it will get them in use.

Categories: `abusive` (a term that labelled toxic texts show and clean ones do
not), `repeated` (two or more of them) and last `toxic`, the given label.  Any
other list of label columns can be chained with `fit_chain`.

Terms are learned from all documents labelled toxic and as many clean ones, or
about `max_rows` of both where that is more.  A term must be significant, at a
false discovery rate of ALPHA over all that are tested, whatever the size.
Terms are chosen in rounds, each over the toxic documents that no term so far
reaches, so that a rare language gets its own.  The chain is fitted on at most
about `max_rows` of these documents, half of them toxic at most, weighted back
to the labels' shares (chosen by a hash of doc_id; a documented bound).  All
whole texts are scored.

Defined results: null and empty texts get the probability of a text without
terms; repeated rows score alike; without labels every probability is 0.5 and
nothing is predicted toxic; unclashing new columns replace old ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import drop_new, read, written

MAX_ROWS, MAX_TERMS, FOLDS = 8_000, 40, 5
PIECES = (5, 6, 7)
ALPHA, ALONE = 0.2, 0.001    # false discovery rate; a term must be in so many texts that all toxic is as unlikely
ROUNDS, COVERED = 4, 0.9      # rounds of terms; share of a term's documents that an overlapping one holds to replace it
FLUSH_PARTS, BROADCAST_ROWS = 1_000_000, 4_000_000
THRESHOLD = 0.5
CATEGORIES = ("abusive", "repeated", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def parts(ws: set[str]) -> set[str]:
    """Words, and pieces of words with their borders: stems and endings tell as well."""
    marked = [f" {w} " for w in ws]
    return set(marked) | {w[i:i + n] for n in PIECES for w in marked for i in range(len(w) - n + 1)}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25, times: np.ndarray | None = None) -> np.ndarray:
    """Weights, intercept last, by Newton's method with an L2 penalty.  times:
    how often each row counts."""
    times = np.ones(len(x)) if times is None else times
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (times * (p - y)) + penalty * w
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    names: tuple[str, ...]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, probability(np.hstack([x, out]), w)[:, None]])
        return out


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS, times: np.ndarray | None = None) -> Chain:
    """Rows of x and of every label in an order that does not depend on the cluster."""
    fold = np.arange(len(x)) % folds
    times = np.ones(len(x)) if times is None else times
    earlier = np.zeros((len(x), 0))
    weights = []
    for y in labels.values():
        z = np.hstack([x, earlier])
        weights.append(logistic(z, y, times=times))
        out = np.zeros(len(x))
        for k in range(folds):
            held = fold == k
            if held.any():
                out[held] = probability(z[held], logistic(z[~held], y[~held], times=times[~held]))
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(tuple(labels), weights)


@dataclass
class Model:
    terms: list[str]
    chain: Chain

    def features(self, texts) -> np.ndarray:
        """log(1 + occurrences) and log(1 + occurrences in 1000 words) of each
        term, and of all terms."""
        k = len(self.terms)
        out = np.zeros((len(texts), 2 * k + 2))
        for r, text in enumerate(texts):
            ws = words(text)
            low = f" {'  '.join(ws)} "  # two spaces between words: neighbours share no border
            many = np.array([low.count(t) for t in self.terms])
            if many.any():
                out[r, :k] = np.log1p(many)
                out[r, k:2 * k] = np.log1p(1000 * many / len(ws))
                out[r, -2:] = np.log1p(many.sum()), np.log1p(1000 * many.sum() / len(ws))
        return out

    def probabilities(self, texts) -> np.ndarray:
        if not self.chain.weights:
            return np.full((len(texts), len(CATEGORIES)), 0.5)
        return self.chain.probabilities(self.features(texts))


def part_counts(rows: DataFrame) -> DataFrame:
    """(word, n): texts of rows(text) that hold each word or piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                many.update(parts(set(words(text))))
                if len(many) > FLUSH_PARTS:
                    yield pd.DataFrame({"word": list(many), "n": list(many.values())})
                    many = Counter()
        if many:
            yield pd.DataFrame({"word": list(many), "n": list(many.values())})

    return rows.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def significant(toxic: DataFrame, clean: DataFrame, nt: int, nc: int) -> DataFrame:
    """word, t, gain of the parts that toxic(word, n) of nt texts hold more often
    than clean(word, n) of nc.  gain bounds -log of the chance that t or more
    of a part's texts are toxic (Chernoff); Benjamini and Hochberg's rule gives
    the least gain from all parts tested."""
    q = nt / (nt + nc)
    least = max(1, math.ceil(math.log(ALONE) / math.log(q)))
    t, c = F.col("t"), F.col("c")
    both = (toxic.select("word", F.col("n").alias("t")).join(clean.select("word", F.col("n").alias("c")), "word", "left")
            .fillna(0, ["c"]).filter(t + c >= least))
    rest = F.when(c > 0, c * F.log(c / ((t + c) * (1 - q)))).otherwise(0.0)
    both = both.withColumn("gain", F.when(t > (t + c) * q, t * F.log(t / ((t + c) * q)) + rest).otherwise(0.0))
    # clean ones that no toxic text holds are tested as well
    only = clean.filter(F.col("n") >= least).join(toxic.select("word"), "word", "left_anti").count()
    step = F.least(F.floor(F.col("gain") * 20), F.lit(2000))
    steps = sorted(((r["step"], r["count"]) for r in both.groupBy(step.alias("step")).count().collect()), reverse=True)
    tested, so_far, cut = only + sum(n for _, n in steps), 0, None
    for k, n in steps:
        so_far += n
        if k and math.exp(-k / 20) <= ALPHA * so_far / tested:
            cut = k / 20
    return both.filter(F.col("gain") >= cut if cut is not None else F.lit(False)).select("word", "t", "gain")


def overlapping(a: str, b: str) -> bool:
    return a in b or b in a or any(a[i:i + 4] in b for i in range(len(a) - 3))


def chosen_parts(found: list[str], gain: np.ndarray, held: np.ndarray, limit: int) -> list[str]:
    """At most limit of the parts found, held (parts, texts) being true where a
    text holds a part: by gain, a text counting the less the more chosen parts
    it holds.  A part goes if one that overlaps it holds its texts."""
    many = held.sum(axis=1)
    hits, chosen, open_ = np.zeros(held.shape[1]), [], many > 0
    weight = held.astype(np.float32)
    while len(chosen) < limit and open_.any():
        worth = np.where(open_, gain * (weight @ (1 / (1 + hits)).astype(np.float32)) / np.maximum(many, 1), -1)
        k = int(worth.argmax())
        open_[k] = False
        if any(overlapping(found[k], found[j]) and (held[k] & held[j]).sum() >= COVERED * many[k] for j in chosen):
            continue
        chosen.append(k)
        hits += held[k]
    return [found[k] for k in chosen]


def learn_terms(rows: DataFrame, max_terms: int = MAX_TERMS, max_rows: int = MAX_ROWS) -> list[str]:
    """Words and pieces of words that toxic texts hold significantly more often
    than clean ones.  Each round looks at the toxic texts without a term so
    far and has half of the terms that are left (the last one all)."""
    clean = rows.filter("label <= 0")
    nc = max(clean.count(), 1)
    clean = written(part_counts(clean), "op5-clean")
    left, terms = rows.filter("label > 0").select("text"), []
    for r in range(ROUNDS):
        nt = left.count()
        if not nt:
            break
        found = (significant(written(part_counts(left), "op5-toxic"), clean, nt, nc)
                 .orderBy(F.desc("gain"), F.desc(F.length("word")), "word").limit(100 * max_terms).collect())
        if not found:
            break
        names = [x["word"] for x in found]
        place = {w: k for k, w in enumerate(names)}
        if nt > max_rows // 2:
            some = left.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * (max_rows // 2) / nt))
        else:
            some = left

        @F.pandas_udf("binary")
        def bits(s: pd.Series) -> pd.Series:
            out = []
            for text in s:
                row = np.zeros(len(place), bool)
                row[[place[w] for w in parts(set(words(text))) if w in place]] = True
                out.append(np.packbits(row).tobytes())
            return pd.Series(out, dtype=object)

        got = sorted(bytes(x[0]) for x in some.select(bits("text")).collect())
        held = np.unpackbits(np.frombuffer(b"".join(got), np.uint8).reshape(len(got), -1), axis=1, count=len(names)).astype(bool).T
        free = max_terms - len(terms)
        new = chosen_parts(names, np.array([x["gain"] for x in found]), held, free if r == ROUNDS - 1 else -(-free // 2))
        if not new:
            break
        terms += new
        if len(terms) >= max_terms:
            break

        @F.pandas_udf("boolean")
        def without(s: pd.Series) -> pd.Series:
            lows = [f" {'  '.join(words(text))} " for text in s]
            return pd.Series([not any(t in low for t in new) for low in lows], dtype=bool)

        left = written(left.filter(without("text")), "op5-left")
    return terms


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, label, times, mine: all documents labelled toxic, and as many clean
    ones or about max_rows of both.  mine: those the chain is fitted on, each
    standing for `times` labelled documents."""
    lab = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
           .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")))
    n = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}
    nt, nc = n.get(1, 0), n.get(0, 0)
    fit_t = min(nt, max(max_rows // 2, max_rows - nc))
    fit_c = min(nc, max_rows - fit_t)
    all_c = min(nc, max(max_rows - nt, nt, fit_c))
    share = 1 << 20
    at = F.pmod(F.xxhash64("doc_id"), F.lit(share))
    below = lambda some, of: at < (math.ceil(share * some / of) if of else share)
    lab = lab.withColumn("mine", F.when(F.col("label") > 0, below(fit_t, nt)).otherwise(below(fit_c, nc)))
    lab = lab.withColumn("times", F.when(F.col("label") > 0, nt / max(fit_t, 1)).otherwise(nc / max(fit_c, 1)))
    lab = lab.filter((F.col("label") > 0) | below(all_c, nc))
    # one plan or the other, the same rows: a table too large to send to every task is joined by key
    lab = F.broadcast(lab) if nt + all_c <= BROADCAST_ROWS else lab
    return docs.select("doc_id", "text").join(lab, "doc_id").select("text", "label", "times", "mine")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    rows = written(sampled(docs, labels, max_rows), "op5-sample")
    model = Model(learn_terms(rows, max_terms, max_rows), Chain((), []))

    @F.pandas_udf("array<double>")
    def features(s: pd.Series) -> pd.Series:
        return pd.Series(list(model.features(s)), dtype=object)

    found = sorted((tuple(r[0]), r[1], r[2]) for r in rows.filter("mine").select(features("text"), "label", "times").collect())
    if found:
        x = np.array([r[0] for r in found])
        total = np.rint(np.expm1(x[:, -2]))
        toxic = np.array([r[1] for r in found], dtype=float)
        model.chain = fit_chain(x, {"abusive": (total >= 1) * 1.0, "repeated": (total >= 2) * 1.0, "toxic": toxic},
                                times=np.array([r[2] for r in found]))
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with p_<category> for every category, and predicted int."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"p_{c} double" for c in CATEGORIES))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame(shared.value.probabilities(list(s)), columns=[f"p_{c}" for c in CATEGORIES])

    names = [f"p_{c}" for c in CATEGORIES]
    keep = drop_new(df, [*names, "predicted"]).columns
    out = df.withColumn("__tox", run(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__tox.{n}").alias(n) for n in names],
                      (F.col(f"__tox.p_{CATEGORIES[-1]}") > THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("text")
