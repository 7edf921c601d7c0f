"""Benchmark decontamination: a BM25 inverted index with block-max WAND.

Test items are indexed by word; each posting holds the term's BM25 impact
divided by the item's own score, so 1.0 means that a passage holds all of the
item.  Postings lie in blocks of items, each with its greatest impact per term.
Every training passage (overlapping windows of a whole text, long enough to
hold any item whole) queries the index and retrieves all items of at least
`threshold`: first a bound from the terms' greatest impacts, then one from the
block maxima, then WAND over the postings of the blocks that are left.  A
retrieved item counts as leaked if word n-grams of the passage cover enough of
its question and of its answer (the last sentence or line).

The items of one index are broadcast: at most `max_items` items and MAX_BYTES
of text, both checked; more items are split into several indexes by hash, each
queried by all passages.

Defined results: null and empty texts and items leak nothing; repeated rows
are reported alike; of several passages with one item the best is reported;
items without words are never found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import read

THRESHOLD, COVER, GRAM = 0.55, 0.5, 4
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20
K1, B, BLOCK, STRIDE = 1.2, 0.75, 4, 32
_WORD = re.compile(r"\w+")
_LAST = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the answer is the last sentence or line; a text
    of one sentence is all question."""
    cuts = [m for m in _LAST.finditer(text.strip()) if words(text.strip()[m.end():])]
    if not cuts or not words(text.strip()[:cuts[-1].start()]):
        return words(text), []
    s = text.strip()
    return words(s[:cuts[-1].start()]), words(s[cuts[-1].end():])


def covered(part: list[str], passage: list[str]) -> float:
    """Share of a part's words inside n-grams that the passage holds too."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    held = set(zip(*[passage[i:] for i in range(n)]))
    hit = np.zeros(len(part), bool)
    for i in range(len(part) - n + 1):
        if tuple(part[i:i + n]) in held:
            hit[i:i + n] = True
    return float(hit.mean())


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, t, words(t)) for i, t in items]
        # items with like words share a block: order by their rarest word
        df = Counter(w for _, _, ws in texts for w in set(ws))
        texts = sorted((x for x in texts if x[2]), key=lambda x: (min((df[w], w) for w in x[2]), x[0], x[1]))
        self.ids = [x[0] for x in texts]
        self.parts = [parts(x[1]) for x in texts]
        n = len(texts)
        mean = sum(len(x[2]) for x in texts) / max(n, 1)
        self.term = {w: k for k, w in enumerate(sorted(df))}
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in self.term]  # by block
        for d, (_, _, ws) in enumerate(texts):
            impact = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean))
                      for w, f in Counter(ws).items()}
            own = sum(impact.values())
            for w, v in impact.items():
                self.postings[self.term[w]].setdefault(d // BLOCK, []).append((d, v / own))
        self.blocks = -(-n // BLOCK)
        # per term, one after the other: its blocks and their greatest impacts
        self.first = np.cumsum([0] + [len(p) for p in self.postings])
        self.block = np.array([b for p in self.postings for b in p], dtype=np.int64)
        self.block_top = np.array([max(v for _, v in x) for p in self.postings for x in p.values()])
        self.top = np.append(np.maximum.reduceat(self.block_top, self.first[:-1]) if len(self.block) else [], 0.0)
        self.window = max([64, *(len(x[2]) for x in texts)]) + STRIDE

    def passages(self, ids: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, window, term): the windows whose bound of greatest impacts
        reaches the threshold, and their distinct terms, window by window."""
        w, none = self.window, len(self.postings)
        starts = np.arange(0, max(len(ids) - w + STRIDE, 1), STRIDE)
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids) + w, -1)  # the place where the same term stood last
        same = ids[order][1:] == ids[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        ids = np.append(ids, np.full(w, none))
        top = self.top[ids]
        several = max(1, min(1024, (1 << 20) // max(self.blocks, 1)))
        for a in range(0, len(starts), several):
            s = starts[a:a + several]
            at = s[:, None] + np.arange(w)
            distinct = (before[at] < s[:, None]) & (ids[at] < none)
            live = np.flatnonzero((top[at] * distinct).sum(axis=1) >= threshold - 1e-6)
            if len(live):
                window, place = np.nonzero(distinct[live])
                yield s[live], window, ids[at[live][window, place]]

    def live_blocks(self, window: np.ndarray, terms: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """(window, block) pairs whose bound of block maxima reaches the threshold."""
        size = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        bound = np.bincount(np.repeat(window, size) * self.blocks + self.block[at], self.block_top[at], n * self.blocks)
        live = np.flatnonzero(bound >= threshold - 1e-6)
        return np.stack([live // self.blocks, live % self.blocks], axis=1)

    def wand(self, terms: list[int], b: int, threshold: float) -> dict[int, float]:
        """All items of block b of at least `threshold`."""
        lists = [self.postings[t][b] for t in terms if b in self.postings[t]]
        tops = [max(v for _, v in p) for p in lists]
        cursor = [0] * len(lists)
        out: dict[int, float] = {}
        while True:
            # terms by their current item; the pivot is the first at which the bounds reach the threshold
            now = sorted((lists[k][c][0], k) for k, c in enumerate(cursor) if c < len(lists[k]))
            total, pivot = 0.0, None
            for d, k in now:
                total += tops[k]
                if total >= threshold - 1e-6:
                    pivot = d
                    break
            if pivot is None:
                return out
            if now[0][0] == pivot:
                score = 0.0
                for d, k in now:
                    if d != pivot:
                        break
                    score += lists[k][cursor[k]][1]
                    cursor[k] += 1
                if score >= threshold - 1e-9:
                    out[pivot] = score
            else:  # items before the pivot cannot reach the threshold
                for d, k in now:
                    if d >= pivot:
                        break
                    while cursor[k] < len(lists[k]) and lists[k][cursor[k]][0] < pivot:
                        cursor[k] += 1

    def retrieve(self, terms: np.ndarray, threshold: float) -> dict[int, float]:
        """All items of at least `threshold` for one passage's distinct terms, by block-max WAND."""
        out: dict[int, float] = {}
        for _, b in self.live_blocks(np.zeros(len(terms), np.int64), terms, 1, threshold).tolist():
            out |= self.wand(terms.tolist(), b, threshold)
        return out

    def search(self, text: str | None, threshold: float, cover: float) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question cover, answer cover) of every leaked item."""
        ws = words(text)
        if not ws or not self.ids:
            return []
        ids = np.fromiter(map(self.term.get, ws, repeat(len(self.postings))), np.int64, len(ws))
        best: dict[int, tuple] = {}
        for starts, window, terms in self.passages(ids, threshold):
            for k, b in self.live_blocks(window, terms, len(starts), threshold).tolist():
                own = terms[np.searchsorted(window, k):np.searchsorted(window, k, "right")].tolist()
                for d, score in self.wand(own, b, threshold).items():
                    start = int(starts[k])
                    q, a = (covered(p, ws[start:start + self.window]) for p in self.parts[d])
                    if q >= cover and a >= cover:
                        best[d] = max(best.get(d, (0.0,)), (score, q, a))
        return sorted((self.ids[d], *map(float, v)) for d, v in best.items())


def indexes(items: DataFrame, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> list[Index]:
    """One index for every max_items items and max_bytes of text."""
    items = items.select("item_id", "text").filter("text is not null")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).collect()[0]
    shards = max(1, -(-n // max_items), -(-(size or 0) // max_bytes))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    return [Index([(r[0], r[1]) for r in items.filter(shard == k).collect()]) for k in range(shards)]


def leaks(df: DataFrame, index: Index, text: Column, threshold: float = THRESHOLD, cover: float = COVER) -> Column:
    """array<struct<item_id, score, question_cover, answer_cover>> of a text."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<struct<item_id:long,score:double,question_cover:double,answer_cover:double>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([[dict(zip(("item_id", "score", "question_cover", "answer_cover"), x))
                              for x in shared.value.search(t, threshold, cover)] for t in s], dtype=object)

    return run(text)


def clean(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that leak no item, with df's columns."""
    for index in indexes(items):
        df = df.filter(F.size(F.coalesce(leaks(df, index, F.col(f"`{text_col}`")), F.array())) == 0)
    return df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = None
    for index in indexes(read(spark, sf_dir, "benchmark")):
        one = docs.select("doc_id", F.explode(leaks(docs, index, F.col("text"))).alias("x")).select("doc_id", "x.*")
        out = one if out is None else out.unionByName(one)
    return out
