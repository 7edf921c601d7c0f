"""Histogram gradient-boosted trees in numpy, flattened into arrays.

`fit` takes rows that fit the driver.  `fit_frame` takes a frame of any size:
its rows stay in blocks on the executors, every level of a tree sums the
histograms of all of them, and only those sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame


@dataclass
class Trees:
    """Complete binary trees of one depth: inner node i has children 2i+1 and
    2i+2; a row goes right where x[feature] > threshold."""

    feature: np.ndarray    # (trees, 2^depth - 1) int
    threshold: np.ndarray  # same shape, float; +inf where a node was not split
    value: np.ndarray      # (trees, 2^depth) float: leaves, left to right
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees at once, one level of all of them per step."""
        n, (trees, inner) = len(x), self.feature.shape
        out = np.full(n, self.base)
        for a in range(0, n, 4096):  # a block of rows: the index matrix stays small
            rows = x[a:a + 4096]
            at = np.zeros((len(rows), trees), dtype=np.int64)
            tree, row = np.arange(trees)[None, :], np.arange(len(rows))[:, None]
            while inner and at[0, 0] < inner:
                at = 2 * at + 1 + (rows[row, self.feature[tree, at]] > self.threshold[tree, at])
            out[a:a + 4096] += self.value[tree, at - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _histograms(code, node: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, bins: int) -> np.ndarray:
    """(features, 2, width, bins): sums of gradients and of curvatures."""
    def one(c):
        slot = node * bins + c
        return [np.bincount(slot, v, width * bins).reshape(width, bins) for v in (g, h)]
    return np.array([one(c) for c in code])


def _best(hist: np.ndarray, usable: list[bool], l2: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of each node's best split; bin -1 where none helps."""
    width = hist.shape[2]
    best = np.full(width, 1e-9)
    pick, cut = np.zeros(width, int), np.full(width, -1)
    for f in np.flatnonzero(usable):
        gs, hs = np.cumsum(hist[f, 0], axis=1), np.cumsum(hist[f, 1], axis=1)
        gt, ht = gs[:, -1:], hs[:, -1:]
        gain = gs ** 2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt ** 2 / (ht + l2)
        gain[(hs < least) | (ht - hs < least)] = 0
        k = gain.argmax(axis=1)
        top = gain[np.arange(width), k]
        better = top > best
        best, pick, cut = np.where(better, top, best), np.where(better, f, pick), np.where(better, k, cut)
    return pick, cut


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32,
        l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic loss.  Each feature is cut at quantiles into at most `bins`
    bins; each level of a tree takes its best split of every node from sums of
    gradients by (node, bin).  With one class or no rows the result is a constant."""
    n = len(y)
    p = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((1, inner), int), np.full((1, inner), np.inf), np.zeros((1, leaves)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])  # col > cut[k] <=> code > k
    feat, thr, val = (np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    score = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width = 2 ** level
            pick, cut = _best(_histograms(code, node, g, h, width, bins), [len(c) > 0 for c in cuts], l2, least)
            first = width - 1
            ok = cut >= 0
            feat[t, first:first + width] = pick
            thr[t, first:first + width] = [cuts[f][k] if s else np.inf for f, k, s in zip(pick, cut, ok)]
            right = ok[node] & (code[pick[node], np.arange(n)] > cut[node])
            node = 2 * node + right
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        val[t] = rate * gs / (hs + l2)
        score += val[t, node]
    return Trees(feat, thr, val, base)


# ---------------------------------------------------------------- any number of rows
_LOW, _MAX = 44, np.int64(2 ** 63 - 1)  # low bits that a key drops: it keeps sign, exponent and eight bits
_UNIT = 2.0 ** 24                       # gradients are multiples of 1/_UNIT: their sums are exact, so in any order the same
_AHEAD = 5                              # trees after which the rows' scores are stored anew


def _key(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles, one for all that agree in eight binary digits."""
    b = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(b >= 0, b >> _LOW, -((b & _MAX) >> _LOW))


def _edge(key: int) -> float:
    """The double that exactly the values of larger keys exceed."""
    bits = np.int64(((key + 1) << _LOW) - 1) if key >= 0 else np.int64(-key << _LOW)
    edge = float(bits.view(np.float64))
    return edge if key >= 0 else -edge


def _packed(rows: DataFrame) -> RDD:
    """x array<double>, y, w double, fold int -> blocks (x, y, w, fold) of numpy arrays."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = [b.column(0).flatten(), *b.columns[1:]]
                raw = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False), t).tobytes() for c, t in zip(flat, (float, float, float, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in raw], names=["x", "y", "w", "fold"])

    def unpack(r):
        y, w, fold = np.frombuffer(r.y, float), np.frombuffer(r.w, float), np.frombuffer(r.fold, np.int32)
        return np.frombuffer(r.x, float).reshape(len(y), -1), y, w, fold

    return rows.select("x", "y", "w", "fold").mapInArrow(pack, "x binary, y binary, w binary, fold binary").rdd.map(unpack)


def _quantile_keys(blocks: RDD, bins: int) -> list[np.ndarray]:
    """Of each feature the keys at its quantiles, counted over all rows."""
    def count(block):
        x, _, w, _ = block
        for f, col in enumerate(x.T):
            keys, at = np.unique(_key(col), return_inverse=True)
            yield from zip(((f, int(k)) for k in keys), np.bincount(at, w).tolist())

    found: dict[int, list] = {}
    for (f, k), n in blocks.flatMap(count).reduceByKey(add).collect():
        found.setdefault(f, []).append((k, n))
    out = []
    for f in sorted(found):
        keys, n = map(np.array, zip(*sorted(found[f])))
        upto = np.cumsum(n)
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
        out.append(keys[at[at < len(keys) - 1]].astype(np.int64))
    return out


def _nodes(code: np.ndarray, feat: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    at, row = np.zeros(code.shape[1], dtype=np.int64), np.arange(code.shape[1])
    for _ in range(levels):
        at = 2 * at + 1 + (code[feat[at], row] > cut[at])
    return at - (2 ** levels - 1)


def _moved(score: np.ndarray, code: np.ndarray, grown: list) -> np.ndarray:
    """Scores of all models after the grown trees: (feat, cut, value), each by model."""
    score = score.copy()
    for feat, cut, value in grown:
        for m in range(len(score)):
            score[m] += value[m][_nodes(code, feat[m], cut[m], value.shape[1].bit_length() - 1)]
    return score


def fit_frame(rows: DataFrame, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32,
              l2: float = 1.0, least: float = 1.0, folds: int = 0, marks: int = 4096) -> tuple[list[Trees], np.ndarray]:
    """Like `fit`, for rows (x array<double>, y 0 or 1, w whole weight, fold) of any number.

    Cuts are quantiles of all rows, and all rows are in every tree.  The first
    model has all rows, model 1 + k those outside fold k.  Also returned: by
    out-of-fold probability, in `marks` equal steps, the weights of all rows and
    of those with y = 1.  The result is the same however rows are partitioned.
    `rows` should be a written table: it is read twice."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, min(-(-n // 16384), 4 * spark.sparkContext.defaultParallelism))
    blocks = _packed(rows.coalesce(parts))
    many = 1 + folds
    held = lambda fold, m: (fold == m - 1) if m else np.zeros(len(fold), bool)

    def ends(block):
        _, y, w, fold = block
        return np.array([[w[~held(fold, m)].sum(), (w * y)[~held(fold, m)].sum()] for m in range(many)])

    size = blocks.map(ends).fold(np.zeros((many, 2)), add)
    p = (size[:, 1] + 0.5) / (size[:, 0] + 1.0)
    base = np.log(p / (1 - p))
    keys = _quantile_keys(blocks, bins)
    usable = [len(k) > 0 for k in keys]
    inner, leaves = 2 ** depth - 1, 2 ** depth

    def encode(block):
        x, y, w, fold = block
        code = np.array([np.searchsorted(k, _key(c)) for k, c in zip(keys, x.T)], dtype=np.uint8)
        return code, y, w, fold, np.repeat(base[:, None], len(y), axis=1)

    state = blocks.map(encode).persist(StorageLevel.MEMORY_AND_DISK)
    done, grown = [], []  # all trees; those that the stored scores have not seen

    def sums(feat, cut, level, grown):
        width = 2 ** level

        def each(part):
            out = np.zeros((many, len(keys), 2, width, bins))
            for code, y, w, fold, score in part:
                score = _moved(score, code, grown)
                for m in range(many):
                    q = 1 / (1 + np.exp(-score[m]))
                    g, h = np.rint((y - q) * _UNIT) / _UNIT, np.rint(np.maximum(q * (1 - q), 1e-6) * _UNIT) / _UNIT
                    use = np.where(held(fold, m), 0.0, w)
                    out[m] += _histograms(code, _nodes(code, feat[m], cut[m], level), g * use, h * use, width, bins)
            yield out
        return each

    for t in range(trees if keys else 0):
        feat, cut = np.zeros((many, inner), int), np.full((many, inner), bins)
        for level in range(depth):
            width = 2 ** level
            # one sum of all rows for each partition reaches the driver
            hist = sum(state.mapPartitions(sums(feat, cut, level, grown)).collect())
            value = np.zeros((many, leaves))
            for m in range(many):
                pick, at = _best(hist[m], usable, l2, least)
                feat[m, width - 1:2 * width - 1] = pick
                cut[m, width - 1:2 * width - 1] = np.where(at >= 0, at, bins)
                if level == depth - 1:
                    upto = np.cumsum(hist[m][pick, :, np.arange(width)], axis=2)  # (node, 2, bins)
                    left = upto[np.arange(width), :, at]  # bin -1, the last one, where no row goes right
                    both = np.stack([left, upto[:, :, -1] - left], axis=1).reshape(leaves, 2)
                    value[m] = rate * both[:, 0] / (both[:, 1] + l2)
        done.append((feat, cut, value))
        grown = [*grown, done[-1]]
        if len(grown) == _AHEAD and t + 1 < trees:
            seen, last = grown, state
            state = last.map(lambda b, seen=seen: (*b[:4], _moved(b[4], b[0], seen))).persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            last.unpersist()
            grown = []

    def judged(part, grown=grown):
        out = np.zeros((2, marks))
        for code, y, w, fold, score in part:
            score = _moved(score, code, grown)
            own = score[np.where((fold >= 0) & (fold < folds), fold + 1, 0), np.arange(len(y))]
            at = np.minimum((marks / (1 + np.exp(-np.clip(own, -40, 40)))).astype(int), marks - 1)
            out += [np.bincount(at, w, marks), np.bincount(at, w * y, marks)]
        yield out

    by_probability = sum(state.mapPartitions(judged).collect())
    state.unpersist()
    edges = [np.array([_edge(int(k)) for k in ks] + [np.inf] * (bins + 1 - len(ks))) for ks in keys]
    models = []
    for m in range(many):
        shape = (max(len(done), 1), inner)
        f, thr, val = np.zeros(shape, int), np.full(shape, np.inf), np.zeros((shape[0], leaves))
        for t, (feat, cut, value) in enumerate(done):
            f[t], val[t] = feat[m], value[m]
            thr[t] = [edges[a][c] for a, c in zip(feat[m], cut[m])]
        models.append(Trees(f, thr, val, float(base[m])))
    return models, by_probability
