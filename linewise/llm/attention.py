"""A small causal self-attention model over subword ids, in numpy.

One block: token and position embeddings, one attention head, a two-layer
perceptron, both with residuals.  The next id's probability is a product of
sigmoids along its path in a Huffman tree over all ids, so it is normalised
without a sum over the vocabulary.  The node biases start from the corpus
counts: before training, the model is the subword unigram model.

The root of the tree asks whether the next id starts a word (or ends the text),
and a Huffman tree of either kind hangs below it.  The chance that a word ends
is then one sigmoid, and a word's probability can be told from its ids' alone.
"""

from __future__ import annotations

import heapq

import numpy as np

WIDTH, HIDDEN, WINDOW, STRIDE = 16, 32, 32, 28
TOP, BATCH, CHUNK, SOME = 64, 64, 512, 64  # nodes of the dense product; windows a training step; windows scored at once, with attention for some at a time
_NAMES = ("emb", "pos", "wq", "wk", "wv", "wo", "w1", "b1", "w2", "node", "bias")


def huffman(counts: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, nodes, signs, bias): id i takes nodes[first[i]:first[i+1]], upwards,
    +1 for the heavier side; bias is the log odds of that side.  Nodes are
    numbered by weight, the root is the last.  With `starts` (true or false per
    id) the root parts the two kinds, +1 for those that start a word."""
    n = len(counts)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
    weight, odds = np.zeros(max(n - 1, 1)), np.zeros(max(n - 1, 1), np.float32)
    top = n

    def join(light: tuple, heavy: tuple) -> tuple:
        nonlocal top
        (a, x), (b, y) = light, heavy
        parent[x] = parent[y] = top
        side[x], side[y] = -1.0, 1.0
        odds[top - n], weight[top - n] = np.log(b / a), a + b
        top += 1
        return a + b, top - 1

    def tree(ids) -> tuple:
        heap = [(int(counts[i]) + 1, int(i)) for i in ids]
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, join(heapq.heappop(heap), heapq.heappop(heap)))
        return heap[0]

    if starts is not None and starts.any() and not starts.all():
        join(tree(np.flatnonzero(~starts)), tree(np.flatnonzero(starts)))
    else:
        tree(range(n))
    order = np.argsort(weight, kind="stable")
    number = np.argsort(order, kind="stable")
    first, nodes, signs = [0], [], []
    for i in range(n):
        x = i
        while x != top - 1:
            nodes.append(number[parent[x] - n])
            signs.append(side[x])
            x = parent[x]
        first.append(len(nodes))
    return np.array(first), np.array(nodes, np.int64), np.array(signs, np.float32), odds[order]


class Attention:
    def __init__(self, counts: np.ndarray, starts: np.ndarray | None = None, seed: int = 11):
        g = np.random.default_rng(seed)
        d, v = WIDTH, len(counts)
        self.first, self.nodes, self.signs, bias = huffman(counts, starts)
        self.size = np.diff(self.first)
        r = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        self.p = {"emb": r(v, d, scale=0.3), "pos": r(WINDOW, d, scale=0.1), "wq": r(d, d, scale=d ** -0.5),
                  "wk": r(d, d, scale=d ** -0.5), "wv": r(d, d, scale=d ** -0.5), "wo": r(d, d, scale=0.3 * d ** -0.5),
                  "w1": r(d, HIDDEN, scale=d ** -0.5), "b1": np.zeros(HIDDEN, np.float32),
                  "w2": r(HIDDEN, d, scale=0.3 * HIDDEN ** -0.5), "node": np.zeros((len(bias), d), np.float32), "bias": bias}
        self.later = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def restore(self, flat, first, nodes, signs, size, vocabulary: int) -> None:
        """This model from its parameters and tree (on an executor)."""
        d, v = WIDTH, vocabulary
        shapes = ((v, d), (WINDOW, d), (d, d), (d, d), (d, d), (d, d), (d, HIDDEN), (HIDDEN,), (HIDDEN, d), (max(v - 1, 1), d), (max(v - 1, 1),))
        self.first, self.nodes, self.signs, self.size = first, nodes, signs, size
        self.p = {k: np.zeros(s, np.float32) for k, s in zip(_NAMES, shapes)}
        self.later = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.load(flat)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in _NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in _NAMES:
            n = self.p[k].size
            self.p[k] = flat[at:at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def states(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Batched masked attention: ids (windows, positions) -> everything the gradient needs."""
        p, s = self.p, {}
        s["x"] = p["emb"].take(ids, axis=0)
        s["x"] += p["pos"][:ids.shape[1]]
        s["q"], s["k"], s["v"] = (s["x"] @ p[k] for k in ("wq", "wk", "wv"))
        a = s["q"] @ s["k"].transpose(0, 2, 1)
        a *= WIDTH ** -0.5
        a += self.later[:ids.shape[1], :ids.shape[1]]
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        s["a"] = a
        s["c"] = a @ s["v"]
        s["h1"] = s["c"] @ p["wo"]
        s["h1"] += s["x"]
        return s

    def head(self, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = h1 @ self.p["w1"]
        r += self.p["b1"]
        np.maximum(r, 0, out=r)
        h = r @ self.p["w2"]
        h += h1
        return r, h

    def paths(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, sign) of every step of every target's path."""
        size = self.size[targets]
        row = np.repeat(np.arange(len(targets)), size)
        at = np.arange(len(row))
        at += (self.first[targets] - np.cumsum(size) + size).take(row)
        return row, self.nodes.take(at), self.signs.take(at)

    def path_odds(self, h: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(log odds of every step, steps at the TOP heaviest nodes, their places in
        the dense product, other steps, the first of those nodes): most steps are at
        a few nodes, whose products with all states are one dense product."""
        top = max(len(self.p["bias"]) - TOP, 0)
        z = np.empty(len(row), np.float32)
        is_near = node >= top
        near, far = np.flatnonzero(is_near), np.flatnonzero(~is_near)
        place = row.take(near) * (len(self.p["bias"]) - top) + node.take(near) - top
        z[near] = (h @ self.p["node"][top:].T).ravel().take(place)
        z[far] = np.einsum("ij,ij->i", self.p["node"].take(node.take(far), axis=0), h.take(row.take(far), axis=0))
        z += self.p["bias"].take(node)
        return z, near, place, far, top

    def log_probability(self, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each target given its state, and the part of
        it that the root decides (starts a word or not)."""
        row, node, sign = self.paths(targets)
        z, *_ = self.path_odds(h, row, node)
        z *= np.negative(sign, out=sign)
        np.minimum(z, 25, out=z)  # a path has under 28 steps: the product stays finite
        step = 1 + np.exp(z).astype(np.float64)
        end = np.cumsum(self.size[targets])
        return -np.log(np.multiply.reduceat(step, end - self.size[targets])), -np.log(step[end - 1])

    def gradient(self, ids: np.ndarray, targets: np.ndarray, counts: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions where counts is true (nan if not asked for), and its gradient."""
        p, s = self.p, self.states(ids)
        r, h = self.head(s["h1"])
        m = counts.ravel()
        flat, want = h.reshape(-1, WIDTH)[m], targets.ravel()[m]
        row, node, sign = self.paths(want)
        z, near, place, far, top = self.path_odds(flat, row, node)
        np.negative(sign, out=sign)
        z *= sign
        np.clip(z, -30, 30, out=z)
        e = np.exp(z, out=z)
        loss = float(np.log1p(e).sum() / len(want)) if with_loss else float("nan")
        gz = np.multiply(sign, e, out=sign)
        e += 1
        e *= len(want)
        gz /= e
        g = {"bias": np.bincount(node, gz, len(p["bias"])).astype(np.float32)}
        dense = np.zeros((len(want), len(p["bias"]) - top), np.float32)
        dense.ravel()[place] = gz.take(near)
        few, at, of = gz.take(far)[:, None], node.take(far), row.take(far)
        g["node"] = _sums(at, few * flat.take(of, axis=0), len(p["node"]))
        g["node"][top:] += dense.T @ flat
        dflat = dense @ p["node"][top:]
        dflat += _sums(of, few * p["node"].take(at, axis=0), len(want))
        dh = np.zeros((m.size, WIDTH), np.float32)
        dh[m] = dflat
        dh = dh.reshape(h.shape)
        two = lambda x: x.reshape(-1, x.shape[-1])
        g["w2"] = two(r).T @ two(dh)
        du = dh @ p["w2"].T
        du *= r > 0
        g["w1"], g["b1"] = two(s["h1"]).T @ two(du), two(du).sum(axis=0)
        dh1 = du @ p["w1"].T
        dh1 += dh
        g["wo"] = two(s["c"]).T @ two(dh1)
        dc = dh1 @ p["wo"].T
        da = dc @ s["v"].transpose(0, 2, 1)
        dv = s["a"].transpose(0, 2, 1) @ dc
        da -= (da * s["a"]).sum(axis=2, keepdims=True)
        ds = np.multiply(s["a"], da, out=da)
        ds *= WIDTH ** -0.5
        dq, dk = ds @ s["k"], ds.transpose(0, 2, 1) @ s["q"]
        dx = dh1
        for k, d in (("wq", dq), ("wk", dk), ("wv", dv)):
            dx += d @ p[k].T
        g["wq"], g["wk"], g["wv"] = (two(s["x"]).T @ two(d) for d in (dq, dk, dv))
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:ids.shape[1]] = dx.sum(axis=0)
        g["emb"] = _sums(ids.ravel(), two(dx), len(p["emb"]))
        return loss, g

    def train(self, windows: np.ndarray, counts: np.ndarray, rate: float, batch: int = BATCH) -> None:
        """One pass of Adam over windows (rows, WINDOW + 1) in the order given."""
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, a in enumerate(range(0, len(windows), batch), 1):
            w, c = windows[a:a + batch], counts[a:a + batch]
            if not c.any():
                continue
            _, g = self.gradient(w[:, :-1], w[:, 1:], c, with_loss=False)
            lr = float(rate * min(1.0, step / 20) * (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step))
            for k, x in g.items():
                t = x - one[k]
                t *= 0.1
                one[k] += t
                np.multiply(x, x, out=t)
                t -= two[k]
                t *= 0.01
                two[k] += t
                np.sqrt(two[k], out=t)
                t += 1e-7
                self.p[k] -= np.divide(lr * one[k], t, out=t)

    def score(self, texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every id of the sequences, one after the
        other (each with its end id last), and the root's part of it.  Windows overlap by WINDOW - STRIDE positions; each id is scored once,
        in the first window that holds it."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out, root = np.zeros(size.sum()), np.zeros(size.sum())
        if not len(out):
            return out, root
        target = np.concatenate(texts).astype(np.int64)
        base = np.cumsum(size) - size
        source = np.roll(target, 1)
        source[base[size > 0]] = start
        number = np.where(size > 0, 1 + np.maximum(-(-(size - WINDOW) // STRIDE), 0), 0)
        text = np.repeat(np.arange(len(texts)), number)
        k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        # short texts together, so that windows need not be padded far
        length = np.minimum(size[text] - k * STRIDE, WINDOW)
        order = np.argsort(length, kind="stable")
        for a in range(0, len(order), CHUNK):
            w = order[a:a + CHUNK]
            span = int(length[w].max())
            at = base[text[w]][:, None] + (k[w] * STRIDE)[:, None] + np.arange(span)
            inside = np.arange(span) < length[w][:, None]
            mine = inside & ((k[w] == 0)[:, None] | (np.arange(span) >= WINDOW - STRIDE))
            at = np.where(inside, at, 0)
            h1 = np.concatenate([self.states(source[at[i:i + SOME]])["h1"] for i in range(0, len(w), SOME)])
            _, h = self.head(h1[mine])
            out[at[mine]], root[at[mine]] = self.log_probability(h, target[at[mine]])
        return out, root


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by index."""
    width = rows.shape[1]
    at = index[:, None] * width + np.arange(width)
    return np.bincount(at.ravel(), rows.ravel(), n * width).reshape(n, width).astype(np.float32)
