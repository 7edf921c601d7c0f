"""Token counts under a unigram model, shared over a trie of pre-tokens.

The distinct pre-tokens of a batch are sorted, which lays their trie out in an
array: a row starts a new node at every depth beyond the prefix that it shares
with the row before.  The best-segmentation (forward) score of a prefix and its
number of tokens are computed once per node, depth by depth, for all nodes of a
depth at once; a text's count is the sum over its pre-tokens of the counts
stored at their terminal nodes.

Pre-tokens are the runs of non-white-space, each led by the word mark U+2581.
The pieces are those of a public vocabulary; a piece of rank r has probability
proportional to 1 / (r + 1).  Bytes that no piece covers cost BYTE_COST each
and count as one token.  Ties go to fewer tokens.

Defined results: null and empty texts have 0 tokens; repeated rows count alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import Bounded, drop_new, read

BYTE_COST = 30.0
MARK = "▁".encode()
MEMO_WORDS, BATCH_WORDS, LONG = 300_000, 40_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str | None = None) -> list[bytes]:
    """Pieces by rank (a file of fixed size, read on the driver)."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [sp.id_to_piece(i).encode() for i in plain]


class Counter:
    def __init__(self, by_rank: list[bytes]):
        total = np.log((1.0 / np.arange(1, len(by_rank) + 1)).sum())
        self.cost: dict[bytes, float] = {}
        for r, p in enumerate(by_rank):
            self.cost.setdefault(p, float(np.log(r + 1) + total))
        self.longest = max(map(len, self.cost), default=1)
        self.power = np.ones(LONG + 2, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, LONG + 2):
                self.power[i] = self.power[i - 1] * _BASE
            self.table = {}
            for n in {len(p) for p in self.cost if len(p) <= LONG}:
                same = [p for p in self.cost if len(p) == n]
                letters = np.frombuffer(b"".join(same), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
                key = (letters * self.power[n - 1::-1][:n]).sum(axis=1, dtype=np.uint64)
                order = np.argsort(key)
                seen = np.zeros(1 << 16, bool)  # most substrings are no piece: a first look by 16 bits
                seen[(key >> np.uint64(48)).astype(np.int64)] = True
                self.table[n] = key[order], np.array([self.cost[p] for p in same])[order], seen
        self.memo = Bounded(MEMO_WORDS)

    def scalar(self, word: bytes) -> int:
        """The same forward pass for one long pre-token; memory follows its length."""
        cost, best, count = self.cost.get, [0.0], [0]
        for d in range(1, len(word) + 1):
            b, c = best[d - 1] + min(cost(word[d - 1:d], BYTE_COST), BYTE_COST), count[d - 1] + 1
            for n in range(2, min(d, self.longest) + 1):
                x = cost(word[d - n:d])
                if x is not None:
                    s, k = best[d - n] + x, count[d - n] + 1
                    if s < b or s == b and k < c:
                        b, c = s, k
            best.append(b)
            count.append(c)
        return count[-1]

    def trie(self, words: list[bytes]) -> np.ndarray:
        """Counts of sorted distinct pre-tokens of at most LONG bytes."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        width = int(size.max())
        letters = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(n, width)
        differ = np.ones((n, width), bool)
        differ[1:] = letters[1:] != letters[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[0] = 0
        shared = np.minimum(shared, np.append(size[:1], size[:-1]))
        hashes = np.zeros((width + 1, n), np.uint64)
        node = np.zeros((width + 1, n), np.int64)  # by depth and row: the first row that has this prefix
        best, count = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int64)
        row = np.arange(n)
        with np.errstate(over="ignore"):
            for d in range(1, width + 1):
                hashes[d] = hashes[d - 1] * _BASE + letters[:, d - 1].astype(np.uint64) + np.uint64(1)
                new = (shared < d) & (size >= d)
                node[d] = np.maximum.accumulate(np.where(new, row, 0))
                at = np.flatnonzero(new)
                if not len(at):
                    continue
                b = np.full(len(at), np.inf)
                c = np.zeros(len(at), np.int64)
                for k, (keys, cost, seen) in self.table.items():
                    if k > d:
                        continue
                    h = hashes[d, at] - hashes[d - k, at] * self.power[k]
                    maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
                    i = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                    ok = keys[i] == h[maybe]
                    i, maybe = i[ok], maybe[ok]
                    before = node[d - k, at[maybe]] if d > k else np.zeros(len(maybe), np.int64)
                    s, m = best[d - k, before] + cost[i], count[d - k, before] + 1
                    better = (s < b[maybe]) | ((s == b[maybe]) & (m < c[maybe]))
                    to = maybe[better]
                    b[to], c[to] = s[better], m[better]
                before = node[d - 1, at] if d > 1 else np.zeros(len(at), np.int64)
                s, m = best[d - 1, before] + BYTE_COST, count[d - 1, before] + 1
                better = (s < b) | ((s == b) & (m < c))
                best[d, at], count[d, at] = np.where(better, s, b), np.where(better, m, c)
        return count[size, node[size, row]]

    def learn(self, new: Iterable[bytes]) -> None:
        marked = sorted(MARK + w for w in new)
        short = [w for w in marked if len(w) <= LONG]
        cut = len(MARK)
        for a in range(0, len(short), BATCH_WORDS):
            part = short[a:a + BATCH_WORDS]
            self.memo.update(zip([w[cut:] for w in part], self.trie(part).tolist()))
        for w in marked:
            if len(w) > LONG:
                self.memo[w[cut:]] = self.scalar(w)

    def counts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int]]:
        """(pre-tokens, tokens) of each whole text."""
        pending: list[list[bytes]] = []
        n = 0
        for t in texts:
            pending.append(t.encode("utf-8", "surrogatepass").split() if t else [])
            n += len(pending[-1])
            if n >= MEMO_WORDS:
                yield from self._flush(pending)
                pending, n = [], 0
        yield from self._flush(pending)

    def _flush(self, pending: list[list[bytes]]) -> Iterator[tuple[int, int]]:
        if len(self.memo) >= self.memo.limit:
            self.memo.clear()
        self.learn(set().union(*pending).difference(self.memo))
        get = self.memo.__getitem__
        for words in pending:
            yield len(words), sum(map(get, words))


_COUNTERS: dict[int, Counter] = {}


def count(df: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with n_pretokens long and n_tokens long."""
    shared = df.sparkSession.sparkContext.broadcast(pieces(vocabulary))

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(shared.value))
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(shared.value)
        for s in it:
            yield pd.DataFrame(list(_COUNTERS[key].counts(s)), columns=["n_pretokens", "n_tokens"])

    names = ["n_pretokens", "n_tokens"]
    keep = drop_new(df, names).columns
    out = df.withColumn("__count", run(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__count.{n}").alias(n) for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
