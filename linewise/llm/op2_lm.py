"""LM scoring with a causal self-attention model over subword ids.

Words are cut into subwords by the first VOCABULARY ranks of a public byte-
level vocabulary, a word's first subword beginning with a space;
`attention.Attention` gives each subword's probability from overlapping context
windows.  The root of its tree tells whether a word goes on or another (or the
end of the text) comes.  So, given that a word begins, the chance that exactly
this word stands there is

    p_attention(word) = product of its subwords' probabilities, the first given that a word
                        begins, times the chance that no further subword of it comes

which sums to at most 1 over all words and the end of the text.  The text's
score mixes it, word by word, with the smoothed frequency of known words:

    p(word) = MIX * [c > 0] (c + 0.5) / (N + 0.5 (V + 1)) + (1 - MIX) * p_attention(word)

with the counts c, N, V of all training tokens.  This sums to at most 1 as well,
so the score is a log probability of the text.  `attention_score` is the
attention model's alone.

All counts cover all training documents, and so does the attention model's
training.  Every window is trained on once, at every size of the input: a hash
of its document and place deals it to one of the rounds and there to one of
ceil(windows / (rounds * SHARD)) shards.  A copy of the model is trained on each
shard, in the order of that hash, and the copies are averaged block by block, at
most FAN at a time; only the average comes to the driver.  So the model depends
on the documents and not on how they are partitioned (windows of rows without
doc_id are dealt by the row's place instead).  Windows for training meet in one
id and do not overlap further.

Counts of words meet their occurrences in a join on the word's 64-bit hash.
Words that make up more than 1 / HOT of all tokens (at most HOT of them) are
broadcast instead, so no key of the join is hot.

Defined results: null and empty texts consist of the end token alone; repeated
rows are scored alike; without training documents base_score counts every token
as unseen (c = N = V = 0) and the score is that of the untrained model.
"""

from __future__ import annotations

import base64
import math
import struct
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.attention import WINDOW, Attention
from linewise.llm.common import Bounded, crc_mod, read, words_of, written

VOCABULARY, HOT, MIX = 8192, 65_536, 0.2
#: Learning rates of the rounds; windows of a shard; parts of the model averaged apart; copies averaged at once.
RATES, SHARD, BLOCKS, FAN = (0.016, 0.011, 0.006, 0.003), 32_768, 32, 64
MEMO_WORDS, FLUSH_WORDS, FLUSH_WINDOWS = 300_000, 400_000, 50_000


def ranks(path: str | None = None, n: int = VOCABULARY) -> dict[bytes, int]:
    """The first n ranks of the vocabulary (a file of fixed size, read on the driver)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        pairs = (line.split() for line in f)
        return {base64.b64decode(a): int(b) for a, b in pairs if int(b) < n}


def starts_of(by_bytes: dict[bytes, int]) -> np.ndarray:
    """True for ids that begin a word (with a space) and for the end's."""
    starts = np.zeros(len(by_bytes) + 1, bool)
    starts[[i for w, i in by_bytes.items() if w[:1] == b" "] + [len(by_bytes)]] = True
    return starts


PUNCTUATION = bytes(b for b in range(0x21, 0x7f) if not chr(b).isalnum())


def of_letters(w: bytes) -> bool:
    """Nothing but Latin letters (up to U+027F)."""
    return w.isalpha() or not w.isascii() and max(w) < 0xca and w.decode("utf-8", "replace").isalpha()


class Subwords:
    """Word -> its ids as uint16 bytes; n is the id of the end."""

    def __init__(self, by_bytes: dict[bytes, int]):
        import public_tokenizers
        import tiktoken
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self.n = len(by_bytes)
        self.end = np.array([self.n], np.uint16).tobytes()
        self.memo = Bounded(MEMO_WORDS)

    def word(self, w: bytes) -> bytes:
        got = self.memo.get(w)
        if got is None:
            got = array("H", self.pieces(w)).tobytes()
            if len(w) <= 64:
                self.memo.put(w, got)
        return got

    def pieces(self, w: bytes) -> list[int]:
        """The ids of a word.  Letters and then ASCII punctuation are two pieces of
        the pattern (one, if either is missing): they need no search for it."""
        stem = w.rstrip(PUNCTUATION)
        if not stem or not of_letters(stem):
            return self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace"))
        ids = self.encoding._encode_single_piece(b" " + stem)
        return ids + self.encoding._encode_single_piece(w[len(stem):]) if len(stem) < len(w) else ids

    def text(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end, number of ids of each word and of the end)."""
        parts = [*map(self.word, words), self.end]
        return np.frombuffer(b"".join(parts), np.uint16).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts)) // 2


_WORKER: dict = {}


def subwords(by_bytes: dict[bytes, int]) -> Subwords:
    """One per Python worker."""
    if _WORKER.get("n") != len(by_bytes):
        _WORKER.update(n=len(by_bytes), subwords=Subwords(by_bytes))
    return _WORKER["subwords"]


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c long) of all training texts; partial sums per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                many.update(words_of(t))
                if len(many) > FLUSH_WORDS:
                    yield pd.DataFrame({"word": list(many), "c": list(many.values())})
                    many = Counter()
        if many:
            yield pd.DataFrame({"word": list(many), "c": list(many.values())})

    return train.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, vocabulary) -> np.ndarray:
    """Occurrences of every id in the training texts (without ends)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub = subwords(vocabulary.value)
        total = np.zeros(sub.n + 1, np.int64)
        for b in batches:
            ids = [np.frombuffer(sub.word(bytes(w)), np.uint16) for w in b["word"]]
            if ids:
                times = np.repeat(b["c"].to_numpy(), [len(i) for i in ids])
                total += np.bincount(np.concatenate(ids), times, sub.n + 1).astype(np.int64)
        yield pd.DataFrame({"id": np.flatnonzero(total), "c": total[total > 0]})

    out = np.zeros(len(vocabulary.value) + 1, np.int64)
    for r in counts.mapInPandas(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[r["id"]] = r["c"]
    return out


def windows_of(key: int, ids: np.ndarray, n: int) -> np.ndarray:
    """A row of bytes per window of a text: its key and place (longs), then WINDOW + 1 ids."""
    k = -(-len(ids) // WINDOW)
    flat = np.full(k * WINDOW + 1, n + 1, np.uint16)
    flat[0], flat[1:len(ids) + 1] = n, ids
    out = np.empty((k, 16 + 2 * WINDOW + 2), np.uint8)
    out[:, :8] = np.frombuffer(struct.pack("<q", key), np.uint8)
    out[:, 8:16] = (np.arange(k) * WINDOW).astype("<i8").view(np.uint8).reshape(k, 8)
    out[:, 16:] = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + 1)[::WINDOW].astype("<u2").view(np.uint8)
    return out


def training_windows(train: DataFrame, vocabulary, rounds: int = len(RATES)) -> DataFrame:
    """(h long, ids binary, round int): WINDOW + 1 ids (uint16; one beyond the end
    pads), of all documents; a folder per round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(vocabulary.value)
        rows, keys = [], []

        def batch() -> pa.RecordBatch:
            h = np.array(keys, np.uint64)
            at = np.arange(len(h) + 1, dtype=np.int32) * (2 * WINDOW + 2)
            ids = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(at), pa.py_buffer(b"".join(rows))])
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array((h % np.uint64(max(rounds, 1))).astype(np.int32))], names=["h", "ids", "round"])

        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text")):
                some = windows_of(key, sub.text(words_of(t.as_py()))[0], sub.n)
                rows.append(some[:, 16:].tobytes())
                keys += [xxhash.xxh64_intdigest(w, seed=3) for w in some]
                if len(keys) >= FLUSH_WINDOWS:
                    yield batch()
                    rows, keys = [], []
        if keys:
            yield batch()

    keyed = train.select(F.coalesce("doc_id", F.monotonically_increasing_id()).alias("key"), "text")
    return written(keyed.mapInArrow(run, "h long, ids binary, round int"), "op2-windows", "round")


def averaged(copies: DataFrame, shards: int) -> DataFrame:
    """(shard long, block int, n long, w binary) with one shard: the mean of all
    copies, each as often as it has windows."""

    def mean(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for n, w in zip(g["n"], g["w"]))
        n = int(g["n"].sum())
        return pd.DataFrame({"shard": g["shard"].iloc[:1], "block": g["block"].iloc[0], "n": n, "w": [(total / n).astype(np.float32).tobytes()]})

    while shards > 1:
        some = copies.select(F.col("shard").alias("part"), F.floor(F.col("shard") / FAN).alias("shard"), "block", "n", "w")
        copies = some.groupBy("shard", "block").applyInPandas(mean, "shard long, block int, n long, w binary")
        shards = -(-shards // FAN)
    return copies


def on_shard(shared, rate: float, n_ids: int):
    """The training of one copy: windows of a shard -> its parameters in BLOCKS parts."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        flat, first, nodes, signs, size = shared.value
        local = Attention.__new__(Attention)
        local.restore(flat, first, nodes, signs, size, n_ids)
        g = g.sort_values(["h", "ids"])
        w = np.frombuffer(b"".join(g["ids"]), np.uint16).reshape(-1, WINDOW + 1).astype(np.int64)
        local.train(np.minimum(w, n_ids - 1), w[:, 1:] < n_ids, rate)
        parts = np.array_split(local.flat(), BLOCKS)
        return pd.DataFrame({"shard": g["shard"].iloc[0], "block": range(BLOCKS), "n": len(w), "w": [p.tobytes() for p in parts]})

    return run


def train_model(windows: DataFrame, counts: np.ndarray, starts: np.ndarray | None = None, rates=RATES, shard: int = SHARD) -> Attention:
    """Rounds of training on shards, then averaging; every window once."""
    spark = windows.sparkSession
    model = Attention(counts, starts)
    n = windows.count() if rates else 0
    shards = max(1, -(-n // (max(len(rates), 1) * shard)))
    for r, rate in enumerate(rates if n else ()):
        shared = spark.sparkContext.broadcast((model.flat(), model.first, model.nodes, model.signs, model.size))
        dealt = windows.filter(F.col("round") == r).select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("long").alias("shard"), "h", "ids")
        copies = dealt.groupBy("shard").applyInPandas(on_shard(shared, rate, len(counts)), "shard long, block int, n long, w binary")
        got = averaged(copies, shards).select("block", "w").collect()  # one model
        if got:
            model.load(np.concatenate([np.frombuffer(x["w"], np.float32) for x in sorted(got, key=lambda x: x["block"])]))
        shared.unpersist()
    return model


def score(docs: DataFrame, training: Column, rates=RATES, shard: int = SHARD) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_tokens, n_known,
    train_tokens, base_score, score, attention_score (log10)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), training.alias("train"))
    train = docs.filter("train")
    by_bytes = ranks()
    vocabulary = spark.sparkContext.broadcast(by_bytes)
    counts = written(word_counts(train), "op2-words")
    ends = train.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    total, kinds = n_words + ends, distinct + (ends > 0)
    ids = subword_counts(counts, vocabulary)
    ids[-1] = ends
    model = train_model(training_windows(train, vocabulary, len(rates)), ids, starts_of(by_bytes), rates, shard)
    hot = {bytes(r["word"]): r["c"] for r in counts.filter(F.col("c") * HOT > total).collect()}  # at most HOT words
    shared = spark.sparkContext.broadcast((model.flat(), model.first, model.nodes, model.signs, model.size, len(ids), hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, first, nodes, signs, size, n, hot = shared.value
        local = Attention.__new__(Attention)
        local.restore(flat, first, nodes, signs, size, n)
        sub = subwords(vocabulary.value)
        for b in batches:
            uid, doc, texts = b.column("uid"), b.column("doc_id"), b.column("text")
            at = 0
            while at < len(texts):  # a few long texts or many short ones at a time
                words, parts, begin, n_ids = [], [], at, 0
                while at < len(texts) and n_ids < 100_000:
                    words.append(words_of(texts[at].as_py()))
                    parts.append(sub.text(words[-1]))
                    n_ids += len(parts[-1][0])
                    at += 1
                lp, root = local.score([p[0] for p in parts], n - 1)
                word_lp = of_words(lp, root, [p[1] for p in parts]) / math.log(10)
                yield emitted(uid.slice(begin, at - begin), doc.slice(begin, at - begin), words, word_lp, hot, ends, total, kinds)

    schema = "uid long, doc_id long, h long, lp double, n_tokens long, known long, base double, score double, attention double"
    with_id = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    rows = with_id.mapInArrow(run, schema)
    cold = counts.filter(F.col("c") * HOT <= total).select(F.xxhash64("word").alias("h"), "c")
    joined = rows.join(cold, "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    word = F.col("lp").isNotNull()
    p = F.when(c > 0, MIX * (c + 0.5) / (total + 0.5 * (kinds + 1))).otherwise(0.0) + (1 - MIX) * F.pow(F.lit(10.0), "lp")
    # below the smallest double only the model's part is left
    logp = F.when(p > 0, F.log10(p)).otherwise(F.col("lp") + math.log10(1 - MIX))
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(word & (c > 0), 1).otherwise(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.max("base") + F.sum(F.when(word, F.log10(c + 0.5)).otherwise(0.0))).alias("base_score"),
        (F.max("score") + F.sum(F.when(word, logp).otherwise(0.0))).alias("score"), F.max("attention").alias("attention_score"))
    return out.drop("uid")


def of_words(lp: np.ndarray, root: np.ndarray, sizes: list[np.ndarray]) -> np.ndarray:
    """Log probability of every word and end, given that one begins, from those
    of the ids and of their root step; sizes: ids of each word and end, by text.
    The root step of the next word's first id says that a word is over."""
    each = np.concatenate(sizes)
    first = np.cumsum(each) - each
    over = np.append(root[first[1:]], 0.0)
    over[np.cumsum([len(x) for x in sizes]) - 1] = 0.0  # nothing follows an end
    return np.add.reduceat(lp, first) - root[first] + over


def emitted(uid, doc, words: list[list[bytes]], lp: np.ndarray, hot: dict, ends: int, total: int, kinds: int) -> pa.RecordBatch:
    """One row for every word whose count the join must bring, and one per text
    with all that is known already (null word columns; its hash is spread)."""

    def logp(c: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = np.where(c > 0, MIX * (c + 0.5) / (total + 0.5 * (kinds + 1)), 0.0) + (1 - MIX) * 10.0 ** x
        return np.where(p > 0, np.log10(np.where(p > 0, p, 1)), x + math.log10(1 - MIX))

    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    text_of = np.repeat(np.arange(n), length + 1)
    last = np.cumsum(length + 1) - 1
    c = np.zeros(len(text_of), np.int64)
    is_word = np.ones(len(text_of), bool)
    is_word[last] = False
    flat = [w for ws in words for w in ws]
    c[is_word] = np.fromiter((hot.get(w, 0) for w in flat), np.int64, len(flat))
    c[last] = ends
    cold = is_word & (c == 0)
    names = [w for w, x in zip(flat, cold[is_word].tolist()) if x]
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in names), np.uint64, len(names)).view(np.int64)
    done = ~cold
    base = np.bincount(text_of[done], np.log10(c[done] + 0.5), n) - (length + 1) * math.log10(total + 0.5 * (kinds + 1))
    mine = np.bincount(text_of[done], logp(c[done].astype(float), lp[done]), n)
    known = np.bincount(text_of[done], c[done] > 0, n).astype(np.int64)
    of = np.append(text_of[cold], np.arange(n))
    k = int(cold.sum())
    pad = lambda x: pa.array(np.append(np.zeros(k, x.dtype), x), mask=np.append(np.ones(k, bool), np.zeros(n, bool)))
    spread = np.array([xxhash.xxh64_intdigest(str(u).encode(), seed=7) for u in uid.to_pylist()], np.uint64).view(np.int64)
    ids = pa.array(np.append(np.zeros(k, np.int64), np.arange(n)), mask=np.append(np.ones(k, bool), np.zeros(n, bool)))
    return pa.RecordBatch.from_arrays([
        uid.take(pa.array(of)), doc.take(ids), pa.array(np.append(h, spread)),
        pa.array(np.append(lp[cold], np.zeros(n)), mask=np.append(np.zeros(k, bool), np.ones(n, bool))),
        pad(length + 1), pad(known), pad(base), pad(mine), pad(np.bincount(text_of, lp, n)),
    ], names=["uid", "doc_id", "h", "lp", "n_tokens", "known", "base", "score", "attention"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 1
    return score(docs, ~held).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known",
                                     "train_tokens", "base_score", "score", "attention_score")
