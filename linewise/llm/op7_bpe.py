"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list alone fixes how far a symbol can influence the tokens to its
left (`sufficient_lookahead`).  The encoder keeps a buffer of pending symbols;
a token that ends at least that many symbols before the end of the buffer can
no longer change and is emitted, so memory stays constant however long a
pre-token is.  Decoding is incremental too: `TextDecoder` maps token ids to
bytes and bytes to text, holding back at most one unfinished character.

Defined results: a null text is an empty text; an empty text has no ids, and
its digests are those of the empty string; repeated rows are encoded alike;
the strings of special tokens in a text become their ids, as the tokenizer
file says.  Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.llm.common import Bounded, drop_new, read

#: Words kept in each Python worker's memo (about 50 MB), and rows sent on at a time; speed settings only.
MEMO_WORDS, ROWS = 100_000, 128
END = "</w>"


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a token boundary that can still move it.

    A merge (u, v) carries a difference from the start of v to the start of u.
    The next merge (u2, v2) that carries it on ranks later, and u lies on the
    left spine of v2 (v2, its left part, that one's left part, ...).  So the
    farthest reach follows from one pass over the merges in rank order."""
    left_part: dict[str, str] = {}
    by_left: dict[str, int] = {}
    most = 0
    for u, v in merges:
        far, s = 0, v
        while s is not None:
            far = max(far, by_left.get(s, 0))
            s = left_part.get(s)
        reach = length[u] + far
        by_left[u] = max(by_left.get(u, 0), reach)
        left_part.setdefault(u + v, u)
        most = max(most, reach)
    return most


def byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as a printable letter: itself if it is
    one, else the next unused code point from 256 on."""
    out, extra = [], 256
    for b in range(256):
        keep = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b) if keep else chr(extra))
        extra += not keep
    return out


class Vocabulary:
    """The parsed tokenizer file, and the two streaming machines over it."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        size = {t: len(t.removesuffix(END)) for p in pairs for t in p}
        self.lookahead = sufficient_lookahead(pairs, size)
        self.longest = max((size[u] + size[v] for u, v in pairs), default=1)
        self.cut = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or r"(?!)")
        # letters | one digit | anything else but white space; U+001C-1F are no white space to the tokenizer
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|[_\x1c-\x1f])+")
        self.memo = Bounded(MEMO_WORDS)  # pre-token -> its ids, joined by one space
        self.tokens_of: dict[str, str] = {}  # pre-token -> its tokens
        if any(c + e not in self.ids for c in self.letters for e in ("", END)):
            raise ValueError("the vocabulary lacks some bytes")

    # -- encoding
    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        if not text.isascii() and not odd_numbers().isdisjoint(text):
            return full_pattern().findall(text)
        return self.words.findall(text)

    def merge(self, parts: list[str]) -> list[str]:
        """The merges of a bounded run of symbols, lowest rank first, leftmost first."""
        rank = self.rank.get
        none = len(self.rank)
        while len(parts) > 1:
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == none:
                break
            out, i, last = [], 0, len(parts) - 1
            while i <= last:
                if i < last and ranks[i] == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stream(self, symbols: Iterable[str], block: int = 1024) -> Iterator[str]:
        """Tokens of one pre-token from its symbols, each as soon as it is
        stable.  The last symbol carries the end mark, so one is held back."""
        keep = self.lookahead + self.longest
        buffer: list[str] = []
        held = None
        for s in symbols:
            if held is not None:
                buffer.append(held)
            held = s
            if len(buffer) >= keep + block:
                done, at = 0, 0
                for t in self.merge(buffer):
                    at += len(t)
                    if at > len(buffer) - self.lookahead:
                        break
                    done = at
                    yield t
                buffer = buffer[done:]
        if held is not None:
            yield from self.merge([*buffer, held + END])

    def word(self, raw: bytes) -> tuple[str, str]:
        """Ids and tokens of one long pre-token, each joined by one space, by the stream."""
        tokens = list(self.stream(self.letters[b] for b in raw))
        return " ".join([str(self.ids[t]) for t in tokens]), " ".join(tokens)

    def _tables(self):
        """The merge list as sorted arrays, and the id of each byte inside and at the end of a word."""
        if "_arrays" not in self.__dict__:
            pairs = sorted((self.ids[u] << 32 | self.ids[v], r, self.ids[u + v]) for (u, v), r in self.rank.items())
            inside = np.array([self.ids[c] for c in self.letters], dtype=np.int64)
            end = np.array([self.ids[c + END] for c in self.letters], dtype=np.int64)
            self._arrays = *(np.array(x, dtype=np.int64) for x in zip(*pairs)), inside, end
        return self._arrays

    def step(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One step of the stream for many short pre-tokens at once (each ends
        within the lookahead): token ids, and how many each word has.  In each
        turn every word makes its lowest-ranked merge, leftmost first."""
        keys, ranks, merged, inside, end = self._tables()
        none = len(ranks)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = inside[raw]
        last = np.cumsum(size) - 1
        sym[last] = end[raw[last]]
        of = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            same = np.append(of[1:] == of[:-1], False)
            key = sym << 32
            key[:-1] |= sym[1:]
            at = np.minimum(np.searchsorted(keys, key), none - 1)
            r = np.where(same & (keys[at] == key), ranks[at], none)
            start = np.flatnonzero(np.append(True, ~same[:-1]))
            low = np.repeat(np.minimum.reduceat(r, start), np.diff(np.append(start, len(sym))))
            over = low == none
            done.append((of[over], sym[over]))
            hit = (r == low) & ~over
            where = np.arange(len(sym))
            fresh = hit & ~np.append(False, hit[:-1])  # "aaa": every second pair of a run of equal pairs
            hit &= (where - np.maximum.accumulate(np.where(fresh, where, 0))) % 2 == 0
            sym[hit] = merged[at[hit]]
            keep = ~over & ~np.append(False, hit[:-1])
            sym, of = sym[keep], of[keep]
        of, sym = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(of, kind="stable")
        return sym[order], np.bincount(of, minlength=len(words))

    def learn(self, words: Iterable[str]) -> None:
        """Puts words into the memo."""
        memo, short, raws = self.memo, [], []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) <= 64:
                short.append(w)
                raws.append(raw)
            else:
                memo[w], self.tokens_of[w] = self.word(raw)
        if short:
            sym, n = self.step(raws)
            ids, at = sym.tolist(), 0
            text = [self.token[i] for i in ids]
            ids = list(map(str, ids))
            for w, k in zip(short, n.tolist()):
                memo[w], self.tokens_of[w] = " ".join(ids[at:at + k]), " ".join(text[at:at + k])
                at += k

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[str]]:
        """The pre-tokens of each whole text in order, once the memo knows them."""
        pending: list[list[str]] = []
        n = 0
        for t in texts:
            pending.append(self.split(t or ""))
            n += len(pending[-1])
            if n >= self.memo.limit:
                yield from self._flush(pending)
                pending, n = [], 0
        yield from self._flush(pending)

    def split(self, text: str) -> list[str]:
        """Pre-tokens, and the strings of special tokens (no pre-token equals one:
        none mixes letters with other signs)."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.pre_tokens(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pre_tokens(text[at:]) if at else self.pre_tokens(text)

    def _flush(self, pending: list[list[str]]) -> Iterator[list[str]]:
        if len(self.memo) >= self.memo.limit:
            self.memo.clear()
            self.tokens_of.clear()
        new = set().union(*pending).difference(self.memo)
        for t in new.intersection(self.special):
            self.memo[t], self.tokens_of[t] = str(self.special[t]), t
        self.learn(new.difference(self.special))
        yield from pending

    def ids_text(self, words: list[str]) -> str:
        return " ".join(map(self.memo.__getitem__, words))

    def tokens_text(self, words: list[str]) -> str:
        """What the tokenizer file's decode gives: it names no decoder, so tokens joined by one space."""
        return " ".join(map(self.tokens_of.__getitem__, words))

    # -- decoding
    def decode_pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The tokenizer file names no decoder: tokens, joined by one space."""
        gap = ""
        for i in ids:
            yield gap + self.token[i]
            gap = " "

    def text_decoder(self) -> TextDecoder:
        return TextDecoder(self)


class TextDecoder:
    """Incremental: feed ids, get readable text; state is at most 3 bytes of an
    unfinished character.  An end-of-word mark becomes one space."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        t = self.v.token[token_id]
        if t in self.v.special:
            return self.state.decode(b"", True) + t
        end = t.endswith(END) and len(t) > len(END)
        raw = bytes(self.v.byte_of[c] for c in (t[:-len(END)] if end else t))
        return self.state.decode(raw) + (self.state.decode(b"", True) + " " if end else "")

    def close(self) -> str:
        return self.state.decode(b"", True)


_CACHE: dict = {}


def odd_numbers() -> frozenset:
    """Numbers that are not decimal digits: rare, and not told apart by `re`."""
    if "odd" not in _CACHE:
        _CACHE["odd"] = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("No", "Nl"))
    return _CACHE["odd"]


def full_pattern():
    if "full" not in _CACHE:
        import regex
        _CACHE["full"] = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+")
    return _CACHE["full"]


def vocabulary(raw: str) -> Vocabulary:
    """One per Python worker and tokenizer file."""
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _CACHE:
        _CACHE[key] = Vocabulary(raw)
    return _CACHE[key]


def vocabulary_file(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver (a file of fixed size,
    under 2 MB, which is broadcast)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """df with ids array<int>, n_tokens long and decoded string (the
    tokenizer's decode of the ids) for the whole text of every row.  The output
    leaves the worker ROWS rows at a time: it is several times the text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizer))
    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                          T.StructField("decoded", T.StringType())])
    keep = drop_new(df, added.names).columns
    at, places = df.columns.index(text_col), [df.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids, decoded = [], []
                for words in v.encode(part.column(at).to_pylist()):
                    ids.append(np.array(v.ids_text(words).split(), dtype=np.int32))
                    decoded.append(v.tokens_text(words))
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), lists, pa.array(size), pa.array(decoded, pa.string())],
                                                 names=[*keep, *added.names])

    schema = T.StructType([*(df.schema.fields[i] for i in places), *added.fields])
    return df.mapInArrow(run, schema)


def digests(df: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """As `encode`, with SHA-256 digests instead of the ids and the text, so
    that only they leave the Python worker."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizer))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(shared.value)
        for texts in it:
            rows = []
            for words in v.encode(texts):
                ids, text = v.ids_text(words), v.tokens_text(words)
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                             hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = drop_new(df, names).columns
    out = df.withColumn("__bpe", run(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__bpe.{n}").alias(n) for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
