"""Operator 12: periodic run detection in a Re-Pair grammar.

A run is a stretch of words with smallest period q, at least max(24, 3 q) long,
that no neighbouring word extends.  Texts are handled in batches of a bounded
number of words inside a task (a longer text is a batch of its own), each text
with a grammar of its own:

1. Re-Pair on the word ids, in rounds: a round replaces every pair that occurs
   twice or more and is more frequent than the pairs it overlaps, until no pair
   of a text occurs twice.  What is left is the text's start string; a balanced
   binary tree over it makes the rest of the derivation.
2. Every nonterminal, and every node of that tree, has one boundary between its
   two parts.  Runs that cross it are computed once, on one occurrence, and only
   inside the node's own stretch.  The word groups next to the boundary propose
   the periods: 3 q words around a boundary hold a group of words, long for long
   periods, that starts (or ends) at it and stands again q words on (or back).
   Proposals are extended word by word to the whole interval.
3. Intervals are translated to all occurrences of their nonterminal, down the
   derivation and only through rules that hold some.
4. Intervals of one period that lie in each other are merged: the tree node that
   first holds a run whole gives it in full, so the widest is the maximal one.
   Of equal intervals the smallest period stays.

The groups are compared by 64-bit hashes, which may propose too much but never
too little; each interval is then found by comparing words.

Defined results: a null or empty text has n = 0 words, no run, and the digests
of the empty string; a null doc_id counts as empty text in crc32 (so h = 0);
repeated rows are handled each for itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import mix64, read

LEAST, TIMES = 24, 3  # a run has at least LEAST words and TIMES periods
BATCH_WORDS = 600_000  # words of the texts that share a batch
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def planted(words: list, doc_id: int | None) -> list:
    """The words after the contract's planting: every tenth text repeats a part of itself to its end."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // p + 1))[:n - a]


# ---------------------------------------------------------------- grammar

class Grammar:
    """left, right: the parts of the rules, in the order of their making (so parts come first).
    Symbols below `terminals` are words; rule r is symbol terminals + r.
    start: the start strings one after the other; owner: the text of each of its symbols."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, terminals: int):
        self.terminals = terminals
        lefts, rights, made = [], [], terminals
        done_s, done_o, s, o = [], [], ids, owner
        while len(s):
            s, o, left, right, busy = pair_round(s, o, made)
            lefts.append(left)
            rights.append(right)
            made += len(left)
            # a text without a replaced pair has none that occurs twice: its start string is final
            keep = busy[o]
            done_s.append(s[~keep])
            done_o.append(o[~keep])
            s, o = s[keep], o[keep]
        self.left = np.concatenate([*lefts, np.zeros(0, np.int64)])
        self.right = np.concatenate([*rights, np.zeros(0, np.int64)])
        start, own = np.concatenate([*done_s, np.zeros(0, np.int64)]), np.concatenate([*done_o, np.zeros(0, np.int64)])
        by = np.argsort(own, kind="stable")
        self.start, self.owner = start[by], own[by]
        size = np.ones(made, np.int64)
        at = terminals
        for left, right in zip(lefts, rights, strict=True):  # a round's rules have parts of earlier rounds only
            size[at:at + len(left)] = size[left] + size[right]
            at += len(left)
        self.size = size
        self.rounds = [len(x) for x in lefts]


def maybe_twice(key: np.ndarray) -> np.ndarray:
    """False only where a key stands once (a cheap sieve before sorting)."""
    bits = max(10, len(key).bit_length() + 2)
    cell = (mix64(key) >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(cell, minlength=1 << bits)[cell] > 1


def pair_keys(s: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A number for each pair of neighbours, equal only for equal (text, left, right)."""
    left, right, own = s[:-1], s[1:], o[:-1]
    a, b = int(s.max()).bit_length(), int(o[-1]).bit_length()
    if 2 * a + b <= 63:
        return (((own << a) | left) << a) | right
    pair = np.unique((left << 32) | right, return_inverse=True)[1]
    return (own << 32) | pair


def pair_round(s: np.ndarray, o: np.ndarray, made: int):
    """One round: the strings after it, their owners, the new rules, and which texts had one."""
    n = len(s)
    busy = np.zeros(int(o[-1]) + 1 if n else 0, bool)
    none = np.zeros(0, np.int64)
    if n < 2:
        return s, o, none, none, busy
    inside = o[1:] == o[:-1]
    key = pair_keys(s, o)
    same = np.zeros(n - 1, bool)  # the pair before is the same one: a stretch like aaaa
    same[1:] = (key[1:] == key[:-1]) & inside[1:] & inside[:-1]
    heads = np.flatnonzero(~same)
    odd = (np.arange(n - 1) - np.repeat(heads, np.diff(np.append(heads, n - 1)))) & 1 == 1
    at = np.flatnonzero(inside & ~odd)
    at = at[maybe_twice(key[at])]
    if not len(at):
        return s, o, none, none, busy
    by = at[np.argsort(key[at], kind="stable")]
    k = key[by]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    counts = np.diff(np.append(first, len(k)))
    # rank of a pair: by count, then by first occurrence; the same for all its places
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((-by[first], counts))] = np.arange(1, len(first) + 1)
    prio = np.zeros(n + 1, np.int64)
    prio[by + 1] = np.repeat(np.where(counts >= 2, rank, 0), counts)
    # a text's first pair by rank keeps all its places, so every round makes progress
    chosen = np.flatnonzero((prio[1:-1] > prio[:-2]) & (prio[1:-1] > prio[2:]))
    if not len(chosen):
        return s, o, none, none, busy
    # a pair that lost all places but one gains nothing
    kk = key[chosen]
    order = np.argsort(kk, kind="stable")
    ks = kk[order]
    head = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
    many = np.diff(np.append(head, len(ks)))
    good = many >= 2
    rule = np.repeat(np.where(good, made + np.cumsum(good) - 1, -1), many)
    at = chosen[order]
    at, rule = at[rule >= 0], rule[rule >= 0]
    if not len(at):
        return s, o, none, none, busy
    ends = chosen[order][head[good]]
    left, right = s[ends], s[ends + 1]
    out = s.copy()
    out[at] = rule
    keep = np.ones(n, bool)
    keep[at + 1] = False
    busy[o[at]] = True
    return out[keep], o[keep], left, right, busy


# ------------------------------------------------- runs across boundaries

def spans(g: Grammar):
    """(begin, middle, end, rule) of one occurrence of every node with a boundary, in word places;
    rule is -1 for the nodes of the trees over the start strings."""
    s, o, size = g.start, g.owner, g.size
    place = np.cumsum(size[s]) - size[s]
    # start strings: the boundary before symbol i of its text belongs to the node of 2^k symbols to either side
    head = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(s) else np.zeros(0, np.int64)
    i = np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))
    many = np.repeat(np.diff(np.append(head, len(s))), np.diff(np.append(head, len(s))))
    low = i & -i
    at = np.flatnonzero(i > 0)
    base = at - i[at]
    end = np.minimum(i[at] + low[at], many[at])
    close = np.append(place, place[-1] + size[s[-1]] if len(s) else 0)
    top = (close[base + i[at] - low[at]], place[at], close[base + end], np.full(len(at), -1, np.int64))
    # rules: one occurrence each, found from the start strings down
    t, rules = g.terminals, len(g.left)
    where = np.full(t + rules, -1, np.int64)
    where[s[::-1]] = place[::-1]
    stop = rules
    for made in reversed(g.rounds):
        r = np.arange(stop - made, stop)
        stop -= made
        b = where[t + r]
        for part, shift in ((g.left[r], 0), (g.right[r], size[g.left[r]])):
            where[part] = np.where(b >= 0, b + shift, where[part])
    r = np.arange(rules)
    b = where[t + r]
    mid = b + size[g.left]
    found = tuple(np.concatenate(x) for x in zip(top, (b, mid, b + size[t + r], r), strict=True))
    wide = found[2] - found[0] >= LEAST
    return tuple(x[wide] for x in found)


def group_sizes(longest: int) -> list[tuple[int, int, int]]:
    """(least period, end of periods, words): a run with a period of that range that crosses a
    boundary m has a group of so many words at m - 1, or ending at m, that stands again a period off.

    3 q words (24 at least) around m leave max(12, 1.5 q) to one side, and all
    places there but the last q have an equal word q further.  Sizes grow with the periods."""
    out, lo = [], 1
    while TIMES * lo <= longest:
        hi = max(16, 2 * lo)
        at_least = min(max(LEAST // 2, -(-TIMES * q // 2)) - q + 1 for q in (range(lo, hi) if lo == 1 else (lo,)))
        out.append((lo, hi, at_least))
        lo = hi
    return out


class Hashes:
    """64-bit hashes of stretches of words: equal stretches have equal ones, wherever they stand."""

    def __init__(self, w: np.ndarray):
        self.n = len(w)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(w.astype(np.uint64) + np.uint64(1)) * self.power[:-1], dtype=np.uint64)])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[at + size] - self.total[at]) * self.power[self.n - at]

    def equal(self, at: np.ndarray, q: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
        """How many words on from `at` (way 1) or back from it, at most `room`, equal those q further:
        that number or, if hashes collide, more."""
        done = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(room.max()).bit_length() - 1) if len(at) else 0
        while step:
            fits = done + step <= room
            a = np.where(fits, at + done if way > 0 else at - done - step, 0)
            k = np.where(fits, step, 0)
            done += np.where(fits & (self.of(a, k) == self.of(np.where(fits, a + q, 0), k)), step, 0)
            step >>= 1
        return done


def proposals(h64: Hashes, owner: np.ndarray, node: tuple, longest: int):
    """(node, period, place that equals the one a period further): what the groups next to the boundaries allow."""
    b, m, e, _ = node
    n = h64.n
    width = e - b
    places = np.arange(n)
    for lo, hi, size in group_sizes(longest):
        wide = np.flatnonzero(width >= np.maximum(LEAST, TIMES * lo))
        places = places[places <= n - size]
        if not len(wide) or not len(places):
            break
        with np.errstate(over="ignore"):
            h = mix64(h64.of(places, size) + owner[places].astype(np.uint64))
        # a group that stands once in its text stays out, here and as the start of longer groups
        twice = maybe_twice(h)
        places, h = places[twice], h[twice]
        by = np.argsort(h, kind="stable")
        hs = h[by]
        new = np.append(True, hs[1:] != hs[:-1])[:len(hs)]
        alone = new & np.append(new[1:], True)[:len(hs)]
        by, hs = by[~alone], hs[~alone]
        group = np.cumsum(np.append(False, hs[1:] != hs[:-1])[:len(hs)])
        by = places[by]  # equal groups are neighbours, by place
        turn = np.argsort(by)
        places = by[turn]
        if not len(places):
            break
        # right: the group that starts at m - 1 stands again q on;  left: the one that ends at m, q back
        for start, way in ((m[wide] - 1, 1), (m[wide] - size + 1, -1)):
            ok = (start >= b[wide]) & (start + size <= e[wide])
            who, s0 = wide[ok], start[ok]
            x = np.minimum(np.searchsorted(places, s0), len(places) - 1)
            ok = places[x] == s0
            who, s0, at = who[ok], s0[ok], turn[x[ok]]
            step = 0
            while len(who):
                step += 1
                j = at + way * step
                live = (j >= 0) & (j < len(by))
                j = np.where(live, j, at)
                q = (by[j] - s0) * way
                live &= (group[j] == group[at]) & (q < hi) & (TIMES * q <= width[who])
                hit = live & (by[j] >= b[who]) & (by[j] + size <= e[who]) & (q >= lo)
                if hit.any():
                    yield who[hit], q[hit], (m[who[hit]] - 1 if way > 0 else m[who[hit]] - q[hit])
                who, s0, at = who[live], s0[live], at[live]


def stretch(w: np.ndarray, b: int, e: int, q: int, i: int) -> tuple[int, int]:
    """The widest interval of [b, e) around places i and i + q whose words q apart are equal."""
    if i < b or i + q >= e or w[i] != w[i + q]:
        return i, i
    lo, step = i, 64
    while lo > b:
        part = w[max(b, lo - step):lo] == w[max(b, lo - step) + q:lo + q]
        bad = np.flatnonzero(~part)
        if len(bad):
            lo -= len(part) - 1 - int(bad[-1])
            break
        lo, step = lo - len(part), step * 4
    hi, step = i, 64
    while hi + q < e:
        end = min(e - q, hi + step)
        bad = np.flatnonzero(w[hi:end] != w[hi + q:end + q])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = end, step * 4
    return lo, hi + q


def crossing(w: np.ndarray, owner: np.ndarray, node: tuple):
    """Runs that cross a node's boundary, inside its stretch: (begin, end, period) of the tree
    nodes, which occur once, and (node, begin, end, period) of the rules."""
    b, m, e, rule = node
    h64, found = Hashes(w), [np.zeros((0, 5), np.int64)]
    if len(b):
        for who, q, at in proposals(h64, owner, node, int((e - b).max())):
            lo = at - h64.equal(at, q, at - b[who], -1)
            hi = at + h64.equal(at, q, e[who] - q - at, 1) + q
            keep = (hi - lo >= np.maximum(LEAST, TIMES * q)) & (lo < m[who]) & (m[who] < hi)
            found.append(np.stack([who, lo, hi, q, at], 1)[keep])
    found = np.concatenate(found)
    top, rest = thinned(found, rule)
    if not all(np.array_equal(w[lo:hi - q], w[lo + q:hi]) for lo, hi, q in [*top.tolist(), *rest[:, 1:].tolist()]):
        # two unlike groups share a hash: take every proposal's interval from the words themselves
        exact = [(x, *stretch(w, int(b[x]), int(e[x]), q, at), q, at) for x, _, _, q, at in found.tolist()]
        exact = [r for r in exact if r[2] - r[1] >= max(LEAST, TIMES * r[3]) and r[1] < m[r[0]] < r[2]]
        top, rest = thinned(np.array(exact, np.int64).reshape(-1, 5), rule)
    return top, rest


def thinned(found: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without intervals inside others (tree nodes), and with the smallest period of an interval."""
    once = rule[found[:, 0]] < 0
    rest = found[~once][:, :4]
    rest = rest[np.lexsort((rest[:, 3], rest[:, 2], rest[:, 1], rest[:, 0]))]
    if len(rest):
        rest = rest[np.append(True, (rest[1:, :3] != rest[:-1, :3]).any(axis=1))]
    return merged(found[once][:, 1:4]), rest


def translated(g: Grammar, node: tuple, top: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """(begin, end, period) in word places, at every occurrence of the nodes."""
    if not len(rest):
        return top
    b, _, _, rule = node
    t, rules = g.terminals, len(g.left)
    of = rule[rest[:, 0]]
    rel = rest[:, 1:].copy()
    rel[:, :2] -= b[rest[:, 0]][:, None]
    by = np.argsort(of, kind="stable")
    of, rel = of[by], rel[by]
    own = np.bincount(of, minlength=rules)
    first = np.cumsum(own) - own
    holds = np.zeros(t + rules, bool)  # symbols that hold a run somewhere below
    at = 0
    for made in g.rounds:
        r = np.arange(at, at + made)
        holds[t + r] = (own[r] > 0) | holds[g.left[r]] | holds[g.right[r]]
        at += made
    place = np.cumsum(g.size[g.start]) - g.size[g.start]
    sym, pos = g.start[holds[g.start]], place[holds[g.start]]
    out = [top]
    while len(sym):
        r = sym - t
        k = own[r]
        pick = np.repeat(first[r] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        got = rel[pick].copy()
        got[:, :2] += np.repeat(pos, k)[:, None]
        out.append(got)
        left, right = g.left[r], g.right[r]
        sym = np.concatenate([left, right])
        pos = np.concatenate([pos, pos + g.size[left]])
        sym, pos = sym[holds[sym]], pos[holds[sym]]
        if sum(map(len, out)) > 1 << 20:
            out = [merged(np.concatenate(out))]
    return np.concatenate(out)


def merged(runs: np.ndarray) -> np.ndarray:
    """Per period the intervals that lie in no other one; of equal intervals the smallest period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    shift = runs[:, 2] * (int(runs[:, 1].max()) + 1)  # a period's intervals end before the next one's begin
    reach = np.maximum.accumulate(runs[:, 1] + shift)
    keep = np.append(True, (runs[1:, 1] + shift[1:]) > reach[:-1])
    runs = runs[keep]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]


def runs_of(texts: list[list]) -> list[np.ndarray]:
    """For each text (a list of words) its runs as rows (start, end, period), by start, then period."""
    counts = np.array([len(t) for t in texts], np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for t in texts for w in t]
    ids = pd.factorize(flat)[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    g = Grammar(ids, owner, int(ids.max()) + 1 if len(ids) else 0)
    node = spans(g)
    runs = merged(translated(g, node, *crossing(ids, owner, node)))
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], np.append(first, int(counts.sum())))
    out = []
    for i in range(len(texts)):
        mine = runs[cut[i]:cut[i + 1]].copy()
        mine[:, :2] -= first[i]
        out.append(mine)
    return out


# ---------------------------------------------------------------- on Spark

def row(doc_id, words: list, runs: np.ndarray) -> tuple:
    best, text = None, []
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs.tolist():
        text.append(f"{s},{e - s},{q}\n")
        dropped[min(s + q, e)] += 1
        dropped[e] -= 1
        if best is None or (e - s) * best[2] > best[1] * q or (e - s) * best[2] == best[1] * q and (s, q) < (best[0], best[2]):
            best = (s, e - s, q)
    if best:
        kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()
        words = [words[i] for i in kept]
    digest = hashlib.sha256("".join(text).encode()).hexdigest()
    return (doc_id, len(runs), *(best if best else (None, None, None)), best[1] * 1000 // best[2] if best else None,
            digest, hashlib.sha256(b" ".join(words)).hexdigest())


def batches(rows) -> Iterator[list[tuple]]:
    """Rows (doc_id, words) in batches of about BATCH_WORDS words."""
    held, n = [], 0
    for doc_id, text in rows:
        words = planted(text.encode("utf-8", "surrogatepass").split(), doc_id) if text else []
        if held and n + len(words) > BATCH_WORDS:
            yield held
            held, n = [], 0
        held.append((doc_id, words))
        n += len(words)
    if held:
        yield held


def detect(docs: DataFrame) -> DataFrame:
    """The digests of every row's runs; a map over the rows, no shuffle."""
    def part(frames):
        def rows():
            for f in frames:
                ids = f["doc_id"]
                yield from zip([None if pd.isna(x) else int(x) for x in ids.tolist()], f["text"].tolist(), strict=True)
        for batch in batches(rows()):
            found = runs_of([w for _, w in batch])
            rows_out = [row(d, w, r) for (d, w), r in zip(batch, found, strict=True)]
            # nullable integers from the start: a float in between would lose digits
            yield pd.DataFrame({name: pd.array(col, "Int64") if kind == "long" else list(col)
                                for (name, kind), col in zip(columns, zip(*rows_out, strict=True), strict=True)})

    columns = [c.split() for c in SCHEMA.split(", ")]
    have = {c.lower() for c in docs.columns}
    d = docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"))])
    # a nullable long would pass through a float in pandas and lose digits
    d = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    return d.mapInPandas(part, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
