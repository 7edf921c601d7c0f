"""Exact n-gram Jaccard join by count vectors in an R-tree.

A document's set is its distinct 4-word shingles (as 64-bit hashes).  Hashing
them into groups makes it a point, the counts per group.  Two sets share at
most the sum over groups of the smaller count; for a tree node the greatest
counts of its points stand in, so whole nodes drop out.  Pairs that pass are
verified on the sets themselves.

How Spark spreads the work, without losing a link:
1. Equal sets collapse to one representative (the smallest doc_id).
2. The tree's top level is a split by rare shingle: sets that link share one of
   their first n - ceil(0.85 n) + 1 shingles in any fixed order.  The order
   puts the commonest shingles (a bounded list) last, so buckets stay small.
   A set whose next smaller and next larger ones in the bucket are too far off
   in size links with none there and leaves it before vectors travel; buckets
   that hold the same sets are searched once.  In each bucket an R-tree over the
   count vectors finds the pairs whose bound passes; a task sends on only a
   spanning forest of its pairs.
3. Components of that candidate graph hold every link.  Each document's text
   goes once to its candidate component, where the R-tree join is repeated and
   every surviving pair is verified exactly, unless both are known connected.
4. Components beyond `BLOCK` documents are dealt over blocks, each with the
   component's smallest document; what a block does not connect to that one is
   dealt over blocks as well, and pairs of blocks are compared: two blocks of
   about `BLOCK` documents to a task.

A bucket of more than `HOT` sets is not searched in one task: its sets are
connected unchecked (a superset of its links; step 3 decides).

Defined results: documents without words (null and empty texts too) have 0
shingles, link with nothing and are their own component; repeated rows are
equal sets; rows without doc_id get the component of their equals, else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from linewise.llm.common import marked, mix64, read, words_of, written
from linewise.llm.components import connected

WORDS, SHARE = 4, 85          # shingle length; link where 100 * both >= SHARE * either
COMMON = 1 << 17              # commonest shingles, put last in the order: a speed setting
HOT, BLOCK = 4096, 1024       # sets of a bucket, documents of a block
GROUPS, MANY_GROUPS, LARGE = 64, 1024, 1024  # groups of a small and of a large set; size from which a set is large
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    ws = words_of(text)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        s = sum((h[i:i + n] * _P[i % 4] + np.uint64(i) for i in range(k)), np.zeros(n, np.uint64))
    return np.unique(mix64(s))


def vector(s: np.ndarray) -> np.ndarray:
    """Counts per group: the top bits of the hash, so that large vectors fold
    into small ones.  255 stands for 255 or more."""
    bits = 64 - (GROUPS if len(s) <= LARGE else MANY_GROUPS).bit_length() + 1
    return np.minimum(np.bincount((s >> np.uint64(bits)).astype(np.int64), minlength=1 << (64 - bits)), 255).astype(np.uint8)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(mix64(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(s ^ _P[1])).view(np.int64))


def required(a, b, share: int = SHARE):
    """Least overlap of linked sets of sizes a and b: 100 o >= share (a + b - o)."""
    return -(-share * (a + b) // (100 + share))


class Points:
    """Count vectors of a bucket as a bulk-loaded R-tree: points sorted by size
    and first counts, packed into leaves that keep the greatest counts and the
    range of sizes."""

    LEAF = 32

    def __init__(self, size: np.ndarray, raw: list[bytes]):
        n = len(size)
        self.size = size.astype(np.int64)
        small = np.empty((n, GROUPS), np.int32)
        self.wide: dict[int, np.ndarray] = {}
        for i, r in enumerate(raw):
            v = np.frombuffer(r, np.uint8).astype(np.int32)
            v[v == 255] = 1 << 24
            if len(v) > GROUPS:
                self.wide[i] = v
                v = np.minimum(v.reshape(GROUPS, -1).sum(axis=1), 1 << 24)
            small[i] = v
        self.small = small
        self.order = np.lexsort((small[:, 1], small[:, 0], self.size))
        first = np.arange(0, n, self.LEAF)
        self.leaf_top = np.maximum.reduceat(small[self.order], first, axis=0)
        s = self.size[self.order]
        self.leaf_low, self.leaf_high = s[first], np.maximum.reduceat(s, first)

    def near(self, i: int, root: np.ndarray | None = None, share: int = SHARE) -> np.ndarray:
        """Points whose bound with point i passes, best bound first; those
        already connected with i (equal root) are left out."""
        n, v = self.size[i], self.small[i]
        leaves = np.flatnonzero((100 * self.leaf_high >= share * n) & (share * self.leaf_low <= 100 * n))
        if len(leaves):
            bound = np.minimum(self.leaf_top[leaves], v).sum(axis=1)
            leaves = leaves[bound >= required(n, self.leaf_low[leaves], share)]
        if not len(leaves):
            return leaves
        at = self.order[(leaves[:, None] * self.LEAF + np.arange(self.LEAF)).ravel().clip(max=len(self.order) - 1)]
        at = np.unique(at[at != i]) if root is None else np.unique(at[root[at] != root[i]])
        bound = np.minimum(self.small[at], v).sum(axis=1)
        need = required(n, self.size[at], share)
        ok = bound >= need
        at, bound, need = at[ok], bound[ok], need[ok]
        if i in self.wide and len(at):
            w = self.wide[i]
            for k, j in enumerate(at.tolist()):
                if j in self.wide:
                    bound[k] = np.minimum(w, self.wide[j]).sum()
            ok = bound >= need
            at, bound = at[ok], bound[ok]
        return at[np.argsort(-bound, kind="stable")]


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, top = self.up, x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, from batches sorted by key."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if b.empty:
            continue
        k = b[key].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        last = cut[-1] if len(cut) else 0
        for x, y in zip(np.append(0, cut[:-1]), cut):
            yield b.iloc[x:y]
        rest = b.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def common_shingles(docs: DataFrame, k: int, limit: int) -> np.ndarray:
    """The commonest shingles, rarest first, at most `limit` (8 bytes each):
    only the order of shingles depends on them, never a result."""

    def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, sets = set(), []
            for t in b["text"]:
                s = shingles(t, k)
                mark = hash(s.tobytes())
                if mark not in seen:  # copies in a batch count once
                    seen.add(mark)
                    sets.append(s)
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                h, n = h[n >= 5], n[n >= 5]
                yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    top = (docs.select("text").mapInPandas(often, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "h").limit(limit).collect())
    return np.array([r["h"] for r in reversed(top)], dtype=np.int64).view(np.uint64)


def sets_of(docs: DataFrame, k: int, share: int, common: np.ndarray) -> DataFrame:
    """doc_id, row (a number), n, f1, f2 (fingerprint of the set), keys (the first
    shingles in the order), v (count vector)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    @F.pandas_udf("n long, f1 long, f2 long, keys array<long>, v binary")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        order = np.argsort(shared.value)
        known = shared.value[order]
        for texts in it:
            rows = []
            for t in texts:
                s = shingles(t, k)
                n = len(s)
                first = n - (share * n + 99) // 100 + 1 if n else 0
                at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                rank = np.where(known[at] == s, order[at] + 1, 0) if len(known) else np.zeros(n, np.int64)
                keys = s[np.argsort(rank, kind="stable")[:first]]
                rows.append((n, *fingerprint(s), keys.view(np.int64), vector(s).tobytes() if n else b""))
            yield pd.DataFrame(rows, columns=["n", "f1", "f2", "keys", "v"])

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), run("text").alias("s")).select("doc_id", "row", "s.*")


def size_meets(n: Column, by_size: WindowSpec, share: int) -> Column:
    """Whether the next smaller or the next larger set of a bucket could link
    with this one by size; if neither could, none in the bucket could."""
    smaller, larger = F.lag(n).over(by_size), F.lead(n).over(by_size)
    return F.coalesce(100 * smaller >= share * n, F.lit(False)) | F.coalesce(100 * n >= share * larger, F.lit(False))


def candidate_edges(reps: DataFrame, share: int) -> DataFrame:
    """(a, b): a graph whose components hold every link of reps(rep, n, keys, v)."""
    by_size = Window.partitionBy("key").orderBy("n")
    bucket = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entries = reps.select(F.explode("keys").alias("key"), "rep", "n").select(
        "key", "rep", "n", F.count("*").over(bucket).alias("many"), F.min("rep").over(bucket).alias("b"), size_meets(F.col("n"), by_size, share).alias("meets"))
    # near copies share most of their shingles, so many buckets hold the same sets; such buckets are one from here
    # on, named by their members (should two names be equal by chance, that bucket holds the members of both)
    members = F.bit_xor(F.when(F.col("meets"), F.xxhash64("rep"))).over(Window.partitionBy("key"))
    hits = written(entries.filter("many > 1").withColumn("members", members).drop("key"), "op4-hits")
    hot = hits.filter(F.col("many") > HOT).select(F.col("rep").alias("a"), "b").filter("a != b").distinct()
    held = hits.filter((F.col("many") <= HOT) & F.col("meets")).select(F.col("members").alias("key"), "rep", "n").repartition("rep").distinct()
    rows = held.join(reps.select("rep", "v"), "rep").repartition("key").sortWithinPartitions("key", "n", "rep")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for b in joined_runs(batches):
            key, rep, size = b["key"].to_numpy(), b["rep"].to_numpy(), b["n"].to_numpy()
            v = b["v"].tolist()
            points = Points(size, v)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(start, len(key)))
            short = np.repeat(length <= Points.LEAF, length)
            for k in range(1, Points.LEAF):  # buckets of one leaf: all rows k apart at once
                i = np.flatnonzero((key[k:] == key[:-k]) & short[k:])
                if not len(i):
                    break
                for a in range(0, len(i), 65536):
                    x = i[a:a + 65536]
                    y = x + k
                    need = required(size[x], size[y], share)
                    ok = (100 * size[x] >= share * size[y]) & (np.minimum(points.small[x], points.small[y]).sum(axis=1) >= need)
                    for p, q, t in zip(x[ok].tolist(), y[ok].tolist(), need[ok].tolist()):
                        if p in points.wide and q in points.wide and np.minimum(points.wide[p], points.wide[q]).sum() < t:
                            continue
                        forest.join(rep[p].item(), rep[q].item())
            for s, m in zip(start[length > Points.LEAF], length[length > Points.LEAF]):
                bucket = Points(size[s:s + m], v[s:s + m])
                ids = rep[s:s + m].tolist()
                root = np.array([forest.find(r) for r in ids])
                for i in range(m):
                    while True:
                        near = bucket.near(i, root, share)
                        if not len(near):
                            break
                        for j in near.tolist():
                            if root[i] != root[j]:
                                low, high = sorted((root[i].item(), root[j].item()))
                                forest.join(low, high)
                                root[root == high] = low
        nodes = list(forest.up)
        if nodes:
            yield pd.DataFrame({"a": nodes, "b": [forest.find(x) for x in nodes]})

    return hot.unionByName(rows.mapInPandas(search, "a long, b long").filter("a != b"))


def joined_runs(batches: Iterator[pd.DataFrame], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Whole keys, several to a frame of at least `least` rows where there are as many."""
    held, n = [], 0
    for r in whole_keys(batches):
        held.append(r)
        n += len(r)
        if n >= least:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut at the last change of key."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if b.empty:
            continue
        k = b["key"].to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1])
        if not len(cut):
            rest = b
            continue
        yield b.iloc[:cut[-1] + 1]
        rest = b.iloc[cut[-1] + 1:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def exact_roots(ids: list[int], sets: list[np.ndarray], share: int, asking: list[bool] | None = None) -> list[int]:
    """For each document the smallest one that verified links connect it to.
    Pairs already connected are not verified again.  asking: only links of those
    that ask with those that do not are looked for."""
    points = Points(np.array([len(s) for s in sets]), [vector(s).tobytes() for s in sets])
    root = np.array(ids)
    for i in range(len(ids)):
        if asking is not None and not asking[i]:
            continue
        for j in points.near(i, root, share).tolist():
            if root[i] != root[j] and (asking is None or not asking[j]) and linked(sets[i], sets[j], share):
                low, high = min(root[i], root[j]), max(root[i], root[j])
                root[root == high] = low
    return root.tolist()


def verified_edges(docs: DataFrame, reps: DataFrame, candidates: DataFrame, k: int, share: int) -> DataFrame:
    """(a, b) edges whose components are exactly those of the links, from
    docs(doc_id, text), reps(rep, doc_id) and candidates(node, root)."""
    sizes = candidates.groupBy("root").agg(F.count("*").alias("many"))
    held = candidates.join(sizes, "root").select(F.col("node").alias("rep"), F.col("root").alias("comp"), "many")
    wanted = written(reps.select("rep", "doc_id").join(held, "rep"), "op4-wanted")
    # only texts of members travel
    texts = marked(docs, "doc_id", wanted.select("doc_id"), "wanted").filter("wanted").drop("wanted")
    rows = written(texts.join(wanted, "doc_id").drop("doc_id"), "op4-members")
    block = F.when(F.col("many") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("many") / BLOCK))).cast("long")
    dealt = rows.withColumn("block", block)
    # the component's smallest document goes to every block
    pivot = (rows.filter((F.col("many") > BLOCK) & (F.col("rep") == F.col("comp")))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("many") / BLOCK) - 1).cast("long")))))
    first = dealt.filter(~((F.col("many") > BLOCK) & (F.col("rep") == F.col("comp")))).unionByName(pivot).withColumn("ask", F.lit(True))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["comp", "block"]):
            one = {}
            for rep, text, ask in zip(g["rep"].tolist(), g["text"], g["ask"].tolist()):
                s = shingles(text, k)
                if fingerprint(s)[0] == rep:  # another text under the same doc_id is no member
                    one[rep] = s, ask
            ids, ask = list(one), [x[1] for x in one.values()]
            roots = exact_roots(ids, [x[0] for x in one.values()], share, None if all(ask) else ask)
            yield pd.DataFrame({"a": ids, "b": roots, "comp": g["comp"].iloc[0], "many": g["many"].iloc[0]})

    out = "a long, b long, comp long, many long"
    near = lambda df: df.select("comp", "block", "many", "rep", "ask", "text").repartition("comp", "block").sortWithinPartitions("comp", "block", "rep").mapInPandas(join, out)
    once = written(near(first), "op4-verified")
    left = once.filter((F.col("many") > BLOCK) & (F.col("b") != F.col("comp"))).select(F.col("a").alias("rep"), "comp").distinct()
    again = near(block_pairs(dealt.filter(F.col("many") > BLOCK), left))
    return once.unionByName(again).select("a", "b").filter("a != b")


def block_pairs(dealt: DataFrame, left: DataFrame) -> DataFrame:
    """dealt(rep, comp, many, block, text) once for each pair of blocks it is
    in (block names the pair), those that ask being the first of the two.  The
    blocks of left(rep, comp) come first; they meet each other and the blocks
    of all others."""
    mine = (left.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("firsts")))
    rows = dealt.join(mine, "comp").join(left.select("rep", F.lit(True).alias("is_left")), "rep", "left").withColumn("is_left", F.coalesce("is_left", F.lit(False)))
    own = F.when(F.col("is_left"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("firsts"))).otherwise(F.col("firsts") + F.col("block"))
    every = F.col("firsts") + F.ceil(F.col("many") / BLOCK).cast("long")
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("is_left"), every).otherwise(F.col("firsts")) - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(meets))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("block", F.shiftleft(low, 32) + high).withColumn("ask", F.col("own") == low).select("comp", "block", "many", "rep", "ask", "text")


def components(docs: DataFrame, k: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(sets_of(docs, k, share, common_shingles(docs, k, COMMON)), "op4-sets")
    # equal sets collapse; only names travel, keys and vectors stay where they were written
    reps = written(sets.filter("n > 0").groupBy(F.col("f1").alias("rep"), "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")), "op4-reps")
    one = marked(sets, "row", reps.select("row"), "one", exact=True).filter("one").select(F.col("f1").alias("rep"), "n", "keys", "v")
    maybe = connected(candidate_edges(one, share), "op4-candidates")
    roots = connected(verified_edges(docs, reps, maybe, k, share), "op4-links").select(F.col("node").alias("rep"), "root")
    member = reps.select("rep", "doc_id").join(roots, "rep", "left").select("rep", "doc_id", F.coalesce("root", "rep").alias("root"))
    smallest = member.groupBy("root").agg(F.min("doc_id").alias("low"))
    named = member.join(smallest, "root").select(F.col("rep").alias("f1"), "low")
    rows = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1")).join(named, "f1", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents").select("doc_id", "text"))
