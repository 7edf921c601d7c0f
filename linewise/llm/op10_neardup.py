"""Embedding near-duplicates by collision-counting projections.

Every vector is projected on many random directions.  A pair collides in a
projection if one value lies in the window centred on the other (half-width
WINDOW standard deviations of the difference of a pair just at the threshold).
Pairs that collide in at least `l` of the counted projections are verified by
cosine in double precision; `l` is calibrated: the largest count that keeps
RECALL of synthetic pairs exactly at the threshold.

How Spark spreads the counting: equal vectors collapse to one.  In each of T
tables the sorted values of k projections are cut into slabs (with a random
offset each), and vectors that share all k slabs meet in one task, where their
collisions are counted.  k grows with the logarithm of the number of vectors so
that few unlike vectors meet; T then follows from the recall wanted.  A pair
that meets in several tables is counted in the first only, so links are summed
without listing pairs.  A meeting place of more than BLOCK vectors is dealt
over pairs of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of unlike
length are never compared; repeated vectors link; a row without vec_id has a
null component and is not kept, but counts as a link of others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import mix64, read, written
from linewise.llm.components import connected
from linewise.llm.op4_jaccard import Forest, joined_runs

COSINE, RECALL = 0.95, 0.99
COUNTED, WINDOW, SLAB = 64, 0.8, 4.0  # counted projections; half-widths in standard deviations of a threshold pair
BLOCK, SEED = 1024, 20240607


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def spread(cosine: float) -> float:
    """Standard deviation of the difference of a threshold pair's projections."""
    return math.sqrt(2 - 2 * cosine)


def tables(n: int, recall: float = RECALL) -> tuple[int, int]:
    """(k, T).  A threshold pair shares a slab of SLAB deviations with
    probability 1 - E|d| / SLAB; unlike unit vectors with about a third."""
    near = 1 - math.sqrt(2 / math.pi) / SLAB
    k = max(2, math.ceil(math.log(max(n, 2) / 8) / math.log(3)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k)) if near ** k < recall else 1


def least_count(dim: int, cosine: float, recall: float = RECALL, trials: int = 4000) -> int:
    """The largest count that `recall` of random pairs at the threshold reach."""
    if dim < 2:
        return 0
    g = np.random.default_rng([SEED, dim, 7])
    a, b = g.standard_normal((trials, dim)), g.standard_normal((trials, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(1 - cosine ** 2) * b
    hits = (np.abs((a - b) @ directions(dim, COUNTED, SEED)) <= WINDOW * spread(cosine)).sum(axis=1)
    return int(np.quantile(hits, 1 - recall, method="lower"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, k: int, t: int, cosine: float) -> np.ndarray:
    """(rows, T) 64-bit names of the meeting places of unit vectors."""
    dim = x.shape[1]
    width = SLAB * spread(cosine)
    offset = np.random.default_rng([SEED, dim, 1]).uniform(0, width, k * t)
    slab = np.floor((x @ directions(dim, k * t, SEED + 1) + offset) / width).astype(np.int64).reshape(len(x), t, k)
    name = np.broadcast_to(mix64(np.arange(t, dtype=np.uint64) + np.uint64(dim << 20)), (len(x), t)).copy()
    with np.errstate(over="ignore"):
        for j in range(k):
            name = mix64(name * np.uint64(31) + slab[:, :, j].astype(np.uint64))
    return name.view(np.int64)


def usable(col: str):
    c = F.col(col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def links(reps: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """From reps(rep, many, v array<double>): rows (a, b, links): `links` sums
    to the linked vectors of a; b is a member of a's component."""
    k, t = tables(n)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].map(len).to_numpy()
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for a in range(0, len(at), 2000):
                    rows = b.iloc[at[a:a + 2000]]
                    x = np.stack(rows["v"].to_list()).astype(np.float64)
                    cells = cells_of(unit(x), k, t, cosine)
                    yield pd.DataFrame({"rep": np.repeat(rows["rep"].to_numpy(), t), "many": np.repeat(rows["many"].to_numpy(), t),
                                        "key": cells.ravel(), "tab": np.tile(np.arange(t), len(rows)),
                                        "cells": np.repeat(np.array([c.tobytes() for c in cells], dtype=object), t),
                                        "v": np.repeat(np.array([r.tobytes() for r in x], dtype=object), t)})

    dealt = written(reps.mapInPandas(deal, "rep long, many long, key long, tab int, cells binary, v binary"), "op10-dealt")
    full = dealt.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    # a crowded place: every pair of blocks is a place of its own
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    rows = dealt.join(full, "key").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("key", F.when(blocks == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))))
    rows = rows.withColumn("cross", F.col("own") != F.col("other")).repartition("key").sortWithinPartitions("key", "own", "rep")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[int, int] = {}
        window = WINDOW * spread(cosine)
        for b in joined_runs(batches, 5000):
            key, rep, many, tab = (b[c].to_numpy() for c in ("key", "rep", "many", "tab"))
            own, cross = b["own"].to_numpy(), b["cross"].to_numpy()
            total, forest = dict.fromkeys(rep.tolist(), 0), Forest()
            dims = b["v"].map(len).to_numpy() // 8
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                least.setdefault(dim, least_count(int(dim), cosine))
                x = unit(np.frombuffer(b"".join(b["v"].iloc[at]), np.float64).reshape(-1, dim))
                cell = np.frombuffer(b"".join(b["cells"].iloc[at]), np.int64).reshape(len(at), -1)
                u = (x @ directions(int(dim), COUNTED, SEED)).astype(np.float32)
                kk, step = key[at], 1
                while True:  # all rows `step` apart in one place at once
                    i = np.flatnonzero(kk[step:] == kk[:-step]) if step < len(kk) else np.zeros(0, int)
                    if not len(i):
                        break
                    for a in range(0, len(i), 20_000):
                        p = i[a:a + 20_000]
                        q = p + step
                        # of one block's rows in a place of two blocks only pairs across count
                        ok = ~(cross[at[p]] & (own[at[p]] == own[at[q]]))
                        ok[ok] = (np.abs(u[p[ok]] - u[q[ok]]) <= window).sum(axis=1) >= least[dim]
                        p, q = p[ok], q[ok]
                        first = (cell[p] == cell[q]).argmax(axis=1) == tab[at[p]]
                        p, q = p[first], q[first]
                        good = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                        for r, s in zip(at[p[good]].tolist(), at[q[good]].tolist()):
                            total[rep[r].item()] += many[s].item()
                            total[rep[s].item()] += many[r].item()
                            forest.join(rep[r].item(), rep[s].item())
                    step += 1
            got = [r for r, n_links in total.items() if n_links]
            if got:
                yield pd.DataFrame({"a": got, "b": [forest.find(r) for r in got], "links": [total[r] for r in got]})

    return written(rows.mapInPandas(count, "a long, b long, links long"), "op10-links")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable("v"), F.col("v"))).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    # equal vectors collapse (partial aggregation first); `rep` names a vector by its hash
    reps = written(rows.filter("v is not null").groupBy(F.col("h").alias("rep")).agg(
        F.count("*").alias("many"), F.min("vec_id").alias("low"), F.first("v").alias("v")), "op10-reps")
    found = links(reps.select("rep", "many", "v"), reps.count(), cosine)
    total = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected(found.select("a", "b"), "op10-roots").select(F.col("node").alias("rep"), "root")
    named = (reps.select("rep", "many", "low").join(total, "rep", "left").join(roots, "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    lowest = named.groupBy("root").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "root").select(F.col("rep").alias("h"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "lowest")
    out = rows.select("vec_id", "h").join(named, "h", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("lowest", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
