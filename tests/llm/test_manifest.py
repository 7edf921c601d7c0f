"""Operator 13 against a plain Merkle tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from conftest import SF_SMALL
from linewise.llm import op13_merkle as o13


def H(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def part(v) -> str:
    return "-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}"


def leaf(r, text):
    return H("".join(part(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes):
    """Root of nodes and, for each, its siblings (left, right) on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            lo = p // 8 * 8
            paths[i].append((nodes[lo:p], nodes[p + 1:lo + 8]))
        nodes = [H("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        crc = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
        l = leaf(r, r["text"])
        by[r["lang"]].append((-(1 << 63) if r["doc_id"] is None else r["doc_id"], l, leaf(r, low) if crc % 3 == 0 else l, r["doc_id"]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode("utf-8")))
    subs, ways = {}, {}
    for g in langs:
        by[g].sort(key=lambda x: x[:2])
        subs[g], ways[g] = climb([x[1] for x in by[g]])
    root, over = climb([subs[g] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for (_, l, t, doc_id), way in zip(by[g], ways[g]):
            way, h = way + over[k], t
            for left, right in way:
                h = H("".join(left) + h + "".join(right))
            out.append((doc_id, l, subs[g], root, H("".join("".join(a + b) for a, b in way)), h, h == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted([tuple(r) for r in o13.manifest(df).select(*COLUMNS).collect()], key=str)


def test_equals_a_plain_tree(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    found = got(docs)
    assert found == brute(docs.collect())
    assert {r[-1] for r in found} == {True, False}


def test_more_rounds_odd_ids_and_languages(spark, monkeypatch):
    """Small blocks, so that several rounds of slot arrays and directories are needed."""
    monkeypatch.setattr(o13, "LEVELS", 1)
    monkeypatch.setattr(o13, "BLOCK", 8)
    rows = [((i * 2654435761) % (1 << 62) - (1 << 61), f"T {i}", ["x", "yy", "é", "", None][i % 5] if i % 7 else "x", "S", i) for i in range(700)]
    rows += [(10 ** 6 + i, "one", f"lang{i:03d}", None, None) for i in range(75)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(df) == brute(df.collect())


@pytest.mark.parametrize("copies", [1, 3])
def test_nulls_ties_and_repeated_rows(spark, copies, monkeypatch):
    monkeypatch.setattr(o13, "BLOCK", 64)
    monkeypatch.setattr(o13, "LEVELS", 2)
    rows = [(None, None, None, None, None), (None, "A", None, "s", 1), (None, "B", "x", "s", 1), (5, "", "x", "", 0), (5, "AB", "x", "s", 2),
            (5, "ABC", "x", "s", 2), (6, "x" * 100_000, "x", "s", None), (-3, "é😀A", "x", None, 3), (1 << 62, "z", "x", "s", 1), (0, "O", "0", "s", 1)] * copies
    rows += [(7, "same", "x", "s", 4)] * (100 * copies)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(df.selectExpr("*", "1 as place", "'k' as key", "2 as total")) == brute(df.collect())


def test_empty_and_missing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert o13.manifest(empty).collect() == []
    few = spark.createDataFrame([(1, "Aa")], "doc_id long, text string")
    assert got(few) == brute([{"doc_id": 1, "text": "Aa", "lang": None, "source": None, "n_chars": None}])
