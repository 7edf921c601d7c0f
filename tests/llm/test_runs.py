"""Operator 12 against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np

from conftest import SF_SMALL
from linewise.llm import op12_runs as o12


def plain_runs(w):
    """(start, end, period) of every run: each period's maximal intervals, the smallest period of each."""
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in best.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g, old = h // 10, list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            w[i] = old[a + (i - a) % p]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    s, e, q = top or (None, None, None)
    return (doc_id, len(runs), s, e - s if top else None, q, (e - s) * 1000 // q if top else None,
            sha("".join(f"{a},{b - a},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_text(rng, sizes):
    k = rng.choice([1, 2, 3, 5, 50])
    t = [rng.randrange(k) for _ in range(rng.choice(sizes))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(max(2, k)) for _ in range(rng.randrange(1, 25))]
        x = rng.randrange(len(t) + 1)
        t[x:x] = (unit * rng.randrange(1, 9))[:rng.randrange(10, 150)]
    return t


def test_runs_equal_a_search_over_all_periods():
    rng = random.Random(11)
    for _ in range(25):
        texts = [random_text(rng, [0, 1, 5, 30, 100, 300]) for _ in range(20)]
        for t, runs in zip(texts, o12.runs_of(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == sorted(plain_runs(t), key=lambda r: (r[0], r[2]))


def test_without_true_hashes_words_decide(monkeypatch):
    """Every group hashes alike: all is proposed, and the words still give the same runs."""
    monkeypatch.setattr(o12.Hashes, "of", lambda self, at, size: np.zeros(len(at), np.uint64))
    rng = random.Random(5)
    texts = [random_text(rng, [40, 60]) for _ in range(12)]
    for t, runs in zip(texts, o12.runs_of(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == sorted(plain_runs(t), key=lambda r: (r[0], r[2]))


def test_grammar_derives_the_texts_and_repeats_no_pair():
    rng = random.Random(2)
    texts = [random_text(rng, [0, 2, 50, 400]) for _ in range(30)]
    flat = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    g = o12.Grammar(flat, owner, int(flat.max()) + 1)

    def derive(x):
        r = int(x) - g.terminals
        return [int(x)] if r < 0 else derive(g.left[r]) + derive(g.right[r])
    assert len(g.start) < len(flat) // 2
    for i, t in enumerate(texts):
        s = g.start[g.owner == i].tolist()
        assert [w for x in s for w in derive(x)] == t
        seen = {}
        for j, pair in enumerate(zip(s, s[1:])):
            assert j - seen.setdefault(pair, j) < 2  # aaa holds aa twice, overlapping


def test_documents_and_any_batches(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted(plain_row(r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, o12.detect(docs).collect())) == want
    assert sum(r[1] > 0 for r in want) > 10
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(o12, "BATCH_WORDS", 50)
    small = [o12.row(d, w, r) for b in o12.batches(rows) for (d, w), r in zip(b, o12.runs_of([w for _, w in b]), strict=True)]
    assert sorted(small) == want


def test_odd_rows(spark):
    texts = [None, "", " \t\r\n\x0b\x0c", "a", "a " * 24, "a " * 23, "a b c " * 4000, "a\xa0b " * 30, "é日 " * 40 + "x " * 50, ("x y " * 12 + "x z ") * 9,
             "\x1c " * 30, " ".join(map(str, range(30_000)))]
    big = 9_007_199_254_740_993  # not a double
    data = [(big + i, t, 1, "c") for i, t in enumerate(texts)] + [(None, "q r " * 30, None, None), (None, None, None, None), (big, "a " * 30, 1, "c"), (big, "a " * 30, 1, "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_runs int, start string")
    key = lambda r: (r[0] is None, r[0] or 0, r[6:])
    want = sorted((plain_row(d, t) for d, t, *_ in data if not t or len(t) < 40_000), key=key)
    got = sorted(map(tuple, o12.detect(docs).collect()), key=key)
    assert len(got) == len(data)
    assert [r for r in got if r[0] != big + 11] == want
    assert next(r for r in got if r[0] == big + 11)[1] in (0, 1)
    assert o12.detect(docs.limit(0)).collect() == []
