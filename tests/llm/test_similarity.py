"""Operators 2, 4 and 10 and the pipeline against brute force."""

import contextlib
import io
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from linewise.llm import common
from linewise.llm import op2_lm as o2
from linewise.llm import op4_jaccard as o4
from linewise.llm import op10_neardup as o10
from linewise.llm.attention import WINDOW, Attention, huffman
from linewise.llm.components import connected


def grouped(nodes, pairs):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(t, k=4):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def made_documents():
    g = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one two three"), (5, " \n")]
    n = 10
    for size in (30, 120, 1500):
        for _ in range(4):
            base = [g.choice(vocab) for _ in range(size)]
            for copy in range(6):
                w = list(base)
                for _ in range(copy * max(1, size // 90)):
                    w[g.randrange(size)] = g.choice(vocab)
                rows.append((n, " ".join(w)))
                n += 1
    for _ in range(2):  # twelve texts of one base, each with one word changed: all link
        base = [g.choice(vocab) for _ in range(300)]
        for _ in range(12):
            w = list(base)
            w[g.randrange(300)] = g.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    passage = " ".join(g.choice(vocab) for _ in range(60))
    rows += [(n + i, passage + " " + " ".join(g.choice(vocab) for _ in range(20 + i))) for i in range(25)]
    return rows


def brute_components(rows, share=85, k=4):
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[:x]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    return sets, grouped(ids, pairs)


@pytest.mark.parametrize("hot,block", [(4096, 1024), (2, 3)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, hot, block):
    """Also with buckets and components so small that all of the dealing over blocks is used."""
    monkeypatch.setattr(o4, "HOT", hot)
    monkeypatch.setattr(o4, "BLOCK", block)
    rows = made_documents()
    sets, want = brute_components(rows)
    df = spark.createDataFrame([*rows, rows[20], (None, rows[30][1])], "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = o4.components(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == want[rows[30][0]]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert len(set(want.values())) < len(want) - 20


def test_jaccard_unlinked_component_meets_in_bounded_groups(spark, monkeypatch):
    """A component of 600 sets, 400 of them without a link to its smallest: each
    pair of sets that may link meets once, and no group holds nearly all."""
    monkeypatch.setattr(o4, "BLOCK", 50)
    rows = [(i, 0, 600, i % 12, f"t{i}") for i in range(600)]
    dealt = spark.createDataFrame(rows, "rep long, comp long, many long, block long, text string")
    left = dealt.filter("rep >= 200").select("rep", "comp")
    groups = {}
    for r in o4.block_pairs(dealt, left).collect():
        groups.setdefault(r["block"], []).append((r["rep"], r["ask"]))
    assert max(map(len, groups.values())) <= 4 * 50
    met = Counter()
    for g in groups.values():
        asks, rest = [r for r, a in g if a], [r for r, a in g if not a]
        met.update((min(a, b), max(a, b)) for a in asks for b in (rest or asks) if a != b)
    assert set(met) >= {(a, b) for b in range(200, 600) for a in range(b)}


def test_jaccard_empty_table(spark):
    assert o4.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bound_never_below_overlap():
    g = np.random.default_rng(1)
    for n in (3, 50, 900, 1100, 5000):
        a = np.unique(g.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n * 9 // 10], g.integers(0, 2 ** 63, n // 10 + 1, dtype=np.uint64)]))
        p = o4.Points(np.array([len(a), len(b)]), [o4.vector(a).tobytes(), o4.vector(b).tobytes()])
        assert np.minimum(p.small[0], p.small[1]).sum() >= len(np.intersect1d(a, b))
        if o4.linked(a, b):
            assert p.near(0).tolist() == [1]


def test_connected(spark):
    g = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(g.randrange(200, 400), g.randrange(200, 400)) for _ in range(90)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    want = grouped({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    g = np.random.default_rng(7)
    base = g.normal(size=(120, 32))
    v = [base, base[:40] + 0.03 * g.normal(size=(40, 32)), base[:40] + 0.06 * g.normal(size=(40, 32)), base[5:6] * 3, np.repeat(base[:1], 30, axis=0)]
    x = np.concatenate(v)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [None] + [1.0] * 31), (1005, [float("inf")] * 32),
           (1006, [1.0, 2.0])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = grouped(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near) if a > b])
    for block in (1024, 4):
        monkeypatch.setattr(o10, "BLOCK", block)
        df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("links", F.lit(1))
        got = {r["vec_id"]: r for r in o10.near_duplicates(df).collect()}
        assert len(got) == len(rows) + len(odd)
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
        found = sum(got[i]["n_links"] for i in range(len(x)))
        assert found >= 0.97 * (near.sum() - len(x))
        assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(len(x)))
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))
        if found == near.sum() - len(x):
            assert all(got[i]["component_id"] == want[i] for i in range(len(x)))
    assert o10.near_duplicates(df.limit(0)).count() == 0


def test_attention_probabilities_sum_to_one_and_gradient_is_right():
    counts = np.array([50, 20, 9, 4, 2, 1, 7])
    m = Attention(counts)
    g = np.random.default_rng(2)
    m.p["node"] = g.normal(size=m.p["node"].shape).astype(np.float32)
    h = g.normal(size=(1, 16)).astype(np.float32)
    total = sum(np.exp(m.log_probability(h, np.array([i]))[0])[0] for i in range(7))
    assert abs(total - 1) < 1e-5
    first, nodes, signs, bias = huffman(counts)
    m0 = Attention(counts)
    p = np.array([np.exp(m0.log_probability(np.zeros((1, 16), np.float32), np.array([i]))[0])[0] for i in range(7)])
    assert np.allclose(p, (counts + 1) / (counts + 1).sum(), atol=1e-5)
    w = g.integers(0, 7, size=(3, WINDOW + 1))
    on = np.ones((3, WINDOW), bool)
    _, grad = m.gradient(w[:, :-1], w[:, 1:], on)
    for name in ("wq", "wo", "w1", "emb", "node", "bias", "pos"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, e, loss = m.p[name][at], 1e-2, []
        for d in (e, -e):
            m.p[name][at] = old + d
            loss.append(m.gradient(w[:, :-1], w[:, 1:], on)[0])
        m.p[name][at] = old
        assert abs((loss[0] - loss[1]) / (2 * e) - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-4


def test_each_token_is_scored_once_with_its_window():
    m = Attention(np.arange(1, 12))
    g = np.random.default_rng(4)
    m.p["node"] = (0.5 * g.normal(size=m.p["node"].shape)).astype(np.float32)
    texts = [g.integers(0, 11, size=n) for n in (1, 5, 31, 32, 33, 60, 61, 200)]
    got, at = m.score(texts, 10)[0], 0
    from linewise.llm.attention import STRIDE
    for t in texts:
        source = np.append([10], t[:-1])
        for i in range(len(t)):
            k = 0 if i < WINDOW else (i - WINDOW) // STRIDE + 1
            ids = source[k * STRIDE:i + 1][None, :]
            _, h = m.head(m.states(ids)["h1"][0, -1:])
            assert abs(m.log_probability(h, t[i:i + 1])[0][0] - got[at + i]) < 1e-3
        at += len(t)
    assert at == len(got)


def test_lm_base_score(spark):
    rows = [(i, " ".join(random.Random(i).choice(["aa", "Bb", "cc dd", "é"]) for _ in range(40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "zz zz unseen"), (103, "x" * 3000), (104, "aa bb"), (104, "aa bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 5 != 1
    got = o2.score(df, train, rates=(0.01,)).collect()
    c = Counter(w for i, t in rows if i % 5 != 1 for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ws = [*(text[r["doc_id"]] or "").encode().lower().split(), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and math.isfinite(r["score"]) and r["score"] < 0
    assert o2.score(df.limit(0), train).count() == 0
    assert o2.score(df.filter("doc_id = 101"), F.lit(False)).count() == 1


def test_lm_word_probabilities_sum_to_one():
    """All words of ids 0, 1 (which go on) after 2 or 3 (which begin), and the end 4."""
    m = Attention(np.array([9, 5, 7, 2, 3]), np.array([False, False, True, True, True]))
    g = np.random.default_rng(8)
    m.p["node"] = g.normal(size=m.p["node"].shape).astype(np.float32)
    before, total = [2, 1], 0.0
    for long in range(5):
        for word in itertools.product((2, 3), *[(0, 1)] * long):
            ids = np.array([*before, *word, 4])
            lp, root = m.score([ids], 4)
            each = np.array([2, len(word), 1])
            total += math.exp(o2.of_words(lp, root, [each])[1])
            if long == 4:  # all that is longer: the same prefix, and no new word
                total += math.exp(lp[2:2 + len(word)].sum() - root[2]) * (1 - math.exp(root[-1]))
    lp, root = m.score([np.array([2, 1, 4])], 4)
    total += math.exp(o2.of_words(lp, root, [np.array([2, 1])])[1])
    assert abs(total - 1) < 1e-4


def test_lm_score_against_brute_force(spark, monkeypatch):
    g, made = np.random.default_rng(9), []

    def some_model(windows, counts, starts, *a):
        m = Attention(counts, starts)
        m.p["node"] = (0.3 * g.normal(size=m.p["node"].shape)).astype(np.float32)
        made.append(m)
        return m

    monkeypatch.setattr(o2, "train_model", some_model)
    rows = [(i, " ".join(random.Random(i).choice(["aa", "Bb", "cc dd", "strange", "é"]) + "x" * (i % 7) for _ in range(i))) for i in range(1, 50)]
    rows += [(61, None), (66, "only\u00a0unseen .words"), (71, "y" * 300), (None, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("train", F.lit("x"))
    got = {r["doc_id"]: r for r in o2.score(df, F.coalesce("doc_id", F.lit(0)) % 5 != 1).collect()}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in words.items() if (i or 0) % 5 != 1 for w in ws)
    n, v, sub = sum(c.values()), len(c), o2.Subwords(o2.ranks())
    for i, ws in words.items():
        ids = [np.frombuffer(sub.end if w is None else sub.word(w), np.uint16).astype(int) for w in ws]
        lp, root = made[0].score([np.concatenate(ids)], sub.n)
        at, want, alone = 0, 0.0, 0.0
        for w, x in zip(ws, ids):
            log = lp[at:at + len(x)].sum() - root[at] + (0 if w is None else root[at + len(x)])
            at += len(x)
            alone += log / math.log(10)
            known = o2.MIX * (c[w] + 0.5) / (n + 0.5 * (v + 1)) if c[w] else 0.0
            want += np.logaddexp(math.log(1 - o2.MIX) + log, math.log(known) if known else -math.inf) / math.log(10)
        assert abs(got[i]["score"] - want) < 1e-5 * abs(want) and abs(got[i]["attention_score"] - alone) < 1e-5 * abs(alone)


def test_lm_beats_word_frequency_on_held_out_text(spark):
    """The attention model alone, and with word frequency mixed in."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    r = o2.score(docs, train).join(docs.filter(~train).select("doc_id"), "doc_id").agg(*[F.sum(x) for x in ("base_score", "attention_score", "score")]).collect()[0]
    assert r[0] < r[1] < r[2] < 0


def test_lm_trains_on_each_window_once_however_partitioned(spark, monkeypatch):
    g = random.Random(5)
    rows = [(i, " ".join(g.choice(["aa", "bb", "cc", "dd", "ee"]) + str(i) for _ in range(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, flats, train, whole = [], [], o2.train_model, o2.training_windows
    monkeypatch.setattr(o2, "training_windows", lambda *a: seen.append(whole(*a)) or seen[-1])
    monkeypatch.setattr(o2, "train_model", lambda *a: flats.append(train(*a).flat()) or train(*a))
    monkeypatch.setattr(o2, "FAN", 3)
    for parts in (1, 5):
        assert o2.score(df.repartition(parts), F.lit(True), (0.01, 0.005), 60).count() == 300
    a, b = ([(r["round"], r["h"], r["ids"]) for r in w.collect()] for w in seen)
    assert sorted(a) == sorted(b) and {r for r, *_ in a} == {0, 1} and len(set(a)) == len(a) > 4 * 60 * 2
    assert sum((np.frombuffer(ids, np.uint16)[1:] == o2.VOCABULARY).sum() for *_, ids in a) == 300  # ends
    assert np.array_equal(*flats)


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions against the operator's rule, on its own input."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF_SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        if name != "bpe":
            assert out.columns == columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            _, want = brute_components(rows, corpus_pipeline.SHINGLE_SHARE, corpus_pipeline.SHINGLE_WORDS)
            assert (corpus_pipeline.SHINGLE_SHARE, corpus_pipeline.SHINGLE_WORDS) == (80, 5)
            assert set(kept[name]) == set(want.values())
        before = out
    assert set(kept["quality"]) >= set(kept["near_duplicates"]) >= set(kept["decontaminate"]) == set(kept["pii"]) == set(kept["bpe"])
    assert all(r["n_tokens"] == len(r["ids"]) for r in kept["bpe"].values())
    assert not any("@mail" in r["text"] for r in kept["pii"].values())
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert not any(t in r["text"] for t in items for r in kept["decontaminate"].values())
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 0").collect()}
    assert len(bad & set(kept["quality"])) <= 0.1 * len(bad) + 1


def test_pipeline_takes_near_copies_of_five_words(spark):
    """Pairs between 0.80 and 0.85 at five words, with both sides of the border."""
    g = random.Random(17)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for n, size in enumerate((69, 90, 204, 400)):
        for changed in range(1, 13):  # the last words differ: one shingle each
            base = [g.choice(vocab) for _ in range(size)]
            other = base[:-changed * size // 90 or None] + [g.choice(vocab) for _ in range(changed * size // 90)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
        base = [g.choice(vocab) for _ in range(size)]  # changes inside the text cost five shingles each, or four
        for changed in range(5):
            w = list(base)
            for i in range(changed):
                w[(2 * i + 1) * size // 10] = "changed"
            rows.append((len(rows), " ".join(w)))
    sets = {i: shingle_set(t, 5) for i, t in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.80 <= x < 0.85 for x in share.values()) >= 5 and sum(0.75 <= x < 0.80 for x in share.values()) >= 5
    want = grouped(sorted(sets), [p for p, x in share.items() if x >= 0.8])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect()} == set(want.values())


def test_pipeline_accepts_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all here", None, None, None), (3, "same text twice over", "en", "s", 5),
            (3, "same text twice over", "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema).withColumn("score", F.lit("x")).withColumn("spans", F.lit("y")).withColumn("rep", F.lit(1))
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF_SMALL)
            got = out.collect()
            if name != "bpe":
                assert out.columns == df.columns
            if name == "near_duplicates" and len(got):
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "None"]


def test_crc_matches(spark):
    from linewise.llm.common import crc_mod
    got = spark.range(300).select("id", crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_marked_holds_every_id(spark):
    ids = spark.range(0, 30_000, 3).select((F.col("id") * 7919 - 5000).alias("x"))
    df = spark.range(30_000).select((F.col("id") * 7919 - 5000).alias("doc_id"), F.lit("t").alias("__bits")).unionByName(
        spark.createDataFrame([(None, "null")], "doc_id long, __bits string"))
    out = common.marked(df, "doc_id", ids, "hit")
    assert out.columns == ["doc_id", "__bits", "hit"] and out.filter("hit is null").isEmpty()
    got = {r["doc_id"]: r["hit"] for r in out.collect()}
    want = {r["x"] for r in ids.collect()}
    assert len(got) == 30_001 and all(got[i] for i in want)
    assert sum(got.values()) < len(want) + 100
    assert not any(r["hit"] for r in common.marked(df, "doc_id", ids.limit(0), "hit").collect())


def test_marked_exactly_marks_only_the_rows_given(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER", 8)  # hashed, nearly every row would be marked
    df = common.written(spark.range(0, 90_000, 1, 3).select("id", F.monotonically_increasing_id().alias("row")), "test-rows")
    ids = df.filter("id % 7 = 0 or id = 89999").select("row")
    got = {r["id"] for r in common.marked(df, "row", ids, "hit", exact=True).filter("hit").collect()}
    assert got == {i for i in range(90_000) if i % 7 == 0 or i == 89_999}


def test_buckets_of_the_same_sets_are_one(spark, monkeypatch):
    """Near copies meet in most of their rare shingles; their vectors go to one bucket for each set of
    members, and neither vectors nor shingles travel to find equal sets."""
    g = random.Random(12)
    rows = []
    for n in range(6):
        w = [g.choice("abcdefghij") + str(g.randrange(5000)) for _ in range(400)]
        rows += [(len(rows) + i, " ".join([*w[:30 * n], *["x%d" % i] * (i > 0), *w[30 * n:]])) for i in range(3)]
    rows += [(len(rows), rows[0][1]), (None, rows[0][1])]
    frames = {}
    monkeypatch.setattr(o4, "written", lambda df, name, *by: frames.setdefault(name, common.written(df, name, *by)))
    got = {r["doc_id"]: r["component_id"] for r in o4.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 3 * 3 if i is not None and i < 18 else 0 for i, _ in rows}
    assert not {"keys", "v"} & set(frames["op4-reps"].columns)
    hits = frames["op4-hits"]
    assert hits.count() > 500 and hits.select("members", "rep").distinct().count() < 100


def test_sets_that_no_size_meets_leave_their_bucket(spark):
    g = random.Random(5)
    rows = [(g.randrange(60), i, g.choice((1, 2, 9, 10, 12, 13, 40, 49, 50, 51, 62, 63, 900))) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, rep long, n long")
    for share in (80, 85):
        kept = df.withColumn("meets", o4.size_meets(F.col("n"), Window.partitionBy("key").orderBy("n"), share)).filter("meets")
        want = {a[1] for a in rows if any(a[0] == b[0] and a[1] != b[1] and 100 * min(a[2], b[2]) >= share * max(a[2], b[2]) for b in rows)}
        assert {r["rep"] for r in kept.collect()} == want and 0 < len(want) < len(rows)


def test_texts_of_documents_without_copies_do_not_travel(spark):
    """Repeated ids, null ids and copies are joined; the other rows stay in their partitions."""
    g = random.Random(9)
    text = lambda: " ".join(g.choice("abcdefghij") + str(g.randrange(500)) for _ in range(60))
    rows = [(i, text()) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1] + " end"), (7, rows[7][1]), (8, text()), (42, None), (42, None), (None, rows[5][1]), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL)
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            out.explain()
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {(i, t): 1 for i, t in rows if i is not None and i not in (8, 40, 41)}
    # two texts under one id: one row stays
    assert {k: n for k, n in got.items() if k[0] not in (8, None)} == {k: n for k, n in want.items()}
    assert sum(n for k, n in got.items() if k[0] == 8) == 1 and sum(n for k, n in got.items() if k[0] is None) == 2
    lines = plan.getvalue().splitlines()
    assert "+- Union" in lines  # its first branch holds the rows that stay
    at = lines.index("+- Union") + 1
    first = lines[at:next(i for i in range(at + 1, len(lines)) if lines[i].startswith("   :- "))]
    assert any("Filter" in x and "NOT" in x for x in first) and not any("Exchange hashpartitioning(doc_id" in x for x in first)
