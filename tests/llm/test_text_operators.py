"""Operators 1, 3, 5, 6, 7, 8 and 9 against plain versions, and their edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from linewise.llm import op1_decontaminate as o1
from linewise.llm import op3_token_counts as o3
from linewise.llm import op5_toxicity as o5
from linewise.llm import op6_quality as o6
from linewise.llm import op7_bpe as o7
from linewise.llm import op8_language as o8
from linewise.llm import op9_pii as o9

TEXTS = [None, "", " ", "a", "Hello, World! it's 12.5% of x_y", "né É日本 😀 ²Ⅷ", "word " * 3000, "x" * 5000,
         "dup text here", "dup text here", "<|endoftext|> a\x1cb\x85c d", "\n\n\t"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, and columns that clash with added ones."""
    rows = [(i, t, "old", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "a", "old", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, Score string, ids double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_bpe_equals_the_library(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = o7.encode(docs).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in o7.digests(docs).collect()}
    for r in got:
        e = tk.encode(r["text"] or "", add_special_tokens=False)
        want = tk.decode(e.ids, skip_special_tokens=False)
        assert list(r["ids"]) == e.ids and r["n_tokens"] == len(e.ids) and r["decoded"] == want
        assert by[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert by[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_bpe_stream_needs_no_more_than_its_lookahead():
    v = o7.vocabulary(o7.vocabulary_file())
    g = random.Random(4)
    for _ in range(25):
        s = "".join(g.choice(["in", "th", "an", "er", "ing", "aaa", "ooo", "ss", "l"]) for _ in range(500))
        assert list(v.stream(s, block=1)) == v.merge([*s[:-1], s[-1] + o7.END])


def test_bpe_text_round_trip():
    v = o7.vocabulary(o7.vocabulary_file())
    text = "naïve 日本 words , 12 😀"
    ids = v.ids_text(next(v.encode([text]))).split()
    d = v.text_decoder()
    assert "".join(d.feed(int(i)) for i in ids) + d.close() == "naïve 日本 words , 1 2 😀 "


def naive_count(counter, word):
    best = {0: (0.0, 0)}
    for d in range(1, len(word) + 1):
        best[d] = min((best[i][0] + min(counter.cost.get(word[i:d], np.inf), o3.BYTE_COST if d - i == 1 else np.inf), best[i][1] + 1)
                      for i in range(d))
    return best[len(word)][1]


def test_token_counts_equal_naive_forward_pass(spark, docs):
    c = o3.Counter(o3.pieces())
    for r in o3.count(docs).collect():
        ws = (r["text"] or "").encode().split()
        assert r["n_pretokens"] == len(ws)
        if len(r["text"] or "") < 2000:
            assert r["n_tokens"] == sum(naive_count(c, o3.MARK + w) for w in ws)
    g = random.Random(2)
    words = sorted({o3.MARK + "".join(g.choice("abéß日 \x01thein") for _ in range(g.randint(1, 15))).encode() for _ in range(400)})
    assert c.trie(words).tolist() == [naive_count(c, w) for w in words]


def test_decontamination_finds_planted_items(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. Nu xi omicron pi rho sigma tau."
    other = "one two three four five six seven eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen."
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "!?")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(900))
    near = item.replace("epsilon", "changed")
    extra = spark.createDataFrame([(100, f"{filler} {item} {filler}", "", 0.0), (101, f"{filler} {near.upper()}", "", 0.0),
                                   (102, f"{filler} alpha beta gamma delta {filler} nu xi omicron", "", 0.0),
                                   (103, f"{other} {filler} {item}", "", 0.0)], docs.schema)
    both = docs.unionByName(extra)
    found = set()
    for ix in o1.indexes(items):
        found |= {(r["doc_id"], r["x"]["item_id"]) for r in both.select("doc_id", F.explode(o1.leaks(both, ix, F.col("text"))).alias("x")).collect()}
    assert found == {(100, 1), (101, 1), (103, 1), (103, 2)}
    kept = o1.clean(both, items)
    assert kept.columns == both.columns and kept.count() == both.count() - 3
    assert o1.clean(both, items.limit(0)).count() == both.count()
    assert len(o1.indexes(items, max_items=2)) == 2


def test_wand_retrieves_all_above_threshold():
    g = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    ix = o1.Index([(i, " ".join(g.choice(words) for _ in range(g.randint(5, 30)))) for i in range(90)])
    for _ in range(60):
        terms = np.unique([ix.term[w] for w in g.sample(words, 30) if w in ix.term])
        want = {}
        for t in terms.tolist():
            for p in ix.postings[t].values():
                for d, v in p:
                    want[d] = want.get(d, 0) + v
        want = {d for d, v in want.items() if v >= 0.5}
        assert set(ix.retrieve(terms, 0.5)) == want


def test_quality_scores_held_out_rows(spark, docs, none):
    q = {r["doc_id"]: r for r in o6.query(spark, SF_SMALL).collect()}
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
    assert len(q) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in q.items())
    hits = [q[r["doc_id"]]["predicted"] == r["quality"] for r in lab if r["doc_id"] in q]
    assert np.mean(hits) > 0.9
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = o6.score(docs, o6.fit(docs, labels)).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert o6.score(none, o6.fit(none, labels)).count() == 0


def test_flattened_trees_equal_a_walk():
    g = np.random.default_rng(3)
    x = g.normal(size=(500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    from linewise.llm import boosting
    t = boosting.fit(x, y, trees=20, depth=3)
    for row, m in zip(x[:50], t.margin(x[:50])):
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while node < t.feature.shape[1]:
                node = 2 * node + 1 + (row[t.feature[k, node]] > t.threshold[k, node])
            total += t.value[k, node - t.feature.shape[1]]
        assert abs(total - m) < 1e-9
    assert ((t.probability(x) > 0.5) == y).mean() > 0.95


def test_toxicity(spark, docs, none):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "toxic")
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    # a made-up vocabulary with a planted term: 60 toxic, 200 clean documents
    g = random.Random(1)
    vocab = ["".join(g.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(1000 + i, " ".join(g.choice(vocab) for _ in range(80)) + (" vileword vileword" if i < 60 else ""), int(i < 60)) for i in range(260)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = o5.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    got = o5.score(made, m).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.99
    assert all(r["predicted"] == 0 for r in o5.score(docs, m).collect())
    empty = o5.fit(none, labels.limit(0))
    assert [r["p_toxic"] for r in o5.score(docs, empty).collect()] == [0.5] * (len(TEXTS) + 2)
    assert o5.score(text, m).count() == text.count()


def test_toxicity_learns_rare_labels_and_languages(spark):
    """1 % toxic rows, some of a rare language, beside ten times more rows than the bound."""
    g = random.Random(6)
    vocab = {"x": ["".join(g.choice("abcdefgh") for _ in range(6)) for _ in range(300)], "y": ["".join(g.choice("mnopqrst") for _ in range(6)) for _ in range(300)]}
    rows = []
    for i in range(4000):
        lang = "y" if i % 20 == 0 else "x"
        vile = {"x": " vileword", "y": " zuwiderlich"}[lang] if i < 20 or (lang == "y" and i < 200) else ""
        rows.append((i, " ".join(g.choice(vocab[lang]) for _ in range(30)) + vile, int(vile != ""), lang))
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    m = o5.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic"), max_rows=400)
    got = o5.score(made, m).collect()
    assert sum(r["toxic"] for r in got) == 29 and all(r["predicted"] == r["toxic"] for r in got)


def test_toxicity_terms_need_significance_at_every_size():
    found, held = ["abcdef", "bcdefg", "cdefgh"], np.array([[1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 1, 1]], bool)
    assert o5.chosen_parts(found, np.array([9.0, 7.0, 5.0]), held, 3) == ["abcdef", "cdefgh"]  # the second stands in texts of the first only


def test_chain_feeds_earlier_categories():
    g = np.random.default_rng(0)
    x = g.normal(size=(400, 3))
    a = (x[:, 0] > 0) * 1.0
    chain = o5.fit_chain(x, {"a": a, "b": a})
    assert [len(w) for w in chain.weights] == [4, 5]
    assert chain.weights[1][3] > 0 and chain.probabilities(x).shape == (400, 2)


def test_language(spark, docs, none):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = o8.query(spark, SF_SMALL).join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == rows.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    m = o8.Model(["xx", "yy"], [("hello", "xx", 9), ("hola", "yy", 9), ("#hel", "xx", 5), ("#ola>", "yy", 5), ("#abcd", "xx", 5), ("#a", "yy", 3)])
    assert m.predict("HELLO there")[0] == "xx" and m.predict("zola")[0] == "yy"
    by = [r for r in o8.predict(docs, m).collect()]
    assert [r["lang_pred"] for r in by if r["text"] in (None, "", " ", "\n\n\t")] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in by)
    empty = o8.fit(none)
    assert {r["lang_pred"] for r in o8.predict(docs, empty).collect()} == {"und"}
    assert o8.predict(none, empty).count() == 0


def test_language_keeps_the_words_of_a_rare_language(spark):
    """Three common languages of many words beside a rare one, same letters; bounds below the common words."""
    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(7))
    vocab = {x: [word() for _ in range(400)] for x in "pqrs"}
    text = lambda x: " ".join(g.choices(vocab[x], k=40))
    rows = [(i, text(x), x) for i, x in enumerate("pqr" * 150 + "s" * 20)]
    m = o8.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=300, max_grams=300)
    rare = Counter(w for _, t, x in rows if x == "s" for w in t.split())
    twice = [w for w, n in rare.items() if n >= 2]
    assert 200 < len(twice) < 300 and all(w in m.known for w in twice)
    new = spark.createDataFrame([(i, text(x), x) for i, x in enumerate("pqrs" * 25)], "doc_id long, text string, want string")
    got = o8.predict(new, m).collect()
    assert all(r["lang_pred"] == r["want"] for r in got)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(t):
    ok = {"email": lambda s, d: True, "ip": lambda s, d: all(int(x) <= 255 for x in s.split(".")),
          "card": lambda s, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda s, d: 8 <= len(d) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if ok[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii_base_spans_equal_plain_patterns(spark, docs):
    g = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@", ".", "-", "_", " ", "1.2.3.4", "256.1.1.1", "00.1.2.003", "4111 1111 1111 1111", "4111111111111112",
            "+1 (301) 555-0346", "+12", "é😀", "q%w@e-r.t_u@v.w", "12", "٣", "\n", "(", ")", "+49 30 1234567 ", "1 2", "a@b.c.d.", "%"]
    texts = ["".join(g.choice(bits) for _ in range(g.randint(1, 14))) for _ in range(400)] + ["9" * 30000, "a" * 60000 + "@b.c", "+" + "1 " * 9000]
    made = docs.unionByName(spark.createDataFrame([(100 + i, t, "", 0.0) for i, t in enumerate(texts)], docs.schema))
    m = o9.fit(made)
    out = o9.find(made, m).collect()
    assert len(out) == made.count()
    for r in out:
        base = [tuple(s) for s in r["base"]]
        assert base == plain_spans(r["text"] or "")
        assert set(base) <= {tuple(s) for s in r["spans"]}
    assert o9.find(made.limit(0), o9.fit(made.limit(0))).count() == 0


def test_pii_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now"), (2, "none"), (3, None), (4, "é a@b.cd +1 301 555 0346!")], "i int, text string")
    m = o9.fit(df)
    got = {r["i"]: r["t"] for r in o9.find(df, m).select("i", o9.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "mail [EMAIL] now", 2: "none", 3: None, 4: "é [EMAIL] [PHONE]!"}


def test_pii_runs_no_python(spark):
    plan = o9.query(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_queries_cover_every_operator():
    from linewise.llm.queries import QUERIES
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py"))
