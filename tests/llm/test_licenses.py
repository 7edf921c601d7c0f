"""Operator 11 against plain loops."""

import random
import re

from conftest import SF_SMALL
from linewise.llm import op11_licenses as o11


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, templates=o11.TEMPLATES, threshold=o11.THRESHOLD):
    w = words(text)
    base = [(i, label) for p, label in o11.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    step, more, share = o11.step_of(templates), set(), 0.0
    for k in range(max(0, (len(w) - 1) // step - 1) + 1):
        b = set(w[k * step:(k + 2) * step])
        for label, t in templates:
            t = set(t.split())
            if 100 * len(b & t) >= threshold * len(t):
                more.add(label)
                share = max(share, len(b & t) / len(t))
    starts = [i for i, _ in base]
    own = sorted({x for _, x in base})
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *more})), 1.0 if base else share)


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id", "n_words").collect()]


def test_documents_equal_a_plain_scan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = [plain(r.text) for r in docs.orderBy("doc_id").collect()]
    assert rows(o11.scan(docs)) == want
    assert any(w[5] and not w[4] for w in want) or any(w[5] != w[4] for w in want)


def test_join_finds_every_block_over_the_threshold(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)]
    texts = [" ".join(rng.choices(vocabulary + ["x", "y"], weights=[1 / (i + 1) for i in range(32)], k=rng.randint(0, 400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (50, 80, 100):
        assert rows(o11.scan(docs, templates, threshold)) == [plain(t, templates, threshold) for t in texts]


def test_batches_of_templates_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    whole = rows(o11.scan(docs))
    monkeypatch.setattr(o11, "BATCH_WORDS", 20)
    assert len(o11.batches(o11.TEMPLATES)) > 3
    assert rows(o11.scan(docs)) == whole


def test_odd_rows(spark):
    notice = o11.TEMPLATES[8][1]
    texts = [None, "", " \n", "MIT", "MIT License", "mit\nLICENSE mit license", "x " * 30_000 + "Apache  License" + " y" * 30_000,
             "Ünder the General-Public/License 漢字", notice.replace(" ", "\n"), "a " * 37 + notice, "General Public Apache License", notice[:40]]
    data = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "mit license", None, None), (4, "MIT License", "k", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, key string, n_words int")
    want = [plain(t) for _, t in sorted([(-1, "mit license"), (4, "MIT License"), *enumerate(texts)], key=lambda x: x[0])]
    assert rows(o11.scan(docs)) == want
    assert o11.scan(docs.limit(0)).collect() == []
    assert o11.scan(docs, []).filter("labels != base_labels").collect() == []


def test_no_python_on_the_path(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = o11.scan(docs)._jdf.queryExecution().executedPlan().toString() + o11.matches(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
