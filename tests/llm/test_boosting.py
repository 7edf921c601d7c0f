"""Boosted trees over frames of any size: all rows count, whatever their partitions."""

import numpy as np
from pyspark.sql import functions as F

from linewise.llm import boosting
from linewise.llm import op6_quality as o6
from linewise.llm import op9_pii as o9


def rows_frame(spark, n):
    d = spark.range(n).select(F.array((F.xxhash64("id") % 100).cast("double"), (F.col("id") % 7).cast("double"), F.lit(3.0)).alias("x"), F.lit(1.0).alias("w"),
                              (F.col("id") % 3).cast("int").alias("fold"))
    return d.withColumn("y", ((F.get("x", F.lit(0)) > 20) != (F.get("x", F.lit(1)) > 4)).cast("double"))


def test_frame_fit_learns_and_ignores_partitions(spark):
    d = rows_frame(spark, 3000)
    a, (n, right) = boosting.fit_frame(d.repartition(5, "x"), trees=7, depth=3, folds=3)
    b, _ = boosting.fit_frame(d.repartition(1), trees=7, depth=3, folds=3)
    assert len(a) == 4
    for s, t in zip(a, b):
        for name in ("feature", "threshold", "value", "base"):
            assert np.array_equal(getattr(s, name), getattr(t, name))
    got = d.toPandas()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    p = a[0].probability(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    one = boosting.fit(x, y, trees=7, depth=3)
    assert np.abs(one.probability(x) - p).mean() < 0.05
    # the steps hold the out-of-fold probabilities of all rows
    own = np.choose(got["fold"].to_numpy() + 1, [m.probability(x) for m in a])
    at = np.minimum((own * 4096).astype(int), 4095)
    assert n.sum() == 3000 and right.sum() == y.sum()
    assert np.abs(np.bincount(at, minlength=4096) - n).sum() <= 10


def test_frame_fit_weights_stand_for_repeated_rows(spark):
    d = rows_frame(spark, 600)
    many = d.unionByName(d)
    a = boosting.fit_frame(many, trees=3, depth=2)[0][0]
    b = boosting.fit_frame(d.withColumn("w", F.lit(2.0)), trees=3, depth=2)[0][0]
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, b.value)


def test_key_edges():
    x = np.array([0.0, -0.0, 1.0, -1.0, 3.75, -3.75, 1e-300, 255.0, 256.0, 1e9])
    for key in {int(k) for k in boosting._key(x)}:
        assert np.array_equal(x > boosting._edge(key), boosting._key(x) > key)


def test_quality_learns_from_every_label(spark):
    """A hint that few of many labelled rows hold counts, however many rows there are."""
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "| $ | $ | $ |").otherwise(F.concat(F.lit("plain words of row "), F.col("id"))).alias("text"))
    lab = d.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    seen = []
    real, boosting.fit_frame = boosting.fit_frame, lambda rows, **k: (seen.append(rows.count()), real(rows, **k))[1]
    try:
        trees = o6.fit(d, lab, max_rows=50, trees=5, depth=2)
    finally:
        boosting.fit_frame = real
    assert seen == [400]
    got = {r.text: r.score for r in o6.score(d.select("text"), trees).collect()}
    assert got["| $ | $ | $ |"] < got["plain words of row 1"]


def test_pii_learns_from_every_candidate(spark):
    d = spark.range(300).select(F.concat(F.lit("mail a"), F.col("id"), F.lit("@example.org or call 555 "), 1000 + F.col("id"), F.lit(" 77, token: 0123456789abcdef0123456789")).alias("text"))
    seen = []
    real, boosting.fit_frame = boosting.fit_frame, lambda rows, **k: (seen.append(rows.agg(F.sum("w")).first()[0]), real(rows, **k))[1]
    try:
        m = o9.fit(d, max_candidates=100)
    finally:
        boosting.fit_frame = real
    whole = o9.with_base(d, "text").agg(F.sum(F.size("__new"))).first()[0]
    assert seen == [whole] and whole > 100
    small = o9.fit(d, max_candidates=10 ** 6)
    spans = lambda model: sorted(map(str, o9.find(d, model).select("text", "spans").collect()))
    assert spans(m) == spans(small)
