"""Histories with ties and hot projects, listings with unknown times, language thresholds, the gate."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linewise.config import GateConfig, ScoreConfig
from linewise.operators import health as HE
from linewise.operators import history as HI

T0 = datetime(2024, 1, 1)
KINDS = "project string, ts timestamp, file_count long, issue_count long, tqi double, grade string, duplicate_blocks long"


def snapshots(spark, rows):
    return spark.createDataFrame([(p, T0 + timedelta(hours=h), 1, n, float(100 - n), "A", 0) for p, h, n in rows], KINDS)


def test_ties_are_kept_alike_on_any_partitioning(spark):
    h = snapshots(spark, [("p", 0, n) for n in range(6)] + [("p", 1, 9)])
    kept = {tuple(sorted(r.issue_count for r in HI.history_ring(h.repartition(k), 3).collect())) for k in (1, 2, 5)}
    assert kept == {(4, 5, 9)}
    series = [[(r.seq, r.issue_count, r.issue_delta) for r in HI.trend(h.repartition(k)).orderBy("seq").collect()] for k in (1, 3)]
    assert series[0] == series[1] == [(1, 0, None)] + [(i + 1, i, 1) for i in range(1, 6)] + [(7, 9, 4)]


def test_trend_of_one_hot_project_equals_the_window(spark):
    from pyspark.sql import Window
    rows = [("hot", i, (i * 37) % 101) for i in range(500)] + [(None, i, i) for i in range(3)] + [("one", 0, 1)]
    h = snapshots(spark, rows)
    w = Window.partitionBy("project").orderBy("ts")
    want = (h.withColumn("seq", F.row_number().over(w)).withColumn("d", F.col("tqi") - F.lag("tqi").over(w))
             .filter("project is null or project != 'one'").select("project", "seq", "tqi", "d"))
    got = HI.trend(h).select("project", "seq", "tqi", "tqi_delta")
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert HI.trend(h.limit(0)).collect() == []


def test_listings_with_unknown_times(spark):
    kinds = "project string, path string, mtime timestamp"
    prev = spark.createDataFrame([("p", "a", T0), ("p", "b", None), ("p", "c", T0), ("p", "d", None), ("p", "a", T0)], kinds)
    cur = spark.createDataFrame([("p", "a", T0), ("p", "b", T0), ("p", "c", None), ("p", "d", None), ("p", "e", T0)], kinds)
    change = {r.path: r.change for r in HI.change_set(prev.distinct(), cur).collect()}
    assert change == {"b": "modified", "c": "modified", "e": "added"}
    plan = HI.incremental_plan(prev, cur)
    assert {r.path: r.action for r in plan.collect()} == {"a": "reuse", "b": "recompute", "c": "recompute", "d": "recompute", "e": "recompute"}
    assert plan.count() == 5 and plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_language_excess_weighs_functions(spark):
    m = spark.createDataFrame([("p", "C", 10, 50), ("p", "C", 10, 50), ("p", "Go", 20, 20), ("p", None, 5, 100), ("q", "Go", 0, 7)],
                              "project string, language string, functions long, cyclomatic long")
    limits = spark.createDataFrame([("C", 3.0), ("Go", 2.0), ("Ada", 1.0)], "language string, complexity_threshold double")
    got = {r.project: round(r.complexity_over, 6) for r in HE.language_excess(m, limits, ScoreConfig(complexity_threshold=10.0)).collect()}
    # C: 5 - 3 over 20 functions; Go is below its 2 and makes up for nothing; no language: 20 - 10 over 5
    assert got == {"p": round((20 * 2 + 5 * 10) / 45, 6), "q": 0.0}


def test_thresholds_count_only_when_switched_on(spark):
    from conftest import files_df
    from linewise.plans.analyze import Analysis
    df = files_df(spark, [("a.c", "int f(int a) {\n" + "if (a) { a++; }\n" * 40 + "}\n")])
    limits = {"C": 0.0}
    score = lambda **kw: Analysis(df, score_cfg=ScoreConfig(language_thresholds=limits, **kw)).report.first().robustness
    assert score() == Analysis(df).report.first().robustness
    assert score(use_language_thresholds=True) < score()
    strict = Analysis(df, thresholds=spark.createDataFrame([("C", 40.5)], "language string, complexity_threshold double")).report.first()
    assert strict.robustness > score(use_language_thresholds=True)


def test_gate_on_new_criticals(spark):
    report = spark.createDataFrame([("a", 99.0, 3, 3), ("b", 99.0, 0, 0)], "project string, tqi double, issue_count long, n_critical long")
    fresh = spark.createDataFrame([("a", "k1"), ("a", "k2")], "project string, key string")

    def run(n):
        gate = GateConfig(max_critical=-1, max_new_critical=n)
        return {r.project: (r.passed, r.reason) for r in HE.quality_gate(report, gate, fresh).collect()}
    assert run(1) == {"a": (False, "New critical issues: 2"), "b": (True, "")}
    assert run(2)["a"] == (True, "") and run(-1)["a"] == (True, "")
