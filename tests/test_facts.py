"""Guards folded in the file row, previews, and the shared facts table."""

import random
import re

from pyspark.sql import functions as F

from conftest import files_df
from linewise.operators import guards as G
from linewise.operators.issues import file_previews
from linewise.operators.lines import explode_lines
from linewise.operators.rules import file_issues as line_issues
from linewise.operators.rules import file_regions, guard_regions
from linewise.plans import store
from linewise.plans.analyze import Analysis
from linewise.plans.facts import file_issues
from test_rules import guard_loop

PIECES = ["#ifdef _WIN32", "#ifndef _WIN32", "# if defined(__linux__)", "#if !defined(_WIN32)", "#if X", "\t#else", "#elif _WIN32", "#endif", "#endif // x", "#define A",
          "#pragma once", "DWORD x;", "pid_t p = fork();", 'system("ls");', "#include <unistd.h>", 'p = "/etc/x/y";', "int a;", ""]


def sources(n, size, seed):
    rng = random.Random(seed)
    return [(f"f{i}.c", "\n".join(rng.choices(PIECES, k=rng.randrange(0, size))) + rng.choice(["", "\n"])) for i in range(n)]


def test_regions_equal_a_loop_over_lines(spark, monkeypatch):
    monkeypatch.setattr(G, "SLICE", 5)  # many slices per file
    rows = sources(25, 80, 1) + [("empty.c", ""), ("plain.c", "int a;\n")]
    df = files_df(spark, rows)
    found = sorted(map(tuple, file_regions(df).collect()))
    assert found == sorted(map(tuple, guard_regions(explode_lines(df)).collect()))
    for path, text in rows:
        mine = [r for r in found if r[1] == path]
        for i, want in enumerate(guard_loop(text.split("\n")), start=1):
            hit = [r[4:] for r in mine if r[2] <= i <= r[3]]
            assert (hit[0] if hit else (False, False, False)) == want, (path, i)


def test_issues_in_the_file_row_equal_the_join(spark, monkeypatch):
    monkeypatch.setattr(G, "SLICE", 7)
    df = files_df(spark, sources(30, 90, 2))
    rows = file_issues(df).select("path", F.inline("issues"))
    kept = rows.filter("not silenced").select("path", "line", "rule_id")
    want = line_issues(explode_lines(df)).select("path", "line", "rule_id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    assert rows.filter("silenced").count() > 20
    in_order = file_issues(df).filter("array_sort(transform(issues, i -> struct(i.line, i.rule_ord))) != transform(issues, i -> struct(i.line, i.rule_ord))")
    assert in_order.count() == 0


def test_plans_hold_no_python_and_move_no_text(spark):
    kinds = "project string, path string, ext string, language string, content string, size long, mtime timestamp"
    df = spark.createDataFrame([("p", p, ".c", "C", t, len(t), None) for p, t in sources(3, 20, 3)], kinds)
    a = Analysis(df)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for d in (a.issues, a.previews, file_regions(df)):
        assert not re.search("EvalPython|InPandas|ArrowEval|Exchange|Join", plan(d))
    assert not re.search("EvalPython|InPandas|ArrowEval|NestedLoop", plan(a.report))


def test_previews_clip_and_show_the_head_without_a_line(spark):
    text = "\n".join(f"l{i}" for i in range(1, 13))
    issues = "array(" + ", ".join(f"struct({n} as line, 'R{k}' as rule_id, {s} as silenced)" for k, (n, s) in enumerate([(0, "false"), (1, "false"), (7, "false"), (12, "false"), (7, "true")])) + ")"
    d = spark.range(1).selectExpr("'p' as project", "'a' as path", f"split('{text}', '\\n') as lines", f"{issues} as issues")
    got = {r.key: (r.from_line, r.to_line, r.n_lines, r.preview) for r in file_previews(d).collect()}
    show = lambda a, b: (a, b, b - a + 1, "\n".join(f"{n}: l{n}" for n in range(a, b + 1)))
    assert got == {"p:R0:a:0": show(1, 9), "p:R1:a:1": show(1, 5), "p:R2:a:7": show(3, 11), "p:R3:a:12": show(8, 12)}


def test_shared_facts_are_written_once_and_merged(spark, tmp_path, monkeypatch):
    evaluated = []
    real = store.file_facts
    monkeypatch.setattr(store, "file_facts", lambda files, cfg: evaluated.append(sorted(r.path for r in files.select("path").collect())) or real(files, cfg))
    at, name = str(tmp_path / "files"), f"corpus {tmp_path}"
    rows = sources(6, 30, 4)

    def scan(rows):
        files_df(spark, rows).coalesce(1).write.mode("overwrite").parquet(at)
        return store.shared_facts(spark.read.parquet(at), name)

    def plain(d):
        return sorted(map(str, d.drop("content_hash").collect()))
    first = scan(rows)
    assert evaluated == [sorted(p for p, _ in rows)]
    again = store.shared_facts(spark.read.parquet(at), name)
    assert len(evaluated) == 1 and again.inputFiles() == first.inputFiles()  # same input: only read
    scan(rows)
    assert evaluated[1:] == [[]]  # rewritten, unchanged: no file is evaluated
    edited = [(rows[0][0], "int b;\n"), *rows[2:], ("new.c", "goto x;\n")]
    third = scan(edited)
    assert evaluated[2:] == [["f0.c", "new.c"]]
    assert plain(third) == plain(real(files_df(spark, edited)))
    assert plain(first) == plain(real(files_df(spark, rows)))  # readers of the old version still have it


def test_queries_share_one_facts_job(spark, monkeypatch):
    from linewise.plans import store as S
    from linewise.plans.catalog import registered
    qs = registered()
    qs["severity_counts"](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(S, "file_facts", lambda *a: (_ for _ in ()).throw(AssertionError("facts evaluated again")))
    for name in ("health_scores", "quality_gate", "file_issue_count", "issue_page", "platform_top8"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0


def test_results_do_not_disturb_each_other(spark):
    from linewise.plans.catalog import registered
    qs, sf = registered(), "/root/testdata/sf0.001"
    status, history = qs["read_issue_status"](spark, sf), qs["read_history"](spark, sf)
    a, b = status.count(), history.count()
    qs["latest_status"](spark, sf).count()
    qs["append_history"](spark, sf).count()
    assert (status.count(), history.count()) == (a, b)
