"""A scan in SQL alone equals the API."""

from conftest import files_df
from linewise import sql
from linewise.operators.lines import explode_lines
from linewise.plans.analyze import Analysis

ROWS = [("a.c", "int a;\r\nmd5(x);\n\n"), ("b.py", "eval(y)\nlast"), ("c.c", ""), ("d.c", "\n"), ("e.c", "#ifdef _WIN32\nDWORD x;\n#endif\nDWORD y;")]


def test_sql_scan_equals_the_api(spark):
    df = files_df(spark, ROWS)
    names = sql.register(spark, df, prefix="t_")
    assert {"t_files", "t_issues", "t_report"} <= set(names)
    laid = spark.sql("SELECT f.project, f.path, f.language, l.n, l.text FROM t_files f, LATERAL source_lines(f.content) l")
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, explode_lines(df).collect()))
    assert sorted(map(tuple, spark.table("t_lines").collect())) == sorted(map(tuple, explode_lines(df).collect()))
    a = Analysis(df)
    assert sorted(r.key for r in spark.sql("SELECT key FROM t_issues").collect()) == sorted(r.key for r in a.issues.select("key").collect())
    assert spark.sql("SELECT grade, round(tqi, 6) FROM t_report").collect() == [tuple(r) for r in a.report.selectExpr("grade", "round(tqi, 6)").collect()]
    assert spark.sql("SELECT grade_of(tqi) = grade FROM t_report").first()[0]


def test_functions_and_odd_contents(spark):
    sql.register(spark, files_df(spark, ROWS), prefix="t_")
    assert tuple(spark.sql("SELECT severity_from('major'), severity_from('x'), factor_from('security'), factor_from(null), clamp_score(120), clamp_score(-1)").first()) \
        == ("major", "info", "security", "robustness", 100.0, 0.0)
    assert spark.sql("SELECT * FROM VALUES (cast(null AS STRING)) t(c), LATERAL source_lines(c)").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT n, text FROM source_lines('é\n\nx')").collect()] == [(1, "é"), (2, ""), (3, "x")]
