"""What is done once a file and what a line is spared, against the plain forms."""

import random
import re

from pyspark.sql import functions as F

from conftest import files_df
from linewise.config import ScanConfig
from linewise.functions.text import WORD, count_regex, has_copyright, header_of, java_regex, keyword_regex, normalize_line, spdx_of_line
from linewise.operators import rules as R
from linewise.operators.lines import file_line_class, lines_array
from linewise.operators.metrics import file_metrics
from linewise.plans.facts import file_facts

PIECES = ["password", "token", " = ", '"', "'", "abcd1234", "eval", "exec", "(", ")", "md5", "des", "select x", "select", " * from t", "+", "system", "os.system", "catch", "{", "}",
          "todo", "/etc/x/y", '"/etc/x/y"', "'/var/a/b'", "'/a/b/c.js'", '"c:\\\\x"', "c:\\\\x", "rand(", "math.random", "-----BEGIN RSA ", "AKIA" + "A" * 16, "Bearer " + "a" * 21 + ".b",
          "#include <windows.h>", "#include <unistd.h>", "DWORD", "WORD", "Sleep(1", "fork()", '"C:\\"', "MAX_PATH", "x.innerHTML = a + b", "../", "..\\", "printf(fmt", "f(x)->y", "->",
          "for (i=0; i<v.size(); ", "i.size() <", ";", "// if", "analyzer-suppress SEC-EVAL", " ", "é", "x",
          "password = 'abcd1234'", 'eval(x)', 'select a "b" +', "system(x)", "catch (e) { }", "todo", "select * from", '"C:\\"', "Sleep(1)", "i++; i.size() <", "for (i = 0; n.len() <"]


def _lines(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(1, 8))) for _ in range(n)]


def test_every_match_meets_its_conditions():
    gates = {i: p for p, ids in R.GATES for i in ids}
    lines = _lines(6000, 3)
    for r in R.CATALOGUE:
        rx, met = re.compile(java_regex(r.pattern)), 0
        for t in filter(rx.search, lines):
            met += 1
            assert all(any(lit in t for lit in more) for more in R.ALSO.get(r.id, [])), (r.id, t)
            assert r.id not in gates or re.search(gates[r.id], t), (r.id, t)
        assert met or r.id not in {**gates, **R.ALSO}, r.id


def test_gated_hits_are_all_hits(spark):
    cfg, rs = ScanConfig(), R.select_rules()
    d = spark.createDataFrame([(t,) for t in _lines(1500, 4)], "t string")
    x = F.col("t")
    plain = F.array_compact(F.array(*[F.when(x.rlike(java_regex(r.pattern)) & ~(F.contains(x, F.lit(cfg.suppress_marker)) & F.contains(x, F.lit(r.id))), F.lit(r.id)) for r in rs]))
    got = F.transform(R.line_hits(rs, x, cfg), lambda h: h["rule_id"])
    assert d.filter(F.array_sort(got) != F.array_sort(plain)).count() == 0
    assert d.filter(got.isNull()).count() == 0 and d.filter(F.size(got) > 0).count() > 500


def test_comment_style_is_found_once_a_file(spark):
    """The list of languages of each style stands in the plan once, outside the folds over lines."""
    files = files_df(spark, [("a.py", "# x\ny = 1\n")])
    for df in (file_metrics(files, with_deps=False), file_line_class(files), file_facts(files)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("apostrophe") <= 4 and plan.count("PowerShell") <= 4, plan.count("PowerShell")


def test_lines_normal_forms_and_headers(spark):
    texts = [None, "", "\n", "\r", "a\r", "a\n\r", "a\r\nb\r\n", "\n\n", "a\n\n", "x \t y", " a  b ", "\t", "  ", " ", "a b", "COPY\rRIGHT x", "SPDX-License-Identifier: MIT */",
             "é spdx-license-identifier:\tX\nCopyright", "@license", "no ſpdx", "copyr\u0131ght", "\u00a0a\u00a0"]
    d = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    parts = F.split(c, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    plain = F.transform(kept, lambda x: F.replace(x, F.lit("\r"), F.lit("")))
    norm = F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r"^ | \z", "")
    spdx, cr = header_of(c, lines_array(c))
    plain_spdx = F.get(F.filter(F.transform(plain, spdx_of_line), lambda s: s != ""), 0)
    pairs = [(lines_array(c), plain), (normalize_line(c), norm), (spdx, plain_spdx), (cr, F.exists(plain, has_copyright))]
    for got, want in pairs:
        assert d.filter(~got.eqNullSafe(want)).collect() == []


def test_keyword_counts(spark):
    words = [["if", "for", "while"], ["->"], ["On Error", "Else"], ["and", "or"]]
    rng = random.Random(5)
    d = spark.createDataFrame([("".join(rng.choices(["if", "for", "->", " ", "_", "é", "On Error", "Else", "and", "or", "9", "(", "-"], k=12)),) for _ in range(400)], "c string")
    for ks in words:
        alts = "|".join(re.escape(k) for k in ks)
        plain = count_regex(F.col("c"), f"(?<![{WORD}])(?:{alts})(?![{WORD}])")
        assert d.filter(count_regex(F.col("c"), keyword_regex(ks)) != plain).count() == 0
