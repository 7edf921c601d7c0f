"""Complexity, functions, nesting, dependencies, technologies, licences."""

from conftest import files_df
from linewise.operators.deps import technology_fold
from linewise.operators.licenses import file_licenses
from linewise.operators.metrics import file_metrics
from pyspark.sql import functions as F


def metrics_of(spark, rows):
    return {r["path"]: r for r in file_metrics(files_df(spark, rows)).collect()}


def test_cyclomatic_and_functions(spark):
    m = metrics_of(spark, [
        ("a.c", "int f(int a) {\n if (a && b || c) { return 1; }\n for(;;) {}\n}\n"),
        ("b.py", "def f():\n    if x and y:\n        pass\nclass A:\n  def g(self): pass\n"),
        ("c.erl", "f(X) -> case X of 1 -> a; _ -> b end.\ng() -> x->y.\n"),
        ("d.hs", "main = let x = 1 in x\n  where y = 2\n"),
        ("e.kt", "fun main() { when (x) { else -> 1 } }\n"),
        ("f.d", "x = 1;\n"),
    ])
    assert m["a.c"]["cyclomatic"] == 1 + 2 + 1 + 1   # if, for, &&, ||
    assert m["a.c"]["functions"] == 3                  # f(...) {, if (...) {, for(;;) {
    assert m["b.py"]["functions"] == 2 and m["b.py"]["cyclomatic"] == 2
    assert m["c.erl"]["cyclomatic"] == 1 + 2           # case counted twice
    assert m["c.erl"]["functions"] == 4                # four bounded '->'; 'x->y' excluded
    assert m["d.hs"]["functions"] == 3                 # where + let + 1
    assert m["e.kt"]["cyclomatic"] == 1 + 2 and m["e.kt"]["functions"] == 1
    assert m["f.d"]["functions"] == 1                  # 0 -> 1 with a code line


def test_nesting(spark):
    m = metrics_of(spark, [
        ("a.js", "}}}{ { } { { } } }"),          # floored at zero: depth 3
        ("b.py", "def f():\n\tif x:\n\t\t  y\n"),  # 2 tabs + 2 spaces -> (8+2)//4 = 2
        ("c.hs", "{ { { } } }"),                 # no brace nesting for Haskell
    ])
    assert m["a.js"]["max_nesting"] == 3
    assert m["b.py"]["max_nesting"] == 2
    assert m["c.hs"]["max_nesting"] == 0


def test_dependency_forms(spark):
    m = metrics_of(spark, [("a.js", "\n".join([
        "#include <vector>", '#include "local.h"', "import os", "from a.b import c", "import   spaced",
        "const x = require('lodash');", 'const y = require("axios");', "import static foo.Bar;"]) + "\n")])
    assert m["a.js"]["dependencies"] == sorted(["vector", "local.h", "os", "a.b", "lodash", "axios", "static"])


def test_technology_fold(spark):
    df = spark.createDataFrame([(["react", "react-redux", "vue"],), (["grpc", "io.grpc"],)], "d array<string>")
    got = [[t["name"] for t in r["t"]] for r in df.select(technology_fold(F.col("d")).alias("t")).collect()]
    assert got == [["React", "Redux", "Vue"], ["gRPC"]]


def test_licence_headers(spark):
    rows = [("a.c", "// SPDX-License-Identifier: MIT */\nint x;\n"),
            ("b.py", "# spdx-license-identifier:   Apache-2.0  \n"),
            ("c.c", "/* Copyright 2020 X */\n"),
            ("d.c", "\n" * 20 + "// SPDX-License-Identifier: MIT\n"),
            ("e.c", "/* SPDX-License-Identifier: */\n// SPDX-License-Identifier: BSD-3-Clause\n")]
    got = {r["path"]: (r["spdx"], r["has_copyright"], r["has_header"])
           for r in file_licenses(files_df(spark, rows)).collect()}
    assert got["a.c"] == ("MIT", False, True)
    assert got["b.py"] == ("Apache-2.0", False, True)
    assert got["c.c"] == (None, True, True)
    assert got["d.c"] == (None, False, False)          # line 21 is not scanned
    assert got["e.c"] == ("BSD-3-Clause", False, True)
