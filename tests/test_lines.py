"""Line classification: golden snippets per comment style and a brute-force
sequential automaton compared with both Spark forms."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import files_df
from linewise.functions.lang import STYLE_OF
from linewise.operators.lines import explode_lines, file_line_breakdown, line_class


def classify_loop(language, content):
    """Sequential reference: (total, code, comment, blank, long)."""
    style = STYLE_OF.get(language, "slash")
    close = "-}" if language == "Haskell" else "*/"
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines = lines[:-1]
    code = cmt = blank = lng = 0
    in_block = False
    for raw in lines:
        t = raw.replace("\r", "")
        if len(t.encode()) > 120:
            lng += 1
        tr = t.lstrip(" \t")
        if tr == "":
            blank += 1
            continue
        if in_block:
            cmt += 1
            if close in tr:
                in_block = False
            continue
        c = False
        if style == "cobol":
            c = len(t.encode()) >= 7 and t.encode()[6:7] == b"*"
        elif style == "asterisk":
            c = tr.startswith("*")
        elif style == "jcl":
            c = tr.startswith("//*")
        elif style == "hash":
            c = tr.startswith("#")
        elif style == "dash":
            if tr.startswith("--"):
                c = True
            elif language == "Haskell" and tr.startswith("{-"):
                c = True
                in_block = "-}" not in tr
        elif style == "bang":
            c = tr.startswith("!")
        elif style == "apostrophe":
            c = tr.startswith("'")
        elif style == "percent":
            c = tr.startswith("%")
        elif style == "semicolon":
            c = tr.startswith(";")
        elif style in ("block", "slash"):
            if tr.startswith("/*"):
                c = True
                in_block = "*/" not in tr
            elif style == "slash" and (tr.startswith("//") or tr.startswith("* ")):
                c = True
        if c:
            cmt += 1
        else:
            code += 1
    ph = 1 if content and not content.endswith("\n") else 0
    return (len(lines) + ph, code, cmt, blank + ph, lng)


GOLDEN = [
    ("a.py", "# c\nx = 1\n\n  # d\n", (4, 1, 2, 1, 0)),
    ("a.rb", "# c\nputs 1", (3, 1, 1, 1, 0)),      # no final newline: phantom blank line
    ("a.sql", "-- c\nselect 1;\n/* no */\n", (3, 2, 1, 0, 0)),
    ("a.hs", "{- a\nb\n-}\nmain = 1\n-- x\n", (5, 1, 4, 0, 0)),
    ("a.erl", "% c\nf() -> 1.\n", (2, 1, 1, 0, 0)),
    ("a.clj", "; c\n(defn f [] 1)\n", (2, 1, 1, 0, 0)),
    ("a.f90", "! c\nx = 1\n", (2, 1, 1, 0, 0)),
    ("a.cbl", "000100* COMMENT\n000200 MOVE A TO B.\n      *X\n", (3, 1, 2, 0, 0)),
    ("a.asm", "* c\n  LR 1,2\n   * d\n", (3, 1, 2, 0, 0)),
    ("a.bas", "' c\nDim x\n", (2, 1, 1, 0, 0)),
    ("a.jcl", "//* c\n//STEP EXEC PGM=X\n/* not\n", (3, 2, 1, 0, 0)),
    ("a.ml", "(* ocaml *)\n/* c */\n// code\n", (3, 2, 1, 0, 0)),
    ("a.c", "/* a\n * b\n */\nint x;\n// y\n * z\n", (6, 1, 5, 0, 0)),
]


def test_golden_comment_styles(spark):
    df = files_df(spark, [(p, c) for p, c, _ in GOLDEN])
    got = {r["path"]: (r["total_lines"], r["code_lines"], r["comment_lines"], r["blank_lines"], r["long_lines"])
           for r in file_line_breakdown(df).collect()}
    for p, _, want in GOLDEN:
        assert got[p] == want, p


def test_cobol_indicator_counts_bytes(spark):
    # 'Ü' is two bytes: byte 7 is '*' after 'ÜAAAA' (6 bytes)
    df = files_df(spark, [("u.cbl", "ÜAAAA*x\nAAAAAA*y\nÜAAAAA*z\n")])
    r = file_line_breakdown(df).collect()[0]
    assert (r["comment_lines"], r["code_lines"]) == (2, 1)


def test_long_lines_are_bytes(spark):
    a = "é" * 60            # 120 bytes: not long
    b = "é" * 60 + "x"      # 121 bytes: long
    df = files_df(spark, [("l.py", f"{a}\n{b}\n")])
    assert file_line_breakdown(df).collect()[0]["long_lines"] == 1


def test_phantom_line_and_empty_file(spark):
    df = files_df(spark, [("a.go", "x := 1"), ("b.go", ""), ("c.go", "x\n")])
    got = {r["path"]: (r["total_lines"], r["blank_lines"]) for r in file_line_breakdown(df).collect()}
    assert got == {"a.go": (2, 1), "b.go": (0, 0), "c.go": (1, 0)}


def test_explode_numbering(spark):
    df = files_df(spark, [("a.c", "a\r\nb\n\nc\n")])
    got = [(r["n"], r["text"]) for r in explode_lines(df).orderBy("n").collect()]
    assert got == [(1, "a"), (2, "b"), (3, ""), (4, "c")]


PIECES = ["/* open", "*/ close", "x */", "/* one */", "// s", "* star", "# h", "-- d", "{- hs", "-}", "code",
          "", "   ", "\tcode", "% p", "; s", "! b", "' a", "//* j"]
LANG_EXT = {".c": "C", ".py": "Python", ".hs": "Haskell", ".sql": "SQL", ".erl": "Erlang", ".clj": "Clojure",
            ".f90": "Fortran", ".bas": "Visual Basic 6", ".jcl": "JCL", ".ml": "OCaml", ".asm": "HLASM"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(LANG_EXT)),
                          st.lists(st.sampled_from(PIECES), min_size=0, max_size=12),
                          st.booleans()), min_size=1, max_size=6))
def test_fold_and_window_match_sequential_loop(spark, files):
    rows = []
    for i, (ext, pieces, final_nl) in enumerate(files):
        rows.append((f"f{i}{ext}", "\n".join(pieces) + ("\n" if final_nl and pieces else "")))
    df = files_df(spark, rows)
    bd = {r["path"]: (r["total_lines"], r["code_lines"], r["comment_lines"], r["blank_lines"], r["long_lines"])
          for r in file_line_breakdown(df).collect()}
    lc = line_class(explode_lines(df)).groupBy("path").agg(
        F.count_if(F.col("kind") == "code").alias("code"), F.count_if(F.col("kind") == "comment").alias("cmt"))
    win = {r["path"]: (r["code"], r["cmt"]) for r in lc.collect()}
    for path, content in rows:
        lang = LANG_EXT["." + path.split(".")[-1]]
        want = classify_loop(lang, content)
        assert bd[path] == want, (path, content)
        assert win.get(path, (0, 0)) == (want[1], want[2]), (path, content)


def test_random_documents_match_loop(spark):
    from linewise.sources.corpus import documents_as_files
    df = documents_as_files(spark, "/root/testdata/sf0.001")
    rows = df.select("path", "language", "content").collect()
    bd = {r["path"]: (r["total_lines"], r["code_lines"], r["comment_lines"], r["blank_lines"], r["long_lines"])
          for r in file_line_breakdown(df).collect()}
    random.seed(1)
    for r in random.sample(rows, 40):
        assert bd[r["path"]] == classify_loop(r["language"], r["content"]), r["path"]


def test_line_classes_in_the_file_row_equal_the_window(spark, monkeypatch):
    import random

    from linewise.operators import lines as LN
    from linewise.sources.corpus import corpus_files
    monkeypatch.setattr(LN, "SLICE", 7)  # many slices per file
    rng = random.Random(6)
    pieces = ["/* a", "b */", "// c", "# d", "-- e", "code();", "", "  ", '"""', "{- x", "-}", "x /* y */ z", "'''", "!f", "* g", "=begin", "=end", "é" * 130]
    rows = [(f"f{i}{ext}", "\n".join(rng.choices(pieces, k=rng.randrange(0, 60)))) for i in range(6) for ext in (".c", ".py", ".sql", ".hs", ".js", ".f90", ".cbl", ".rb")]
    df = files_df(spark, rows + [("empty.c", "")])
    for files in (df, corpus_files(spark, "/root/testdata/sf0.001")):
        got = LN.file_line_class(files)
        assert "Exchange hash" not in LN.file_line_class(df)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, LN.line_class(LN.explode_lines(files)).collect()))
