"""Rules: one positive and one negative line per look-around rule, inline
suppression, the 2,000-byte guard, guard-region stacks vs a sequential loop."""

import re

from pyspark.sql import functions as F

from conftest import files_df
from linewise.functions.text import java_regex
from linewise.operators.lines import explode_lines
from linewise.operators.rules import CATALOGUE, apply_rules, file_issues, guard_regions
from linewise.config import ScanConfig


def hits(spark, text, path="a.c", cfg=ScanConfig()):
    df = files_df(spark, [(path, text + "\n")])
    return sorted(r["rule_id"] for r in file_issues(explode_lines(df), cfg).collect())


CASES = [
    ('api_key = "abcd1234"', "SEC-HARDCODED-SECRET", True),
    ('token = "/abc"', "SEC-HARDCODED-SECRET", False),          # look-ahead: no leading '/'
    ("exec(cmd)", "SEC-EVAL", True),
    ('exec("ls")', "SEC-EVAL", False),
    ("exec( \"x\")", "SEC-EVAL", True),                          # \s* gives back a space (D30)
    ("x = eval (y)", "SEC-EVAL", True),
    ('open("/etc/passwd")', "CHG-MAGIC-PATH", True),
    ('f = "/var/run/secrets/kubernetes.io/token"', "CHG-MAGIC-PATH", False),
    ("'/api/v1/users.json'", "CHG-MAGIC-PATH", False),
    ("'/static/js/app.min.js'", "CHG-MAGIC-PATH", True),
    ("el.innerHTML = '<b>' + name;", "SEC-XSS-INNERHTML", True),
    ("el.innerHTML = '<b>' + esc(name);", "SEC-XSS-INNERHTML", False),
    ("el.innerHTML = a + String(n);", "SEC-XSS-INNERHTML", False),
    ("md5(x)", "SEC-WEAK-HASH", True),
    ("mymd5(x)", "SEC-WEAK-HASH", False),
    ("über md5 ça", "SEC-WEAK-HASH", True),                       # ASCII word boundary next to é/ü
    ("DWORD n;", "PORT-WIN-TYPES", True),
    ("system(cmd)", "SEC-SYSTEM-CALL", True),
    ('system("ls")', "SEC-SYSTEM-CALL", False),
    ("subprocess.call([a])", "SEC-SYSTEM-CALL", False),
    ("// if (x) return;", "TRN-COMMENTED-CODE", True),
]


def test_rule_cases(spark):
    for text, rid, want in CASES:
        got = rid in hits(spark, text)
        assert got == want, (text, rid)


def test_java_forms_compile_and_match_python(spark):
    # every enabled catalogue pattern compiles in java.util.regex
    jvm = spark.sparkContext._jvm
    for r in CATALOGUE:
        jvm.java.util.regex.Pattern.compile(java_regex(r.pattern))
    # python re agrees with the Java form on the case lines (same dialect features)
    for text, rid, want in CASES:
        r = next(x for x in CATALOGUE if x.id == rid)
        assert bool(re.search(java_regex(r.pattern), text)) == want, (text, rid)


def test_inline_suppression(spark):
    cfg = ScanConfig()
    assert "SEC-WEAK-HASH" not in hits(spark, f"md5(x) // {cfg.suppress_marker} SEC-WEAK-HASH: ok")
    assert "SEC-WEAK-HASH" in hits(spark, f"md5(x) // {cfg.suppress_marker} OTHER")


def test_rule_line_cap_is_an_option(spark):
    from linewise.operators.rules import apply_rules, rejected_rules, select_rules, Rule
    long = "md5(a) " + "x" * 5000
    assert "SEC-WEAK-HASH" in hits(spark, long)
    lines = spark.createDataFrame([("p", "a.c", "C", 1, long)], "project string, path string, language string, n int, text string")
    assert apply_rules(lines, ScanConfig(max_rule_line_length=2000)).count() == 0
    # a user's rule that reuses an id is judged by its own pattern, and by the JVM's syntax
    mine = [Rule(1, "SEC-EVAL", "t", "", "minor", "security", 1, True, "x{9}"), Rule(2, "U", "t", "", "minor", "security", 1, True, r"\p{Lower}+x"),
            Rule(3, "BAD", "t", "", "minor", "security", 1, True, "(")]
    assert {r["rule_id"] for r in apply_rules(lines, ScanConfig(), mine).collect()} == {"SEC-EVAL", "U"}
    assert [i for i, _ in rejected_rules(mine)] == ["BAD"] and len(select_rules(rules=mine)) == 2


def guard_loop(lines):
    """Sequential reference: per line (in_win, in_posix, in_platform)."""
    stack, depth, out = [], 0, []
    toks = ["_WIN32", "__APPLE__", "__linux__", "_MSC_VER", "__GNUC__", "defined("]
    for ln in lines:
        m = re.match(r"^[ \t]*#[ \t]*(.*)$", ln)
        if m:
            d = m.group(1)
            win, plat = "_WIN32" in d, any(t in d for t in toks)
            if d.startswith("ifdef"):
                stack.append(1 if win else 0); depth += plat
            elif d.startswith("ifndef"):
                stack.append(2 if win else 0); depth += plat
            elif d.startswith("if"):
                stack.append((2 if "!" in d else 1) if win else 0); depth += plat
            elif d.startswith("elif"):
                if stack:
                    stack[-1] = 0
            elif d.startswith("else"):
                if stack and stack[-1] in (1, 2):
                    stack[-1] = 3 - stack[-1]
            elif d.startswith("endif"):
                if stack:
                    depth = max(0, depth - 1); stack.pop()
        out.append((1 in stack, 2 in stack, depth > 0))
    return out


GUARD_FILE = """int a;
#ifdef _WIN32
DWORD x;
#  if defined(__linux__)
pid_t p = fork();
#  endif
#else
pid_t q = fork();
#endif
#endif
#if !defined(_WIN32)
#include <unistd.h>
#elif X
#include <unistd.h>
#endif
# if python comment pushes
DWORD y;
"""


def test_guard_regions_match_loop(spark):
    df = files_df(spark, [("g.c", GUARD_FILE)])
    regions = guard_regions(explode_lines(df)).collect()
    lines = GUARD_FILE.split("\n")[:-1]
    want = guard_loop(lines)
    for i, w in enumerate(want, start=1):
        hit = [r for r in regions if r["from_line"] <= i <= r["to_line"]]
        got = (hit[0]["in_win"], hit[0]["in_posix"], hit[0]["in_platform"]) if hit else (False, False, False)
        assert got == w, (i, lines[i - 1])
    issues = {(r["line"], r["rule_id"]) for r in file_issues(explode_lines(df)).collect()}
    assert (3, "PORT-WIN-TYPES") not in issues          # inside _WIN32-true region
    assert (8, "PORT-POSIX-FORK") not in issues         # inside _WIN32-false region (#else)
    assert (12, "PORT-POSIX-ONLY") not in issues        # #if !defined(_WIN32)
    assert (14, "PORT-POSIX-ONLY") in issues            # #elif zeroes the frame
    assert (17, "PORT-WIN-TYPES") in issues             # '# if' frame is neutral


def test_join_rules_equals_literal_projection(spark):
    from linewise.operators.rules import join_rules, rules_frame, select_rules, Rule
    from linewise.sources.corpus import documents_as_files
    ln = explode_lines(documents_as_files(spark, "/root/testdata/sf0.001"))
    rs = [Rule(r.ord, r.id, r.title, r.cwe, r.severity, r.factor, r.minutes, r.enabled, java_regex(r.pattern))
          for r in select_rules()]
    a = apply_rules(ln).select("key").collect()
    b = join_rules(ln, rules_frame(spark, rs)).select("key").collect()
    assert sorted(a) == sorted(b) and len(a) > 0


def test_prefilter_is_necessary():
    """Every regex match contains one of the rule's prefilter literals."""
    import random
    from linewise.operators.rules import PREFILTER
    random.seed(11)
    pieces = ["password", "passwd", "secret", "api_key", "token", " = ", '"', "'", "abcd1234", "eval", "exec", "(",
              ")", "md5", "sha1", "des", "rc4", "ecb", "select", " * from ", "insert into", "update x", "delete from",
              "+", "system", "popen", "os.system", "subprocess.call", "catch", "{", "}", "todo", "fixme", "hack",
              "xxx", "/etc/", "/var/x", "/a/b.js", "c:\\\\x", "rand", "math.random", "random.random",
              "-----BEGIN RSA ", "AKIA" + "A" * 16, "Bearer " + "a" * 21 + ".b", "#include <windows.h>",
              "#include <unistd.h>", "DWORD", "WORD", "HANDLE", "LPCTSTR", "Sleep(1", "fork()", '"C:\\"',
              "MAX_PATH", "x.innerHTML = a + b", "../", "..\\\\", "printf(fmt", "f(x)->y", "for (i=0; i<v.size(); ",
              "// if", "goto", "malloc(", "while (n--)", " ", "é", "x"]
    for r in CATALOGUE:
        rx = re.compile(java_regex(r.pattern))
        lits = PREFILTER[r.id]
        for _ in range(3000):
            t = "".join(random.choice(pieces) for _ in range(random.randint(1, 6)))
            if rx.search(t):
                assert any(lit in t for lit in lits), (r.id, t)
