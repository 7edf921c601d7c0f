"""The literal index: no match is missed, no nested-loop join, any number of rules."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import files_df
from linewise.functions.text import java_regex
from linewise.operators import rules as R
from linewise.operators.lines import explode_lines
from linewise.operators.rule_index import necessary_literals


def test_literals_of_patterns():
    lits = necessary_literals
    assert lits(r"md5\s*\(") == ["md5"] and lits(r"\b(?:strcpy|strcat|gets)\b") == ["gets", "strcat", "strcpy"]
    assert lits(r"(foo|ba)+x") is None and lits(r"(?:abc)?def{2}") is None and lits(r"(?:abcd)?defg{2}") == ["def"]
    assert lits(r"a.*hello world") == ["hello world"] and lits(r"(?i)hello") is None and lits("(") is None and lits(r"(?!hello)x\d") is None
    assert lits(r"[abc]+\w") is None and lits("") is None


WORDS = ["md5", "abc", "x", "hello", "_y", "9"]
LEAVES = st.sampled_from([*WORDS, r"\d", r"\w", ".", "[ab]", r"\s*", "a?"])
PATTERNS = st.recursive(LEAVES, lambda p: st.one_of(
    st.lists(p, min_size=1, max_size=4).map("".join), st.lists(p, min_size=1, max_size=3).map(lambda x: "(?:" + "|".join(x) + ")"),
    p.map(lambda x: f"(?:{x})?"), p.map(lambda x: f"(?:{x}){{2}}"), p.map(lambda x: f"(?={x})"), p.map(lambda x: f"(?:{x})+")), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(PATTERNS, st.lists(st.sampled_from([*WORDS, " ", "a", "b", "1"]), max_size=12).map("".join))
def test_a_match_holds_a_literal(pattern, text):
    found, m = necessary_literals(pattern), re.search(pattern, text)
    if found and m:
        assert any(w in text for w in found)


def test_user_rules_in_batches_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    patterns = [rf"\bword{i}\b" for i in range(40)] + [r"\d{4}", "é+x", "(", None, r"lit(?:eral|mus)", "^$"]
    kinds = "rule_ord int, rule_id string, title string, cwe string, severity string, factor string, remediation_minutes int, enabled boolean, pattern string"
    table = [(i, f"U{i}", "t", "", "minor", "security", 1, i != 5, p) for i, p in enumerate(patterns)]
    text = "\n".join(" ".join(rng.choices([f"word{i}" for i in range(45)] + ["1234", "ééx", "litmus", "", "literal"], k=rng.randrange(0, 5))) for _ in range(150))
    ln = explode_lines(files_df(spark, [("a.c", text)]))
    want = sorted((n, i) for n, t in enumerate(text.split("\n"), 1) for i, p in enumerate(patterns) if p not in ("(", None) and i != 5 and re.search(p, t) and (n < len(text.split("\n")) or t))
    rules = spark.createDataFrame(table, kinds)
    whole = R.join_rules(ln, rules)
    assert sorted((r.line, r.rule_ord) for r in whole.collect()) == want
    assert "NestedLoop" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "RULE_BATCH", 7)
    assert sorted((r.line, r.rule_ord) for r in R.join_rules(ln, rules).collect()) == want
    assert R.join_rules(ln, rules.filter("false")).collect() == [] and R.join_rules(ln.limit(0), rules).collect() == []


def test_shipped_rules_have_literals():
    known = [r.id for r in R.CATALOGUE if necessary_literals(java_regex(r.pattern))]
    assert len(known) >= 20
