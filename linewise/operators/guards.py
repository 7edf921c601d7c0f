"""Platform guards: preprocessor conditionals as a stack automaton in the file row.

The directives of a file (lines that start with '#') are an array of the file's
row.  Each is first classed as an event: open a frame with a mark, turn the top
frame's mark, mask it, or close it.  An `aggregate` over the events carries the
stack of marks and the depth of platform frames; it runs over the array in
slices, so what it gathers is copied in proportion to the array.  Issues of the
rules that guards can silence are merged into the event array by line, so the
same fold says of each whether it stands in a silencing region: no exchange, no
Python, no range join.

Marks: 1 where _WIN32 holds, 2 where it does not hold, 0 for any other frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names a platform in a directive, and the rules that guards silence.
PLATFORM_TOKENS = ["_WIN32", "__APPLE__", "__linux__", "_MSC_VER", "__GNUC__", "defined("]
WINDOWS_RULES, POSIX_RULES = "PORT-WIN", "PORT-POSIX"        # rule id prefixes
PLATFORM_RULES = ["CHG-MAGIC-PATH", "SEC-SYSTEM-CALL"]

LAST_LINE = 2**31 - 1
SLICE = 256  # events that one inner fold takes

EVENT = "struct<n: int, issue: int, act: string, mark: int, platform: int>"  # sorts by line, a directive before the issues of its line
STATE = "struct<n: int, in_win: boolean, in_posix: boolean, in_platform: boolean, issue: int>"


def directives(lines: Column) -> Column:
    """array<struct<n, d>> of a line array: d is the text after '#', left-trimmed."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("text")))
    kept = F.filter(numbered, lambda s: s["text"].rlike(r"^[ \t]*#"))
    return F.transform(kept, lambda s: F.struct(s["n"].alias("n"), F.regexp_extract(s["text"], r"(?s)^[ \t]*#[ \t]*(.*)\z", 1).alias("d")))


def guard_events(found: str) -> str:
    """SQL: the guard events among directives (other directives go)."""
    platform = " or ".join(f"contains(x.d, '{t}')" for t in PLATFORM_TOKENS)
    act = ("case when startswith(x.d, 'if') then 'open' when startswith(x.d, 'elif') then 'mask' "
           "when startswith(x.d, 'else') then 'turn' when startswith(x.d, 'endif') then 'close' end")
    negated = "startswith(x.d, 'ifndef') or not startswith(x.d, 'ifdef') and contains(x.d, '!')"
    mark = f"case when not contains(x.d, '_WIN32') then 0 when {negated} then 2 else 1 end"
    event = f"struct(x.n as n, -1 as issue, {act} as act, {mark} as mark, if({platform}, 1, 0) as platform)"
    return f"cast(filter(transform({found}, x -> {event}), e -> e.act is not null) as array<{EVENT}>)"


def folded(events: str) -> str:
    """SQL: array<STATE>, what holds from each event on (for an issue event: where it stands)."""
    top = "try_element_at(s.marks, -1)"
    rest = "slice(s.marks, 1, size(s.marks) - 1)"
    marks = (f"case when e.act = 'open' then concat(s.marks, array(e.mark)) when size(s.marks) = 0 or e.act = 'issue' then s.marks "
             f"when e.act = 'mask' then concat({rest}, array(0)) when e.act = 'close' then {rest} "
             f"when {top} > 0 then concat({rest}, array(3 - {top})) else s.marks end")
    depth = ("case when e.act = 'open' then s.depth + e.platform "
             "when e.act = 'close' and size(s.marks) > 0 then greatest(0, s.depth - 1) else s.depth end")
    # one event changes the marks and the depth, then what holds is noted
    moved = f"named_struct('marks', cast({marks} as array<int>), 'depth', cast({depth} as int))"
    seen = ("struct(e.n as n, array_contains(m.marks, 1) as in_win, array_contains(m.marks, 2) as in_posix, m.depth > 0 as in_platform, e.issue as issue)")
    inner = f"array_compact(transform(array({moved}), m -> named_struct('marks', m.marks, 'depth', m.depth, 'seen', concat(s.seen, cast(array({seen}) as array<{STATE}>)))))[0]"
    state = f"struct<marks: array<int>, depth: int, seen: array<{STATE}>>"
    part = f"slice({events}, at * {SLICE} + 1, {SLICE})"
    run = (f"aggregate({part}, cast(struct(o.marks as marks, o.depth as depth, array() as seen) as {state}), (s, e) -> cast({inner} as {state}))")
    outer = f"struct<marks: array<int>, depth: int, seen: array<array<{STATE}>>>"
    step = f"transform(array({run}), r -> cast(struct(r.marks as marks, r.depth as depth, concat(o.seen, array(r.seen)) as seen) as {outer}))[0]"
    return (f"flatten(aggregate(if(size({events}) = 0, cast(array() as array<int>), sequence(0, (size({events}) - 1) div {SLICE})), "
            f"cast(struct(array() as marks, 0 as depth, array() as seen) as {outer}), (o, at) -> {step}, o -> o.seen))")


def regions(events: str) -> str:
    """SQL: array<struct<from_line, to_line, in_win, in_posix, in_platform>> of guard events,
    where some flag holds."""
    each = (f"transform(h, (x, i) -> struct(x.n as from_line, coalesce(get(h, i + 1).n - 1, {LAST_LINE}) as to_line, "
            "x.in_win as in_win, x.in_posix as in_posix, x.in_platform as in_platform))")
    return f"flatten(transform(array({folded(events)}), h -> filter({each}, r -> r.in_win or r.in_posix or r.in_platform)))"


def with_regions(files: DataFrame) -> DataFrame:
    """(project, path, directives array) -> regions rows, a projection of each file row."""
    ev = files.select("project", "path", F.expr(guard_events("directives")).alias("events"))
    return ev.filter(F.size("events") > 0).select("project", "path", F.inline(F.expr(regions("events"))))


def silenced(rule_id: str, state: str) -> str:
    """SQL: whether a rule is silenced where a state holds."""
    names = ", ".join(f"'{r}'" for r in PLATFORM_RULES)
    return (f"(startswith({rule_id}, '{WINDOWS_RULES}') and {state}.in_win or startswith({rule_id}, '{POSIX_RULES}') and {state}.in_posix "
            f"or {rule_id} in ({names}) and {state}.in_platform)")


def silenced_issues(files: DataFrame, issues: str = "issues", found: str = "directives") -> DataFrame:
    """files with `silenced` in each struct of its issue array, in (line, rule_ord) order.

    Only files with guards and issues of the guarded rules run the fold."""
    names = ", ".join(f"'{r}'" for r in PLATFORM_RULES)
    guarded = f"(startswith(r.rule_id, '{WINDOWS_RULES}') or startswith(r.rule_id, '{POSIX_RULES}') or r.rule_id in ({names}))"
    keep = [c for c in files.columns if c != issues]
    fields = [f.name for f in files.schema[issues].dataType.elementType]
    flagged = "struct(" + ", ".join(f"r.{c} as {c}" for c in fields) + ", {} as silenced)"
    d = files.select(*keep, issues, F.expr(guard_events(found)).alias("_events"), F.expr(f"filter({issues}, r -> {guarded})").alias("_asked"))
    asked = f"cast(transform(_asked, (r, i) -> struct(r.line as n, i as issue, 'issue' as act, 0 as mark, 0 as platform)) as array<{EVENT}>)"
    d = d.withColumn("_events", F.expr(f"if(size(_events) > 0 and size(_asked) > 0, sort_array(concat(_events, {asked})), cast(array() as array<{EVENT}>))"))
    # the states of issue events, put in the order of the issues that asked
    d = d.withColumn("_states", F.expr(f"sort_array(transform(filter({folded('_events')}, s -> s.issue >= 0), s -> struct(s.issue as issue, s as s)))"))
    told = f"zip_with(_asked, _states, (r, t) -> {flagged.format('coalesce(' + silenced('r.rule_id', 't.s') + ', false)')})"
    others = f"transform(filter({issues}, r -> not {guarded}), r -> {flagged.format('false')})"
    return d.select(*keep, F.expr(f"sort_array(concat({told}, {others}))").alias(issues))
