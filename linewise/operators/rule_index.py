"""Which rules may match a line: an index of the literals that a match must hold.

For each pattern a set of literals is derived such that every match contains at
least one of them.  All literals of a batch of rules make one Aho-Corasick
automaton, which proposes (line, rule) pairs in one pass over the line; only
those pairs meet a regex.  Patterns without such literals are few and are tested
on every line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser as parser

import pandas as pd

LEAST = 3     # shortest literal worth an index entry
MOST = 64     # alternatives of one pattern; more are treated as none


def necessary_literals(pattern: str) -> list[str] | None:
    """Literals of which every match of the pattern contains one; None if none are known.

    Judged on the common ground of Python's and Java's syntax: a pattern that
    Python cannot parse, or that ignores case, has none."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    found = _of_sequence(tree)
    if not found or len(found) > MOST or min(map(len, found)) < LEAST:
        return None
    return sorted(found)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer; of equals the smaller one."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of_sequence(items) -> set[str] | None:
    """A literal that the sequence holds: the best of its parts and of its runs of plain characters."""
    best, run = None, ""
    for op, arg in items:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if run:
            best, run = _better(best, {run}), ""
        best = _better(best, _of_item(op, arg))
    return _better(best, {run}) if run else best


def _of_item(op, arg) -> set[str] | None:
    if op is K.SUBPATTERN:
        _, on, _, inner = arg
        return None if on & re.IGNORECASE else _of_sequence(inner)
    if op is K.ATOMIC_GROUP:
        return _of_sequence(arg)
    if op is K.BRANCH:
        each = [_of_sequence(branch) for branch in arg[1]]
        return set().union(*each) if all(each) else None
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] >= 1:
        return _of_sequence(arg[2])
    return None


def proposer(entries: list[tuple[str, int]]):
    """(literal, rule number) -> a pandas function: lines with the numbers of rules they may match."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        rules: dict[str, set[int]] = {}
        for literal, number in entries:
            rules.setdefault(literal, set()).add(number)
        index = ahocorasick.Automaton()
        for literal, numbers in rules.items():
            index.add_word(literal, numbers)
        index.make_automaton()
        for f in frames:
            f = f[f["text"].notna()]
            found = [sorted(set().union(*(numbers for _, numbers in index.iter(t)))) for t in f["text"]]
            out = f.assign(proposed=found)
            yield out[[bool(x) for x in found]]
    return run
