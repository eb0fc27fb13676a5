"""Literals that a text must hold for a pattern to match it: a cheap test before a costly one.

A pattern is parsed once on the driver. Each of its matches holds at least one string of `required(pattern)`, up to
the case of letters, so a text whose lower-case form holds none of them needs no regular expression. The test is
exact: it never rules out a text that matches. Patterns of which nothing can be said are not tested.
"""

from __future__ import annotations

import re
import re._constants as S
import re._parser as parser
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters beyond ASCII that match an ASCII letter when case is ignored; a text with one of them passes every test.
ODD_CASES = "[İıſK]"
_MOST, _WIDEST = 64, 8
Strings = frozenset[str]


def _better(a: Strings | None, b: Strings | None) -> Strings | None:
    """The set that rules out more: longer strings, then fewer."""
    if not a or not b:
        return a or b
    return min(a, b, key=lambda x: (-min(4, min(map(len, x))), len(x), sorted(x)))


def _char(code: int) -> Strings | None:
    c = chr(code)
    if code < 128:
        return frozenset([c.lower()])
    return frozenset([c]) if c.lower() == c.upper() else None


def _class(items) -> Strings | None:
    out: set[str] = set()
    for op, value in items:
        if op is S.LITERAL:
            one = _char(value)
        elif op is S.RANGE and value[1] - value[0] < _WIDEST:
            some = [_char(c) for c in range(value[0], value[1] + 1)]
            one = frozenset().union(*some) if all(some) else None
        else:
            one = None
        if one is None:
            return None
        out |= one
    return frozenset(out) if len(out) <= _WIDEST else None


def _walk(items) -> tuple[Strings | None, Strings | None]:
    """(all strings that the sequence matches, if they are few; strings of which each match holds one)."""
    run, whole, best = frozenset([""]), True, None

    def end() -> None:
        nonlocal run, whole, best
        if "" not in run:
            best = _better(best, run)
        run, whole = frozenset([""]), False

    for op, value in items:
        exact, need, last = None, None, False
        if op in (S.AT, S.ASSERT, S.ASSERT_NOT):
            continue
        if op is S.LITERAL:
            exact = _char(value)
        elif op is S.IN:
            exact = _class(value)
        elif op is S.SUBPATTERN:
            exact, need = _walk(value[3])
        elif op is S.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
            each = [_better(n, e if e and "" not in e else None) for e, n in parts]
            need = frozenset().union(*each) if all(each) else None
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
            least, most, sub = value
            exact, need = _walk(sub)
            if least == 0:
                need = None
                exact = exact | {""} if exact is not None and most == 1 else None
            else:
                last = most != 1
        best = _better(best, need)
        if exact is None:
            end()
            continue
        joined = frozenset(a + b for a in run for b in exact) if len(run) * len(exact) <= _MOST else None
        if joined is None:
            end()
            run = exact
        else:
            run = joined
        if last:
            end()
    if whole:
        return run, _better(best, run if "" not in run else None)
    end()
    return None, best


@cache
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match holds one; empty if there are none of two characters or more."""
    try:
        _, need = _walk(parser.parse(pattern))
    except re.error:  # a pattern in another dialect
        return ()
    return tuple(sorted(need)) if need and min(map(len, need)) > 1 else ()


def odd_cases(text: Column) -> Column:
    """Whether text holds one of ODD_CASES."""
    return reduce(or_, (F.contains(text, F.lit(c)) for c in ODD_CASES[1:-1]))


def lowered(text: Column) -> Column:
    """What may_match looks at: the text in lower case, or null if it holds one of ODD_CASES."""
    return F.when(~text.rlike(ODD_CASES), F.lower(text))


def quoted(x: str) -> str:
    """x as a string literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def may_match_sql(low: str, pattern: str) -> str:
    """False only if the text of which low is the lowered form can't match pattern."""
    need = required(pattern)
    if not need:
        return "true"
    return f"({low} IS NULL OR exists(array({', '.join(map(quoted, need))}), n -> contains({low}, n)))"
