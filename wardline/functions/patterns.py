"""Literal guards for pattern lists: a byte search that tells where no pattern can match."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the standard parser of regular expressions, public under its old name
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse as parser

MIN_LITERAL = 3


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """The guard with the longer shortest literal, then with fewer literals."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _walk(sequence) -> frozenset | None:
    best, run = None, ""

    def close():
        nonlocal best, run
        if len(run) >= MIN_LITERAL:
            best = _better(best, frozenset([run.lower()]))
        run = ""

    for op, argument in sequence:
        if op is sre.LITERAL:
            run += chr(argument)
            continue
        close()
        if op is sre.SUBPATTERN:
            best = _better(best, _walk(argument[-1]))
        elif op is sre.BRANCH:
            parts = [_walk(branch) for branch in argument[1]]
            if all(parts):
                best = _better(best, frozenset().union(*parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and argument[0] >= 1:
            best = _better(best, _walk(argument[2]))
    close()
    return best


@lru_cache(maxsize=4096)
def required_literals(pattern: str) -> frozenset | None:
    """Lower-case literals of which every match holds at least one; None if the pattern names none."""
    try:
        return _walk(parser.parse(pattern))
    except (re.error, OverflowError):
        return None


def may_match(low: Column, patterns: Sequence[str]) -> Column | None:
    """True where the lower-cased text holds a literal of any pattern; None when there is no such guard."""
    sets = [required_literals(p) for p in patterns]
    if not all(sets):
        return None
    words = frozenset().union(*sets)
    # a literal that contains another one adds nothing
    needed = sorted(w for w in words if not any(o != w and o in w for o in words))
    guard = F.lit(False)
    for word in needed:
        guard = guard | low.contains(word)
    return guard


def guard_text(text: Column) -> Column:
    """Lower case for ``may_match``; the long s equals s when case is ignored."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))
