"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is a conjunction of clauses; a clause is a disjunction of alternatives; an alternative is a set of trigrams that
must all occur. It is derived from the parsed expression by keeping, while walking a sequence, the finite set of strings
the part read so far can spell; where that set becomes unknown or large, the strings gathered are turned into a clause.
Case is ignored: trigrams are lower-case and are looked up in lower-cased text, which can only add candidates.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

MAX_STRINGS = 64
MAX_CLASS = 4

Query = list[list[frozenset[str]]]


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> Query:
    """The strings as one clause, without alternatives that another implies; none if a string is too short for a trigram."""
    if not strings or min(map(len, strings)) < 3:
        return []
    sets = {_grams(s) for s in strings}
    return [sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)]


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _walk(seq) -> tuple[set[str] | None, Query]:
    """(all strings the sequence can spell, or None if unknown; clauses that hold besides)."""
    sofar: set[str] = {""}
    whole, clauses = True, []
    for op, arg in seq:
        if op is C.AT:
            continue
        part, more = _strings(op, arg)
        clauses += more
        if part is not None and len(sofar) * len(part) <= MAX_STRINGS:
            sofar = {a + b for a in sofar for b in part}
        else:
            clauses += _clause(sofar)
            whole, sofar = False, part if part is not None else {""}
    return (sofar, clauses) if whole else (None, clauses + _clause(sofar))


def _strings(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, []
    if op is C.IN:
        return _class(arg), []
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(p is not None for p, _ in parts):
            return set().union(*[p for p, _ in parts]), []
        return None, []
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        part, more = _walk(inner)
        if (low, high) == (0, 1) and part is not None:
            return part | {""}, []
        if low == high == 1:
            return part, more
        return None, (more + (_clause(part) if part else [])) if low else []
    return None, []


def trigram_query(pattern: str) -> Query:
    """The clauses of a Java or Python pattern; an empty list if it has no mandatory trigram, so must scan everything."""
    strings, clauses = _walk(_parser.parse(pattern))
    return clauses + (_clause(strings) if strings else [])
